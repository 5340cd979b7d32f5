"""Operators on a city model: queries, hierarchies, statistics, loading, removal, change log."""
