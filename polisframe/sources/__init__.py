"""File formats and table directories."""
