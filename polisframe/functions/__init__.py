"""Column functions: comparison, envelopes, validity, geometry."""
