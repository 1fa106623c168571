"""Column expressions: vectors, keys and file names, ratios and metrics, geometry."""
