"""Column expressions: source names, time, planar geometry, map projection."""
