"""Operators on the long table of cells ``name, time, x, y, value``."""
