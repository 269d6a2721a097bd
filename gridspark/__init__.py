"""A PySpark engine for ensembles of gridded, time-indexed datasets."""
