"""File-name metadata as Column expressions."""
