"""Training-data operators: one module per operator, all queries in ``queries``."""
