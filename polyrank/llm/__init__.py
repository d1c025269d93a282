"""Training-data operators: one module for each, one thin query for each in ``catalog``."""
