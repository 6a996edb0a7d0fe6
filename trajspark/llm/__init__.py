"""Training-data operators: one module per operator, used by nothing else in the package."""
