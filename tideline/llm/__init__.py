"""Training-data operators: one module an operator, `queries` registers them."""
