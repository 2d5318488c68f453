"""Training-data operators: one module per operator, general interfaces; `queries` holds the registered queries."""
