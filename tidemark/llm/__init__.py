"""Training-data operators: one module each, nothing outside this subpackage imports them."""
