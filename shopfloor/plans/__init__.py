"""Report-level operators: one module per reference report."""
