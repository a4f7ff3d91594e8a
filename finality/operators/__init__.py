"""DataFrame operators: arrival order, routing, window finalization."""
