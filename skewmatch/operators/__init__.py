"""DataFrame operators: ordinals, block statistics, routing, matchers."""
