"""DataFrame operators keyed by entity id."""
