"""Events of a store."""
