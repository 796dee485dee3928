"""From models to typed plans."""
