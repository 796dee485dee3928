"""Where classes find their rows."""
