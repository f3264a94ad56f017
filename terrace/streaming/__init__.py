"""Tables kept up to date from streams."""
