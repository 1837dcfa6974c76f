"""Column-level helpers: calendar arithmetic, guards, text and tail functions."""
