"""Queries over the driver tables, each with an equivalent SQL statement where SQL can say it."""
