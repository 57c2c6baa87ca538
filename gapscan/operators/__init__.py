"""DataFrame operators. Each takes tables and parameters and returns a table."""
