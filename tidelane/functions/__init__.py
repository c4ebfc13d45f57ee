"""See the package docstring of tidelane."""
