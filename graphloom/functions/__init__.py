"""Built-in and registered functions."""
