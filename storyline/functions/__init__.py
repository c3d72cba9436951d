"""See the package docstring of storyline."""
