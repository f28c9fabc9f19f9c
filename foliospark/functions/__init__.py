"""Column functions and the page parser."""
