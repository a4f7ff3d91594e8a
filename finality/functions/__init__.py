"""Column functions and the blocked prefix scan."""
