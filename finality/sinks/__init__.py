"""CSV and text writers."""
