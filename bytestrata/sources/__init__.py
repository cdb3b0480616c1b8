"""Files as rows."""
