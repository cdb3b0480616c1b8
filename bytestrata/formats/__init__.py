"""Part of the binary structure engine."""
