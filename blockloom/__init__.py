"""Block-sorting compression as DataFrame operations."""
