"""Column factories and packaged constants."""
