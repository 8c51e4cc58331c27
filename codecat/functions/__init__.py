"""Column functions: pure expressions over paths, names and file contents."""
