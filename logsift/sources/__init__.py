"""Reading log streams and tables, writing tables."""
