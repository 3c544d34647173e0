"""Column expressions that the jobs share."""
