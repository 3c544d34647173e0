"""Spark jobs that do the data work of a team-workspace service in bulk."""
