"""Adapters from the test tables, registered queries and their SQL."""
