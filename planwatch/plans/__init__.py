"""Queries with the SQL that states the same."""
