"""Queries over whole tables, and the same in SQL."""
