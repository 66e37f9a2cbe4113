"""Runnable queries over the given tables, each with SQL where one exists."""
