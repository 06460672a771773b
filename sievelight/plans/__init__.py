"""Queries: what a user runs, by name."""
