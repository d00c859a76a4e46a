"""Reusable relational steps."""
