"""Reusable DataFrame operators composed by the report plans."""
