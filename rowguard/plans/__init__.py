"""Schemas and what they compile to."""
