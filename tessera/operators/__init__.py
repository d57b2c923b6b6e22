"""Relational operators as DataFrame expressions."""
