"""Relational operators over fleet tables."""
