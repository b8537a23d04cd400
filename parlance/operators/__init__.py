"""Relational operators of the conversation archive."""
