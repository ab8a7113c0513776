"""Relational operators over checked plans."""
