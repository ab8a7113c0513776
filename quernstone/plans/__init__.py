"""Definitions parsed, resolved and type-checked."""
