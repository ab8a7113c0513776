"""Scalar operators and functions as Spark columns."""
