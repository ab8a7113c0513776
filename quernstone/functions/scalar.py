"""Typed trees as Spark columns, all inside whole-stage code generation.

Lengths are in bytes and case mapping is ASCII only. Integer overflow and division by zero raise (the
session runs in ANSI mode), so a query that meets them fails as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.plans.expressions import Binary, Call, Expression, Literal, Reference, Unary

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "ADD": lambda a, b: a + b,
    "SUBTRACT": lambda a, b: a - b,
    "MULTIPLY": lambda a, b: a * b,
    "DIVIDE": lambda a, b: F.call_function("div", a, b),
    "AND": lambda a, b: a & b,
    "OR": lambda a, b: a | b,
    "EQUAL": lambda a, b: a == b,
    "NOT_EQUAL": lambda a, b: a != b,
    "LESS_THAN": lambda a, b: a < b,
    "LESS_EQUAL": lambda a, b: a <= b,
    "GREATER_THAN": lambda a, b: a > b,
    "GREATER_EQUAL": lambda a, b: a >= b,
}
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "STRLEN": lambda a: F.octet_length(a).cast("bigint"),
    "CONCAT": lambda a, b: F.concat(a, b),
    "REPLACE": lambda a, search, new: F.replace(a, search, new),
    "UPPER": lambda a: F.translate(a, ascii_lowercase, ascii_uppercase),
    "LOWER": lambda a: F.translate(a, ascii_uppercase, ascii_lowercase),
}
UNARY: dict[str, Callable[[Column], Column]] = {"NOT": lambda a: ~a, "MINUS": lambda a: -a}


def to_column(tree: Expression, columns: dict[str, Column]) -> Column:
    """A checked tree over these columns."""
    if isinstance(tree, Literal):
        value = F.lit(tree.value)
        return value.cast("bigint") if isinstance(tree.value, int) and not isinstance(tree.value, bool) else value
    if isinstance(tree, Reference):
        return columns[tree.column]
    if isinstance(tree, Call):
        return FUNCTIONS[tree.function](*[to_column(a, columns) for a in tree.arguments])
    if isinstance(tree, Unary):
        return UNARY[tree.operator](to_column(tree.operand, columns))
    assert isinstance(tree, Binary)
    return OPERATORS[tree.operator](to_column(tree.left, columns), to_column(tree.right, columns))
