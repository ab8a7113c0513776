"""Expressions of the query language: JSON to a typed tree, without any implicit cast."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from quernstone.problems import Problem, QueryError
from quernstone.types import INT64_MAX, INT64_MIN, Type

ARITHMETIC = ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE")
LOGICAL = ("AND", "OR")
COMPARISONS = ("EQUAL", "NOT_EQUAL", "LESS_THAN", "LESS_EQUAL", "GREATER_THAN", "GREATER_EQUAL")
BINARY = ARITHMETIC + LOGICAL + COMPARISONS
UNARY = {"NOT": Type.BOOL, "MINUS": Type.INT64}
#: Types of the arguments, and of the value.
FUNCTIONS: dict[str, tuple[tuple[Type, ...], Type]] = {
    "STRLEN": ((Type.VARCHAR,), Type.INT64),
    "CONCAT": ((Type.VARCHAR, Type.VARCHAR), Type.VARCHAR),
    "REPLACE": ((Type.VARCHAR,) * 3, Type.VARCHAR),
    "UPPER": ((Type.VARCHAR,), Type.VARCHAR),
    "LOWER": ((Type.VARCHAR,), Type.VARCHAR),
}
DEEPEST = 200


@dataclass(frozen=True)
class Literal:
    value: int | str | bool


@dataclass(frozen=True)
class Reference:
    column: str
    table: str = ""


@dataclass(frozen=True)
class Call:
    function: str
    arguments: tuple


@dataclass(frozen=True)
class Binary:
    operator: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Unary:
    operator: str
    operand: Any


Expression = Literal | Reference | Call | Binary | Unary


def parse(source: Any, where: str = "expression", depth: int = 0) -> Expression:
    """A tree from JSON; the key that is present decides the kind."""
    if depth > DEEPEST:
        raise QueryError(Problem("Expression is nested too deeply", where))
    if not isinstance(source, dict):
        raise QueryError(Problem("Expression must be an object", where))

    def part(key: str, name: str) -> Expression:
        if key not in source:
            raise QueryError(Problem(f"{name} is missing", where))
        return parse(source[key], f"{where}.{key}", depth + 1)

    if "value" in source:
        value = source["value"]
        if isinstance(value, bool | str):
            return Literal(value)
        if isinstance(value, int) and INT64_MIN <= value <= INT64_MAX:
            return Literal(value)
        raise QueryError(Problem("Literal must be a 64-bit integer, a string or a boolean", where))
    if "columnName" in source:
        column, table = source["columnName"], source.get("tableName") or ""
        if not isinstance(column, str) or not isinstance(table, str):
            raise QueryError(Problem("Column reference must consist of strings", where))
        return Reference(column, table)
    if "functionName" in source:
        name, arguments = source["functionName"], source.get("arguments", [])
        if name not in FUNCTIONS:
            raise QueryError(Problem(f"Unknown function {name}", where))
        if not isinstance(arguments, list):
            raise QueryError(Problem("Arguments must be a list", where))
        return Call(name, tuple(parse(a, f"{where}.arguments[{i}]", depth + 1) for i, a in enumerate(arguments)))
    if "leftOperand" in source:
        operator = source.get("operator")
        if operator not in BINARY:
            raise QueryError(Problem(f"Unknown binary operator {operator}", where))
        return Binary(operator, part("leftOperand", "Left operand"), part("rightOperand", "Right operand"))
    if "operand" in source:
        operator = source.get("operator")
        if operator not in UNARY:
            raise QueryError(Problem(f"Unknown unary operator {operator}", where))
        return Unary(operator, part("operand", "Operand"))
    raise QueryError(Problem("Expression has no value, column, function or operand", where))


def references(tree: Expression) -> list[Reference]:
    """Column references, depth first from the left."""
    if isinstance(tree, Reference):
        return [tree]
    if isinstance(tree, Call):
        return [r for a in tree.arguments for r in references(a)]
    if isinstance(tree, Binary):
        return references(tree.left) + references(tree.right)
    return references(tree.operand) if isinstance(tree, Unary) else []


def type_of(tree: Expression, columns: dict[str, Type], where: str = "expression") -> Type:
    """The type of a tree over columns of these names and types, or QueryError."""

    def fail(text: str) -> QueryError:
        return QueryError(Problem(text, where))

    if isinstance(tree, Literal):
        return Type.BOOL if isinstance(tree.value, bool) else Type.INT64 if isinstance(tree.value, int) else Type.VARCHAR
    if isinstance(tree, Reference):
        if tree.column not in columns:
            raise fail(f"Unknown column {tree.column}")
        return columns[tree.column]
    if isinstance(tree, Call):
        wanted, result = FUNCTIONS[tree.function]
        given = tuple(type_of(a, columns, where) for a in tree.arguments)
        if given != wanted:
            raise fail(f"{tree.function} takes ({', '.join(wanted)}), not ({', '.join(given)})")
        return result
    if isinstance(tree, Unary):
        wanted = UNARY[tree.operator]
        if type_of(tree.operand, columns, where) != wanted:
            raise fail(f"{tree.operator} takes {wanted.value}")
        return wanted
    left, right = type_of(tree.left, columns, where), type_of(tree.right, columns, where)
    if tree.operator in COMPARISONS:
        if left != right:
            raise fail(f"{tree.operator} takes two values of one type, not {left.value} and {right.value}")
        return Type.BOOL
    wanted = Type.INT64 if tree.operator in ARITHMETIC else Type.BOOL
    if (left, right) != (wanted, wanted):
        raise fail(f"{tree.operator} takes {wanted.value} values, not {left.value} and {right.value}")
    return wanted
