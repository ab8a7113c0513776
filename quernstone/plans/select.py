"""SELECT definitions: JSON to a checked plan over one table, or over none."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quernstone.plans.expressions import Expression, Reference, parse, references, type_of
from quernstone.problems import Problem, QueryError
from quernstone.types import Type

LARGEST_LIMIT = 2**31 - 1


@dataclass(frozen=True)
class Order:
    """Of a result column by place, or by the name of a column that is projected bare."""

    index: int | None
    column: str | None
    table: str
    ascending: bool


@dataclass(frozen=True)
class Select:
    projections: tuple[Expression, ...]
    where: Expression | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Plan:
    """A query whose names and types are resolved: orders are places in the projections."""

    query: Select
    table: str | None
    types: tuple[Type, ...]
    order: tuple[tuple[int, bool], ...] = field(default=())


def _order(item: Any, place: str) -> Order:
    if not isinstance(item, dict):
        raise QueryError(Problem("Order must be an object", place))
    index, column = item.get("columnIndex"), item.get("columnName")
    if index is None and column is None:
        raise QueryError(Problem("Order needs columnIndex or columnName", place))
    if index is not None and (not isinstance(index, int) or isinstance(index, bool)):
        raise QueryError(Problem("columnIndex must be an integer", place))
    if index is None and not isinstance(column, str):
        raise QueryError(Problem("columnName must be a string", place))
    if "ascending" in item:
        if not isinstance(item["ascending"], bool):
            raise QueryError(Problem("ascending must be a boolean", place))
        ascending = item["ascending"]
    else:
        direction = str(item.get("direction", "ASC")).upper()
        if direction not in ("ASC", "DESC"):
            raise QueryError(Problem(f"Unknown direction {item['direction']}", place))
        ascending = direction == "ASC"
    return Order(index, None if index is not None else column, item.get("tableName") or "", ascending)


def parse_select(definition: dict[str, Any]) -> Select:
    clauses = definition.get("columnClauses")
    if not isinstance(clauses, list) or not clauses:
        raise QueryError("columnClauses must be a list of at least one expression")
    projections = tuple(parse(c, f"columnClauses[{i}]") for i, c in enumerate(clauses))
    where = definition.get("whereClause")
    order = definition.get("orderByClause", definition.get("orderByClauses")) or []
    if not isinstance(order, list):
        raise QueryError("orderByClause must be a list")
    limit = definition.get("limitClause")
    if limit is not None:
        limit = limit.get("limit") if isinstance(limit, dict) else limit
        if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or not 0 <= limit <= LARGEST_LIMIT):
            raise QueryError(Problem("limit must be a non-negative 32-bit integer", "limitClause"))
    return Select(
        projections,
        parse(where, "whereClause") if where is not None else None,
        tuple(_order(o, f"orderByClause[{i}]") for i, o in enumerate(order)),
        limit,
    )


def table_of(query: Select, tables: list[str]) -> str | None:
    """The one table that the query's references name; unnamed ones mean it, or the only table there is.

    None for a query without references. References to different tables are an error.
    """
    found = [r for p in query.projections for r in references(p)]
    found += references(query.where) if query.where is not None else []
    named = list(dict.fromkeys(r.table for r in found if r.table))
    named += [o.table for o in query.order if o.table and o.table not in named]
    if len(named) > 1:
        raise QueryError(f"Query refers to more than one table: {', '.join(named)}")
    if named:
        return named[0]
    if not found:
        return None
    if len(tables) == 1:
        return tables[0]
    raise QueryError(Problem("Column references don't name their table", found[0].column))


def resolve(query: Select, table: str | None, columns: dict[str, Type]) -> Plan:
    """Names and types checked; all problems are reported together."""
    problems: list[Problem] = []
    types: list[Type] = []
    for i, tree in enumerate(query.projections):
        try:
            types.append(type_of(tree, columns, f"columnClauses[{i}]"))
        except QueryError as error:
            problems += error.problems
    if query.where is not None:
        try:
            if type_of(query.where, columns, "whereClause") != Type.BOOL:
                problems.append(Problem("WHERE must be BOOL", "whereClause"))
        except QueryError as error:
            problems += error.problems
    order: list[tuple[int, bool]] = []
    for i, item in enumerate(query.order):
        at = item.index
        if at is None:
            at = next(
                (k for k, p in enumerate(query.projections) if isinstance(p, Reference) and p.column == item.column), -1
            )
        if not 0 <= at < len(query.projections):
            what = item.column if item.index is None else f"index {item.index}"
            problems.append(Problem(f"ORDER BY {what} is not among the projections", f"orderByClause[{i}]"))
        order.append((at, item.ascending))
    if problems:
        raise QueryError(*problems)
    return Plan(query, table, tuple(types), tuple(order))
