"""The engine: SELECT and COPY definitions carried out, their status, results and problems kept.

Results are written as Parquet by the executors and only read back when they are fetched, so a large
result never passes through the driver unless a client asks for all of it.
"""

from __future__ import annotations

import logging
from concurrent.futures import Future, ThreadPoolExecutor
from enum import Enum
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quernstone.catalog import Catalog, new_id
from quernstone.files import remove
from quernstone.operators.select import build
from quernstone.plans.select import Plan, Select, parse_select, resolve, table_of
from quernstone.problems import Problem, QueryError
from quernstone.sources.csv import BAD_CELL, read_cells
from quernstone.store import State

log = logging.getLogger("quernstone")


class Status(str, Enum):
    CREATED = "CREATED"
    PLANNING = "PLANNING"
    RUNNING = "RUNNING"
    COMPLETED = "COMPLETED"
    FAILED = "FAILED"


def kind_of(definition: Any) -> str | None:
    """COPY or SELECT by what a definition holds; None if it is neither."""
    if not isinstance(definition, dict):
        return None
    if all(isinstance(definition.get(k), str) for k in ("sourceFilepath", "destinationTableName")):
        return "COPY"
    clauses = definition.get("columnClauses")
    return "SELECT" if isinstance(clauses, list) and clauses else None


def problem_of(error: Exception) -> list[Problem]:
    """What to tell about an exception, also one from a Spark job."""
    if isinstance(error, QueryError):
        return error.problems
    text = str(error)
    if BAD_CELL in text:
        return [Problem("Invalid Column Type", text.split(BAD_CELL, 1)[1].split("SQLSTATE")[0].strip()[:200])]
    if "MALFORMED_RECORD" in text or "Malformed records" in text:
        return [Problem("Invalid Column Type", "a row has fewer or more cells than the first one")]
    for sign, told in (
        ("DIVIDE_BY_ZERO", "Division by zero"),
        ("ARITHMETIC_OVERFLOW", "64-bit integer overflow"),
        ("BINARY_ARITHMETIC_OVERFLOW", "64-bit integer overflow"),
    ):
        if sign in text:
            return [Problem(told)]
    return [Problem("Unexpected error", text[:500])]


class Engine:
    """State is kept in `root`, a folder of the driver; rows are in `data` (by default the same), on any file system."""

    def __init__(self, spark: SparkSession, root: str | Path, workers: int = 4, data: str = ""):
        self.spark, self.root, self.data = spark, Path(root), data or str(root)
        self.catalog = Catalog(spark, self.root, self.data)
        self.queries = State(self.root / "queries.json")
        self.errors = State(self.root / "errors.json")
        self.pool = ThreadPoolExecutor(workers, thread_name_prefix="quernstone-query")

    # SELECT

    def plan(self, definition: dict[str, Any]) -> Plan:
        query: Select = parse_select(definition)
        name = table_of(query, [t.name for t in self.catalog.tables()])
        if name is None:
            return resolve(query, None, {})
        table = self.catalog.by_name(name)
        if table is None:
            raise QueryError(Problem(f"Table {name} does not exist", name))
        return resolve(query, name, table.types)

    def dataframe(self, plan: Plan) -> DataFrame:
        table = self.catalog.by_name(plan.table) if plan.table else None
        if plan.table and table is None:
            raise QueryError(Problem(f"Table {plan.table} does not exist", plan.table))
        source, columns = table.scan(self.spark) if table else (None, {})
        return build(self.spark, plan, source, columns)

    def select(self, definition: dict[str, Any]) -> DataFrame:
        """A SELECT as a lazy DataFrame of columns c0, c1, ..."""
        return self.dataframe(self.plan(definition))

    # COPY

    def copy(self, definition: dict[str, Any]) -> None:
        name = definition["destinationTableName"]
        header, destination = definition.get("doesCsvContainHeader", False), definition.get("destinationColumns") or []
        if not isinstance(header, bool):
            raise QueryError(Problem("doesCsvContainHeader must be a boolean"))
        if not isinstance(destination, list) or not all(isinstance(d, str) for d in destination):
            raise QueryError(Problem("destinationColumns must be a list of names"))
        table = self.catalog.by_name(name)
        if table is None or table.physical is not None:
            raise QueryError(Problem("Table not found", name))
        self.catalog.append(name, read_cells(self.spark, definition["sourceFilepath"], table.columns, header, destination))

    # queries and their results

    def _set(self, query_id: str, **values: Any) -> None:
        with self.queries.lock:
            state = self.queries.read()
            state[query_id] = state.get(query_id, {}) | values
            self.queries.write(state)

    def submit(self, definition: dict[str, Any]) -> tuple[str, Future]:
        """Registers a definition and starts it; the future ends with the problems, empty if it completed."""
        kind, query_id = kind_of(definition), new_id()
        if kind is None:
            raise QueryError("Invalid QueryType")
        self._set(query_id, kind=kind, status=Status.CREATED.value, definition=definition)
        return query_id, self.pool.submit(self._run, query_id, kind, definition)

    def _result(self, query_id: str) -> str:
        return f"{self.data}/results/{query_id}"

    def _run(self, query_id: str, kind: str, definition: dict[str, Any]) -> list[Problem]:
        try:
            self._set(query_id, status=Status.PLANNING.value)
            if kind == "COPY":
                self._set(query_id, status=Status.RUNNING.value)
                self.copy(definition)
            else:
                plan = self.plan(definition)
                self._set(query_id, status=Status.RUNNING.value, order=[list(o) for o in plan.order])
                self.dataframe(plan).write.option("compression", "zstd").parquet(self._result(query_id))
            self._set(query_id, status=Status.COMPLETED.value, result=kind == "SELECT")
            return []
        except Exception as error:  # every failure is a state of the query, told to the client
            problems = problem_of(error)
            log.info("query %s failed: %s", query_id, problems)
            with self.errors.lock:
                self.errors.write(self.errors.read() | {query_id: [p.to_json() for p in problems]})
            self._set(query_id, status=Status.FAILED.value)
            remove(self.spark, self._result(query_id))
            return problems

    def query(self, query_id: str) -> dict[str, Any] | None:
        return self.queries.read().get(query_id)

    def problems(self, query_id: str) -> list[dict[str, str]] | None:
        return self.errors.read().get(query_id)

    def result_frame(self, query_id: str, row_limit: int | None = None) -> DataFrame:
        """The stored result, in the query's order if it has one; row_limit counts if it is above 0.

        Rows that tie in the order are sorted by all their columns, so that each reading has one order.
        """
        record = self.query(query_id) or {}
        if not record.get("result"):
            raise QueryError("Result of this query is not available")
        rows = self.spark.read.parquet(self._result(query_id))
        order = [rows[f"c{i}"].asc() if up else rows[f"c{i}"].desc() for i, up in record.get("order", [])]
        rows = rows.orderBy(*order, *rows.columns) if order else rows
        return rows.limit(row_limit) if row_limit and row_limit > 0 else rows

    def flush(self, query_id: str) -> None:
        remove(self.spark, self._result(query_id))
        self._set(query_id, result=False)


