"""The engine's requests: one method per route, each giving a status code and a JSON body."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from quernstone import __version__
from quernstone.catalog import table_request
from quernstone.engine import Engine, Status
from quernstone.problems import Problem, QueryError, problems_json

Reply = tuple[int, Any]
INTERFACE = "2.0"
LARGEST_ID = 2**64 - 1


def _message(text: str) -> dict[str, str]:
    return {"message": text}


def valid_id(text: str) -> bool:
    return text.isascii() and text.isdigit() and int(text) <= LARGEST_ID


class Api:
    def __init__(self, engine: Engine, author: str = "quernstone"):
        self.engine, self.author, self.began = engine, author, time.monotonic()

    @staticmethod
    def parse(body: str | bytes) -> Any:
        try:
            return json.loads(body)
        except ValueError as error:
            text = body.decode(errors="replace") if isinstance(body, bytes) else body
            raise QueryError(Problem(f"JSON parse error: {error}", text[:1000])) from None

    # tables

    def get_tables(self) -> Reply:
        return 200, [{"tableId": t.id, "name": t.name} for t in self.engine.catalog.tables()]

    def get_table(self, table_id: str) -> Reply:
        if not valid_id(table_id):
            return 404, _message(f"tableId {table_id} is incorrect")
        table = self.engine.catalog.by_id(table_id)
        return (200, table.to_json()) if table else (404, _message(f"Table with id {table_id} not found"))

    def put_table(self, body: Any) -> Reply:
        try:
            return 200, self.engine.catalog.create(*table_request(body)).id
        except QueryError as error:
            return 400, problems_json(error.problems)

    def delete_table(self, table_id: str) -> Reply:
        if not valid_id(table_id):
            return 404, _message(f"tableId {table_id} is incorrect")
        return (200, "") if self.engine.catalog.drop(table_id) else (404, _message(f"Table with id {table_id} not found"))

    # queries

    def get_queries(self) -> Reply:
        return 200, [{"queryId": i, "status": q["status"]} for i, q in self.engine.queries.read().items()]

    def post_query(self, body: Any, wait: bool = True) -> Reply:
        """With wait the query has ended when the reply comes, and a failed one replies 400; without, it is polled."""
        try:
            query_id, done = self.engine.submit(body.get("queryDefinition") if isinstance(body, dict) else None)
        except QueryError as error:
            return 400, problems_json(error.problems)
        problems = done.result() if wait else []
        return (400, problems_json(problems)) if problems else (200, query_id)

    def _find(self, query_id: str) -> dict[str, Any] | Reply:
        if not valid_id(query_id):
            return 404, _message(f"queryId {query_id} is incorrect")
        return self.engine.query(query_id) or (404, _message("Query with this id not found"))

    def get_query(self, query_id: str) -> Reply:
        found = self._find(query_id)
        if isinstance(found, tuple):
            return found
        available = found["status"] == Status.COMPLETED.value and bool(found.get("result"))
        return 200, {
            "queryId": query_id,
            "status": found["status"],
            "isResultAvailable": available,
            "queryDefinition": found["definition"],
        }

    def get_result(self, query_id: str, body: Any = None, stream: bool = False) -> Reply:
        """The result by columns; with `stream` a body of any size comes as an iterator of pieces of its JSON."""
        found = self._find(query_id)
        if isinstance(found, tuple):
            return found
        options = body if isinstance(body, dict) else {}
        limit, flush = options.get("rowLimit"), options.get("flushResult") is True
        if not isinstance(limit, int) or isinstance(limit, bool):
            limit = None
        try:
            rows = self.engine.result_frame(query_id, limit)
        except QueryError as error:
            return 400, _message(error.problems[0].error)
        if stream and not (limit and limit > 0):  # a limited one is read at once, as its rows may be others each time
            return 200, self._pieces(query_id, rows, flush)
        columns = [c.to_pylist() for c in rows.toArrow().columns]
        count = len(columns[0]) if columns else 0
        if flush:
            self.engine.flush(query_id)
        return 200, [{"rowCount": count, "columns": columns}] if count else []

    def _pieces(self, query_id: str, rows: DataFrame, flush: bool) -> Iterator[str]:
        """One pass for each column, a partition of it at a time, over rows that have the same order each time."""
        count = rows.count()
        if not count:
            yield "[]"
        else:
            yield f'[{{"rowCount": {count}, "columns": ['
            for i, name in enumerate(rows.columns):
                yield ", [" if i else "["
                for k, (value,) in enumerate(rows.select(name).toLocalIterator()):
                    yield (", " if k else "") + json.dumps(value, ensure_ascii=False)
                yield "]"
            yield "]}]"
        if flush:
            self.engine.flush(query_id)

    def get_error(self, query_id: str) -> Reply:
        found = self._find(query_id)
        if isinstance(found, tuple):
            return found
        problems = self.engine.problems(query_id)
        if found["status"] != Status.FAILED.value or problems is None:
            return 400, _message("Error for this query is not available")
        return 200, {"problems": problems}

    def system_info(self) -> Reply:
        return 200, {
            "interfaceVersion": INTERFACE,
            "version": __version__,
            "author": self.author,
            "uptime": int(time.monotonic() - self.began),
            "sparkVersion": self.engine.spark.version,
        }
