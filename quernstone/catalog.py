"""Tables: names, typed columns, and the Parquet folders that are committed to them."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.files import remove
from quernstone.problems import Problem, QueryError
from quernstone.store import State
from quernstone.types import READABLE, STORED, Type


def new_id() -> str:
    return str(secrets.randbits(64))


@dataclass
class Table:
    id: str
    name: str
    columns: list[tuple[str, Type]]
    location: str = ""
    files: list[str] = field(default_factory=list)
    #: Physical names for a table that was attached; stored tables use f0, f1, ...
    physical: list[str] | None = None

    @property
    def types(self) -> dict[str, Type]:
        return dict(self.columns)

    def to_json(self) -> dict[str, Any]:
        return {"name": self.name, "columns": [{"name": n, "type": t.value} for n, t in self.columns]}

    def scan(self, spark: SparkSession) -> tuple[DataFrame, dict[str, Column]]:
        """The committed rows, and each column by its logical name."""
        physical = self.physical or [f"f{i}" for i in range(len(self.columns))]
        if self.physical:
            rows = spark.read.parquet(*self.files)
        else:
            schema = T.StructType([T.StructField(p, t.spark) for p, (_, t) in zip(physical, self.columns)])
            rows = spark.read.schema(schema).parquet(*self.files) if self.files else spark.createDataFrame([], schema)
        columns = {}
        for name, (logical, kind) in zip(physical, self.columns):
            column = F.col(f"`{name}`")
            same = rows.schema[name].dataType == kind.spark
            columns[logical] = column if same else column.cast(kind.spark)
        return rows, columns


def table_request(body: Any) -> tuple[str, list[tuple[str, Type]]]:
    """Name and columns of a request to create a table, in its present or its older form; all problems together."""
    if not isinstance(body, dict):
        raise QueryError("Invalid create table request")
    if isinstance(body.get("name"), str) and isinstance(body.get("columns"), list):
        name, raw = body["name"], body["columns"]
        columns = [(c.get("name"), c.get("type")) if isinstance(c, dict) else (None, None) for c in raw]
    else:
        name, inner = next(iter(body.items()), ("", None))
        if not isinstance(inner, dict) or not isinstance(inner.get("columns"), dict):
            raise QueryError("Missing required fields: name and columns")
        columns = list(inner["columns"].items())
    problems: list[Problem] = []
    if not name:
        problems.append(Problem("Invalid table name: empty"))
    if not columns:
        problems.append(Problem("Invalid columns: empty"))
    seen: set[str] = set()
    for column, kind in columns:
        if not isinstance(column, str) or not isinstance(kind, str):
            problems.append(Problem("Invalid column definition"))
            continue
        if not column:
            problems.append(Problem("Invalid column name: empty"))
        if column in seen:
            problems.append(Problem(f"Duplicate column name: {column}"))
        seen.add(column)
        if kind not in [t.value for t in STORED]:
            problems.append(Problem(f"column {column} has invalid type, it should be VARCHAR or INT64", kind))
    if problems:
        raise QueryError(*problems)
    return name, [(c, Type(k)) for c, k in columns]


class Catalog:
    """Tables by name in a state file below `root`, a folder of the driver; rows as zstd Parquet below `data`.

    `data` is a folder of any file system that all executors reach; where it is not given, it is `root`.
    """

    def __init__(self, spark: SparkSession, root: str | Path, data: str = ""):
        self.spark, self.root, self.data = spark, Path(root), data or str(root)
        self.state = State(self.root / "catalog.json")

    @staticmethod
    def _table(name: str, entry: dict[str, Any]) -> Table:
        columns = [(n, Type(t)) for n, t in entry["columns"]]
        return Table(entry["id"], name, columns, entry["location"], list(entry["files"]), entry.get("physical"))

    def tables(self) -> list[Table]:
        return [self._table(n, e) for n, e in self.state.read().items()]

    def by_name(self, name: str) -> Table | None:
        entry = self.state.read().get(name)
        return self._table(name, entry) if entry else None

    def by_id(self, table_id: str) -> Table | None:
        return next((t for t in self.tables() if t.id == table_id), None)

    def create(self, name: str, columns: list[tuple[str, Type]], **more: Any) -> Table:
        with self.state.lock:
            state = self.state.read()
            if name in state:
                raise QueryError(f"Table with name {name} already exists")
            entry = {"id": new_id(), "columns": [[n, t.value] for n, t in columns], "location": "", "files": []} | more
            state[name] = entry
            self.state.write(state)
            return self._table(name, entry)

    def attach(self, name: str, path: str) -> Table:
        """A table over existing Parquet; columns outside the data model are left out, and none is written."""
        fields = [(f.name, READABLE[type(f.dataType)]) for f in self.spark.read.parquet(path).schema if type(f.dataType) in READABLE]
        return self.create(name, fields, files=[path], physical=[n for n, _ in fields])

    def drop(self, table_id: str) -> bool:
        with self.state.lock:
            table = self.by_id(table_id)
            if table is None:
                return False
            state = self.state.read()
            del state[table.name]
            self.state.write(state)
            if table.physical is None and table.location:
                remove(self.spark, table.location)
            return True

    def append(self, name: str, rows: DataFrame) -> None:
        """Writes rows to a folder of their own and then commits it: seen as a whole or not at all."""
        table = self.by_name(name)
        if table is None:
            raise QueryError(Problem("Table not found", name))
        location = f"{self.data}/tables/{table.id}"
        part = f"{location}/part-{new_id()}"
        try:
            rows.write.option("compression", "zstd").parquet(part)
            with self.state.lock:
                state = self.state.read()
                if state.get(name, {}).get("id") != table.id:
                    raise QueryError(Problem("Table not found", name))
                state[name]["location"] = location
                state[name]["files"].append(part)
                self.state.write(state)
        except BaseException:
            remove(self.spark, part)
            raise
