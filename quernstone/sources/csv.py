"""COPY from CSV: what a file looks like, and its cells as typed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.files import exists
from quernstone.problems import Problem, QueryError
from quernstone.types import Type

INTEGER = r"^[+-]?[0-9]+$"
BAD_CELL = "INVALID_CELL"
#: Stands for no string, so that empty cells aren't taken for missing ones.
NO_NULL = "\x00quernstone\x00"


@dataclass(frozen=True)
class Layout:
    separator: str
    names: list[str]
    multiline: bool


def sniff(spark: SparkSession, path: str, header: bool) -> Layout:
    """Separator (`;` where the first line that isn't empty has more of them than commas), columns, newlines.

    A line with an odd number of quotes means a cell with a newline in it; only then is a file read
    as a whole, else it is split among tasks at any line.
    """
    if not exists(spark, path):
        raise QueryError(Problem("The file at this path does not exist", path))
    lines = spark.read.text(path)
    first = lines.where(F.length("value") > 0).first()
    line = first[0] if first else ""
    separator = ";" if line.count(";") > line.count(",") else ","
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    multiline = bool(lines.where(quotes % 2 == 1).take(1))
    reader = spark.read.options(header=False, sep=separator, quote='"', escape='"', multiLine=multiline)
    head = reader.csv(path).first()
    names = [c or "" for c in head] if head else []
    if not header:
        names = [f"column {i}" for i in range(len(names))]
    return Layout(separator, names, multiline)


def mapping(layout: Layout, table: list[tuple[str, Type]], header: bool, destination: list[str]) -> list[int]:
    """For each table column the place of its cell in a row of the file.

    With destination columns: by header name, or without a header in the order listed; they must be
    all of the table's columns. Without: by place, header or not.
    """
    names = [n for n, _ in table]
    if not destination:
        places = list(range(len(names)))
    else:
        unknown = [d for d in destination if d not in names or header and d not in layout.names]
        if unknown:
            raise QueryError(*[Problem("Invalid destination column", d) for d in unknown])
        if len(set(destination)) != len(destination) or set(destination) != set(names):
            missing = [n for n in names if n not in destination] or destination
            raise QueryError(Problem("Destination columns must be each of the table's columns once", ", ".join(missing)))
        order = [layout.names.index(d) for d in destination] if header else list(range(len(destination)))
        places = [order[destination.index(n)] for n in names]
    if layout.names and max(places) >= len(layout.names):
        raise QueryError(
            Problem("Actual and expected number of columns are different", f"{len(layout.names)} in the file, {len(names)} in the table")
        )
    return places


def cell(column: Column, kind: Type, name: str) -> Column:
    """A typed cell; one that isn't an integer of 64 bits ends the job that reads it."""
    text = F.coalesce(column, F.lit(""))
    if kind == Type.VARCHAR:
        return text
    number = F.when(text.rlike(INTEGER), text.try_cast("bigint"))
    return F.coalesce(number, F.raise_error(F.concat(F.lit(f"{BAD_CELL} {name}: "), text)).cast("bigint"))


def read_cells(
    spark: SparkSession, path: str, table: list[tuple[str, Type]], header: bool = False, destination: list[str] | None = None
) -> DataFrame:
    """The file as columns f0, f1, ... in the table's order and types, in one pass and without a shuffle.

    Rows with fewer or more cells than the first end the job, as does a bad cell. All cells are parsed
    for that, also those that the table doesn't take. An empty file has no rows.
    """
    layout = sniff(spark, path, header)
    places = mapping(layout, table, header, destination or [])
    if not layout.names:
        return spark.createDataFrame([], T.StructType([T.StructField(f"f{i}", k.spark) for i, (_, k) in enumerate(table)]))
    cells = spark.read.option("columnPruning", False).schema(T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(layout.names))])).csv(
        path, header=header, sep=layout.separator, quote='"', escape='"', multiLine=layout.multiline, mode="FAILFAST",
        nullValue=NO_NULL, emptyValue="",
    )
    return cells.select(*[cell(F.col(f"_{p}"), kind, name).alias(f"f{i}") for i, ((name, kind), p) in enumerate(zip(table, places))])
