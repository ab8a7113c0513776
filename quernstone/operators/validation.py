"""Whether two tables hold the same columns and rows, and how rows look in print."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIFFERENT_VALUES = "has different values"


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """(place, column_name, problem) for whatever keeps two tables from being equal; no rows if nothing does.

    Columns are compared by place, rows as multisets: tables have no order. Reported are (place -1)
    another number of rows or columns, or rows that differ though each column's values are the same;
    and per column another name, another type, or values that differ; nulls equal nulls. One shuffle,
    pre-aggregated, for all columns' values, and one for whole rows.
    """
    spark = first.sparkSession
    found: list[tuple[int, str, str]] = []
    if len(first.columns) != len(second.columns):
        found.append((-1, "", "tables have different numbers of columns"))
    width = min(len(first.columns), len(second.columns))
    for i, (a, b) in enumerate(zip(first.schema.fields, second.schema.fields)):
        if a.name != b.name:
            found.append((i, a.name, f"expected name {a.name} but received {b.name}"))
        if a.dataType != b.dataType:
            found.append((i, a.name, f"expected type {a.dataType.simpleString()} but received {b.dataType.simpleString()}"))
    texts = [f"c{i}" for i in range(width)]
    sides = [t.toDF(*[f"c{i}" for i in range(len(t.columns))]).select(*[F.col(c).cast("string").alias(c) for c in texts]) for t in (first, second)]
    signed = sides[0].withColumn("sign", F.lit(1)).unionByName(sides[1].withColumn("sign", F.lit(-1)))
    counts = signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("more"))
    out = [
        spark.createDataFrame(found, "place int, column_name string, problem string"),
        counts.where("more <> 0").select(F.lit(-1).alias("place"), F.lit("").alias("column_name"), F.lit("tables have different numbers of rows").alias("problem")),
    ]
    if width:
        cells = F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).alias("value")) for i, c in enumerate(texts)])
        values = signed.select(F.explode(cells).alias("x"), "sign").groupBy("x").agg(F.sum("sign").alias("more")).where("more <> 0")
        names = F.array(*[F.lit(c) for c in first.columns[:width]])
        columns = values.select("x.place").distinct()
        out.append(columns.select("place", F.element_at(names, F.col("place") + 1).alias("column_name"), F.lit(DIFFERENT_VALUES).alias("problem")))
        rows = signed.groupBy(*texts).agg(F.sum("sign").alias("more")).where("more <> 0").limit(1)
        rows = rows.select(F.lit(-1).alias("place"), F.lit("").alias("column_name"), F.lit("rows differ").alias("problem"))
        out.append(rows)
    return reduce(DataFrame.unionByName, out)


def printed(table: DataFrame, rows: int = 20) -> str:
    """The table's size and up to `rows` of each column's values as text, strings in quotes."""
    held = table.limit(rows).collect()
    lines = [f"rows: {table.count()}, columns: {len(table.columns)}"]
    for i, name in enumerate(table.columns):
        values = ", ".join(f'"{r[i]}"' if isinstance(r[i], str) else str(r[i]) for r in held)
        lines.append(f"{name}: {values}")
    return "\n".join(lines)
