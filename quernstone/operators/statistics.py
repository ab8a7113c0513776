"""Statistics of stored columns: the mean of integers and the byte counts of strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.types import READABLE, Type


def mean(column: Column) -> Column:
    """Exact 128-bit sum over count, as double; NaN for no rows."""
    total = F.sum(column.cast("decimal(38,0)")).cast("double")
    return F.when(F.count(column) > 0, total / F.count(column)).otherwise(F.lit(float("nan")))


def _tally(batches: Iterator[pa.RecordBatch], integers: list[int]) -> Iterator[pa.RecordBatch]:
    """Per column of the task: sums and counts of integers in two halves of 32 bits, counts of bytes of strings."""
    width = 0
    sums: dict[int, list[int]] = {}
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        width = batch.num_columns
        for place, column in enumerate(batch.columns):
            if place in integers:
                values = column.drop_null().to_numpy()
                total = sums.setdefault(place, [0, 0, 0])
                total[0] += len(values)
                total[1] += int((values >> 32).sum())
                total[2] += int((values & 0xFFFFFFFF).sum())
            elif len(column):
                _, offsets, data = column.buffers()
                kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
                ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
                if data is not None and ends[-1] > ends[0]:
                    found = np.bincount(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], minlength=256)
                    counts[place] = counts.get(place, 0) + found
    rows = [(place, None, *total) for place, total in sums.items()]
    rows += [(place, int(b), int(n[b]), 0, 0) for place, n in counts.items() for b in np.flatnonzero(n)]
    if width:
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["place", "byte", "n", "high", "low"])


def table_statistics(table: DataFrame) -> DataFrame:
    """(column_name, byte, n, mean) of all integer and string columns, in one pass over the table.

    An integer column has one row: its values and their exact mean (byte is null). A string column has
    one row for each byte that occurs in its UTF-8 (mean is null). Other columns are left out; nulls
    count nowhere; a column without values, or bytes, has no row. Tasks tally Arrow buffers, so what is
    shuffled is 256 rows a column and task at most.
    """
    kept = [f for f in table.schema.fields if type(f.dataType) in READABLE]
    integers = [i for i, f in enumerate(kept) if READABLE[type(f.dataType)] == Type.INT64]
    columns = [F.col(f"`{f.name}`").cast("bigint" if i in integers else "string").alias(f"c{i}") for i, f in enumerate(kept)]
    schema = "place int, byte bigint, n bigint, high bigint, low bigint"
    found = table.select(*columns).mapInArrow(lambda it: _tally(it, integers), schema)
    total = F.sum(F.col("high").cast("decimal(38,0)")) * 2**32 + F.sum(F.col("low").cast("decimal(38,0)"))
    sums = found.groupBy("place", "byte").agg(F.sum("n").alias("n"), total.cast("double").alias("total")).where("n > 0")
    names = F.array(*[F.lit(f.name) for f in kept])
    mean_of = F.when(F.col("byte").isNull(), F.col("total") / F.col("n"))
    return sums.select(F.element_at(names, F.col("place") + 1).alias("column_name"), "byte", "n", mean_of.alias("mean"))


def byte_frequency(table: DataFrame, column: str) -> DataFrame:
    """(byte, n): how often each byte occurs in the UTF-8 of a string column."""
    return table_statistics(table.select(F.col(f"`{column}`").cast("string").alias("s"))).select("byte", "n")
