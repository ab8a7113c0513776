"""Checked SELECT plans as lazy DataFrames; Catalyst prunes columns, pushes filters and picks top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.scalar import to_column
from quernstone.plans.select import Plan


def build(spark: SparkSession, plan: Plan, source: DataFrame | None, columns: dict[str, Column]) -> DataFrame:
    """Result columns c0, c1, ... in the order of the projections.

    source: the table, with `columns` by logical name; None for a query over no table, which has one
    row. Rows have no order but that of ORDER BY, whose ties are in no order either.
    """
    rows = spark.range(1) if source is None else source
    query = plan.query
    if query.where is not None:
        rows = rows.where(to_column(query.where, columns))
    rows = rows.select(*[to_column(p, columns).alias(f"c{i}") for i, p in enumerate(query.projections)])
    if plan.order:
        rows = rows.orderBy(*sort_keys(plan))
    return rows if query.limit is None else rows.limit(query.limit)


def sort_keys(plan: Plan) -> list[Column]:
    return [F.col(f"c{i}").asc() if up else F.col(f"c{i}").desc() for i, up in plan.order]
