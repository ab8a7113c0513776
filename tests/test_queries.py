"""Every registered engine query against its SQL, plans that scan no more than they need, statistics."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone import catalogue

DATA = "/root/testdata/sf0.001"


def same(rows, sql):
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    got = rows.select(*names).collect()
    assert sorted(rows.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_sql(spark, name):
    same(catalogue.QUERIES[name](spark, DATA), catalogue.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filters_pushed(spark):
    text = plan(catalogue.QUERIES["filter_wide"](spark, DATA))
    assert "PushedFilters: [IsNotNull" in text and "EqualTo(l_returnflag,N)" in text
    assert "l_extendedprice" not in text and "Exchange" not in text
    text = plan(catalogue.QUERIES["flagship"](spark, DATA))
    assert "TakeOrderedAndProject" in text and "GreaterThan(o_orderkey,100)" in text and "o_custkey" not in text


def test_constants_are_folded(spark):
    assert "7 AS i" in catalogue.QUERIES["tableless"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_mean_of_nothing_is_nan_and_sums_do_not_overflow(spark):
    from pyspark.sql import functions as F

    from quernstone.operators.statistics import byte_frequency, mean

    assert math.isnan(spark.range(0).agg(mean(F.col("id"))).first()[0])
    big = spark.createDataFrame([(2**63 - 1,)] * 3, "id long")
    assert big.agg(mean(F.col("id"))).first()[0] == float(2**63 - 1)
    words = spark.createDataFrame([("ał",), ("a",), ("",)], "s string")
    assert sorted(map(tuple, byte_frequency(words, "s").collect())) == [(0x61, 2), (0x82, 1), (0xC5, 1)]


def test_statistics_of_odd_tables(spark):
    from quernstone.operators.statistics import table_statistics

    rows = [(2**63 - 1, "ał", None, 1.5), (2**63 - 1, None, None, None), (-(2**63), "", None, 2.5)]
    table = spark.createDataFrame(rows, "n long, `s t` string, none int, out double")
    got = {(r.column_name, r.byte): (r.n, r["mean"]) for r in table_statistics(table.repartition(2)).collect()}
    assert got == {("n", None): (3, (2**63 - 2) / 3), ("s t", 0x61): (1, None), ("s t", 0xC5): (1, None), ("s t", 0x82): (1, None)}
    assert table_statistics(table.limit(0)).count() == 0


def test_differences(spark):
    from quernstone.operators.validation import differences, printed

    rows = [(1, "a", None), (1, "a", None), (2, "b", "x")]
    table = spark.createDataFrame(rows, "i long, s string, x string")
    assert differences(table, table.orderBy(F.desc("i"))).count() == 0
    got = lambda other: sorted((r.place, r.problem) for r in differences(table, other).collect())
    swapped = spark.createDataFrame([(1, "b", None), (1, "a", None), (2, "a", "x")], "i long, s string, x string")
    assert got(swapped) == [(-1, "rows differ")]
    assert got(table.where("i = 2")) == [
        (-1, "rows differ"), (-1, "tables have different numbers of rows"), (0, "has different values"), (1, "has different values"), (2, "has different values")
    ]
    assert (-1, "tables have different numbers of columns") in got(table.drop("x"))
    assert (0, "expected type bigint but received int") in got(table.withColumn("i", F.col("i").cast("int")))
    assert printed(table, 2) == 'rows: 3, columns: 3\ni: 1, 1\ns: "a", "a"\nx: None, None'
