"""Queries over the test tables that show every operator, as definitions of the engine's own language.

Each comes with names for its result columns and with DuckDB SQL that gives the same rows.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.engine import Engine
from quernstone.files import scratch
from quernstone.operators.statistics import byte_frequency, mean, table_statistics
from quernstone.operators.validation import differences

Query = Callable[[SparkSession, str], DataFrame]


def col(name: str) -> dict:
    return {"columnName": name}


def of(table: str, name: str) -> dict:
    return {"tableName": table, "columnName": name}


def lit(value: object) -> dict:
    return {"value": value}


def op(operator: str, left: dict, right: dict | None = None) -> dict:
    if right is None:
        return {"operator": operator, "operand": left}
    return {"operator": operator, "leftOperand": left, "rightOperand": right}


def fn(name: str, *arguments: dict) -> dict:
    return {"functionName": name, "arguments": list(arguments)}


def new_engine(spark: SparkSession) -> Engine:
    """An engine whose rows are in a shared scratch folder; its state is there too where the driver can open that."""
    data = scratch(spark)
    local = data.startswith("file:")
    return Engine(spark, Path(data.removeprefix("file:")) if local else Path(tempfile.mkdtemp(prefix="quernstone-state-")), data=data)


def engine_over(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    engine = new_engine(spark)
    for table in tables:
        engine.catalog.attach(table, f"{sf_dir}/{table}.parquet")
    return engine


def run_select(spark: SparkSession, sf_dir: str, *, tables: tuple[str, ...], names: str, definition: dict) -> DataFrame:
    return engine_over(spark, sf_dir, *tables).select(definition).toDF(*names.split())


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, table: str, names: str, columns: list[dict], sql: str, **clauses: object) -> None:
    definition = {"columnClauses": columns} | clauses
    QUERIES[name] = partial(run_select, tables=(table,) if table else (), names=names, definition=definition)
    SQL[name] = sql


ASCII = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
NOT_F = op("NOT", op("EQUAL", col("o_orderstatus"), lit("F")))
FLAGSHIP = {
    "columnClauses": [
        of("orders", "o_orderkey"),
        of("orders", "o_orderpriority"),
        fn("CONCAT", of("orders", "o_orderstatus"), fn("CONCAT", lit("/"), of("orders", "o_orderpriority"))),
    ],
    "whereClause": op("AND", op("GREATER_THAN", of("orders", "o_orderkey"), lit(100)), NOT_F),
    "orderByClause": [{"columnIndex": 1, "ascending": False}, {"columnIndex": 0, "ascending": True}],
    "limitClause": {"limit": 10},
}
FLAGSHIP_NAMES = "o_orderkey o_orderpriority tag"
add(
    "flagship", "orders", FLAGSHIP_NAMES, FLAGSHIP["columnClauses"],
    "SELECT o_orderkey, o_orderpriority, o_orderstatus || '/' || o_orderpriority AS tag FROM orders "
    "WHERE o_orderkey > 100 AND NOT (o_orderstatus = 'F') ORDER BY o_orderpriority DESC, o_orderkey LIMIT 10",
    **{k: v for k, v in FLAGSHIP.items() if k != "columnClauses"},
)
add("scan_project", "nation", "n_nationkey n_name", [of("nation", "n_nationkey"), of("nation", "n_name")],
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
add("literal", "orders", "o_orderkey i s b", [of("orders", "o_orderkey"), lit(7), lit("x"), lit(True)],
    "SELECT o_orderkey, CAST(7 AS BIGINT) AS i, 'x' AS s, true AS b FROM orders")
add("tableless", "", "i s b", [op("ADD", lit(1), op("MULTIPLY", lit(2), lit(3))), fn("CONCAT", lit("a"), lit("b")), lit(True)],
    "SELECT CAST(1 + 2 * 3 AS BIGINT) AS i, 'a' || 'b' AS s, true AS b")
add("tableless_where_limit", "", "i", [lit(1)], "SELECT CAST(1 AS BIGINT) AS i WHERE false LIMIT 1",
    whereClause=lit(False), limitClause={"limit": 1})
for _name, _operator, _sign in (("add", "ADD", "+"), ("sub", "SUBTRACT", "-"), ("mul", "MULTIPLY", "*")):
    add(_name, "orders", "o_orderkey v", [of("orders", "o_orderkey"), op(_operator, col("o_custkey"), col("o_orderkey"))],
        f"SELECT o_orderkey, o_custkey {_sign} o_orderkey AS v FROM orders")
add("div", "orders", "o_orderkey v",
    [of("orders", "o_orderkey"), op("DIVIDE", op("SUBTRACT", col("o_custkey"), col("o_orderkey")), lit(7))],
    "SELECT o_orderkey, (o_custkey - o_orderkey) // 7 AS v FROM orders")
add("minus", "orders", "o_orderkey v", [of("orders", "o_orderkey"), op("MINUS", col("o_orderkey"))],
    "SELECT o_orderkey, -o_orderkey AS v FROM orders")
COMPARE = (("EQUAL", "="), ("NOT_EQUAL", "<>"), ("LESS_THAN", "<"), ("LESS_EQUAL", "<="), ("GREATER_THAN", ">"), ("GREATER_EQUAL", ">="))
SIX = "eq ne lt le gt ge"


def compare(left: dict, right: dict) -> list[dict]:
    return [op(o, left, right) for o, _ in COMPARE]


def compare_sql(left: str, right: str) -> str:
    return ", ".join(f"({left}) {sign} ({right}) AS {name}" for (_, sign), name in zip(COMPARE, SIX.split()))


add("cmp_int", "orders", "o_orderkey " + SIX, [of("orders", "o_orderkey"), *compare(col("o_custkey"), lit(500))],
    f"SELECT o_orderkey, {compare_sql('o_custkey', '500')} FROM orders")
add("cmp_str", "part", "p_partkey " + SIX, [of("part", "p_partkey"), *compare(col("p_type"), col("p_name"))],
    f"SELECT p_partkey, {compare_sql('p_type', 'p_name')} FROM part")
add("cmp_bool", "part", "p_partkey " + SIX,
    [of("part", "p_partkey"), *compare(op("GREATER_THAN", col("p_size"), lit(25)), op("LESS_THAN", col("p_partkey"), lit(1000)))],
    f"SELECT p_partkey, {compare_sql('p_size > 25', 'p_partkey < 1000')} FROM part")
add("and_or_not", "orders", "o_orderkey o_orderstatus", [of("orders", "o_orderkey"), of("orders", "o_orderstatus")],
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderkey > 100 AND NOT (o_orderstatus = 'F')) OR o_custkey < 10",
    whereClause=op("OR", op("AND", op("GREATER_THAN", col("o_orderkey"), lit(100)), NOT_F), op("LESS_THAN", col("o_custkey"), lit(10))))
add("strlen", "documents", "doc_id n", [of("documents", "doc_id"), fn("STRLEN", col("text"))],
    "SELECT doc_id, strlen(text) AS n FROM documents")
add("concat", "customer", "c_custkey v", [of("customer", "c_custkey"), fn("CONCAT", col("c_name"), col("c_mktsegment"))],
    "SELECT c_custkey, c_name || c_mktsegment AS v FROM customer")
add("replace", "part", "p_partkey v w",
    [of("part", "p_partkey"), fn("REPLACE", col("p_type"), lit("E"), lit("__")), fn("REPLACE", col("p_type"), lit(""), lit("x"))],
    "SELECT p_partkey, replace(p_type, 'E', '__') AS v, p_type AS w FROM part")
add("upper", "documents", "doc_id v", [of("documents", "doc_id"), fn("UPPER", col("text"))],
    f"SELECT doc_id, translate(text, {ASCII}) AS v FROM documents")
add("lower", "documents", "doc_id v", [of("documents", "doc_id"), fn("LOWER", col("text"))],
    f"SELECT doc_id, translate(text, {', '.join(reversed(ASCII.split(', ')))}) AS v FROM documents")
add("order_limit", "orders", "o_orderkey o_orderpriority", [of("orders", "o_orderkey"), of("orders", "o_orderpriority")],
    "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 25",
    orderByClause=[{"columnName": "o_orderpriority", "direction": "DESC"}, {"columnIndex": 0}], limitClause={"limit": 25})
add("order_bool", "part", "big p_partkey", [op("GREATER_THAN", of("part", "p_size"), lit(25)), col("p_partkey")],
    "SELECT p_size > 25 AS big, p_partkey FROM part ORDER BY big DESC, p_partkey LIMIT 40",
    orderByClauses=[{"columnIndex": 0, "ascending": False}, {"columnIndex": 1}], limitClause={"limit": 40})
add("limit0", "orders", "o_orderkey", [of("orders", "o_orderkey")], "SELECT o_orderkey FROM orders LIMIT 0",
    limitClause={"limit": 0})
_SUM = op("ADD", col("o_custkey"), col("o_orderkey"))
add("cse", "orders", "v w o_orderkey", [_SUM, op("ADD", col("o_orderkey"), col("o_custkey")), of("orders", "o_orderkey")],
    "SELECT o_custkey + o_orderkey AS v, o_orderkey + o_custkey AS w, o_orderkey FROM orders WHERE o_custkey + o_orderkey > 1000",
    whereClause=op("GREATER_THAN", _SUM, lit(1000)))
add("single_column_scan", "lineitem", "l_returnflag", [of("lineitem", "l_returnflag")], "SELECT l_returnflag FROM lineitem")
add("filter_wide", "lineitem", "l_orderkey l_linenumber code",
    [of("lineitem", "l_orderkey"), of("lineitem", "l_linenumber"), fn("LOWER", fn("CONCAT", col("l_returnflag"), col("l_linestatus")))],
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, lower(l_returnflag || l_linestatus) AS code FROM lineitem "
    "WHERE l_suppkey * 2 < l_partkey AND l_returnflag <> 'N'",
    whereClause=op("AND", op("LESS_THAN", op("MULTIPLY", col("l_suppkey"), lit(2)), col("l_partkey")),
                   op("NOT_EQUAL", col("l_returnflag"), lit("N"))))
add("top_k", "lineitem", "l_partkey l_orderkey l_linenumber",
    [of("lineitem", "l_partkey"), col("l_orderkey"), col("l_linenumber")],
    "SELECT l_partkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem "
    "ORDER BY l_partkey DESC, l_orderkey, l_linenumber LIMIT 100",
    orderByClause=[{"columnIndex": 0, "ascending": False}, {"columnIndex": 1}, {"columnIndex": 2}], limitClause={"limit": 100})


def mean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(mean(F.col("l_partkey")).alias("mean"))


def byte_freq_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_frequency(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")


QUERIES |= {"mean": mean_query, "byte_freq": byte_freq_query}
SQL |= {
    "mean": "SELECT avg(l_partkey) AS mean FROM lineitem",
    "byte_freq": "SELECT CAST('0x' || pair AS BIGINT) AS byte, count(*) AS n FROM "
    "(SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS pair FROM documents) GROUP BY ALL",
}

COPIED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
COPIED_SQL = f"SELECT {', '.join(COPIED)} FROM orders"
COPIED_COLUMNS = [{"name": n, "type": "VARCHAR" if n in COPIED[2:] else "INT64"} for n in COPIED]


def copied(spark: SparkSession, sf_dir: str, times: int = 1, separator: str = ",", destination: tuple[str, ...] = ()) -> tuple[Engine, list[str]]:
    """An engine whose table `copied` holds the orders, written as CSV and copied `times` times."""
    from quernstone.api import Api

    engine = new_engine(spark)
    order = list(destination or COPIED)
    path = f"{engine.data}/orders.csv"
    spark.read.parquet(f"{sf_dir}/orders.parquet").select(*order).write.csv(path, header=True, sep=separator)
    api = Api(engine)
    problems = [api.put_table({"name": "copied", "columns": COPIED_COLUMNS})]
    for _ in range(times):
        definition = {"sourceFilepath": path, "destinationTableName": "copied", "doesCsvContainHeader": True}
        problems.append(api.post_query({"queryDefinition": definition | ({"destinationColumns": order} if destination else {})}))
    failed = [p for p in problems if p[0] != 200]
    if failed:
        raise RuntimeError(str(failed))
    return engine, [p[1] for p in problems]


def copy_query(spark: SparkSession, sf_dir: str, **how: object) -> DataFrame:
    engine, _ = copied(spark, sf_dir, **how)
    return engine.select({"columnClauses": [of("copied", c) for c in COPIED]}).toDF(*COPIED)


QUERIES |= {
    "copy_csv": copy_query,
    "copy_append": partial(copy_query, times=2),
    "copy_semicolon": partial(copy_query, separator=";"),
    "copy_destination_columns": partial(copy_query, destination=tuple(reversed(COPIED))),
}
SQL |= {
    "copy_csv": COPIED_SQL,
    "copy_append": f"{COPIED_SQL} UNION ALL {COPIED_SQL}",
    "copy_semicolon": COPIED_SQL,
    "copy_destination_columns": COPIED_SQL,
}


def result_query(spark: SparkSession, sf_dir: str, row_limit: int | None = None) -> DataFrame:
    """A SELECT that is submitted, stored and fetched, in order."""
    engine = engine_over(spark, sf_dir, "orders")
    clauses = [of("orders", "o_orderkey"), of("orders", "o_orderpriority")]
    order = [{"columnIndex": 1}, {"columnIndex": 0, "ascending": False}]
    query_id, done = engine.submit({"columnClauses": clauses, "orderByClause": order, "limitClause": {"limit": 500}})
    if done.result():
        raise RuntimeError(str(done.result()))
    return engine.result_frame(query_id, row_limit).toDF("o_orderkey", "o_orderpriority")


RESULT_SQL = "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey DESC LIMIT {}"
QUERIES |= {"result_fetch": result_query, "result_row_limit": partial(result_query, row_limit=20)}
SQL |= {"result_fetch": RESULT_SQL.format(500), "result_row_limit": RESULT_SQL.format(20)}


def lines_file(engine: Engine, name: str, lines: list[str]) -> str:
    """A CSV file of these lines among the engine's data."""
    path = f"{engine.data}/{name}.csv"
    engine.spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(path)
    return path


def lifecycle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes' status codes over the life of a table, its queries and their results."""
    from quernstone.api import Api

    engine = new_engine(spark)
    api = Api(engine)
    steps: list[tuple[str, int]] = []

    def step(name: str, reply: tuple) -> object:
        steps.append((name, reply[0]))
        return reply[1]

    table = {"name": "t", "columns": [{"name": "id", "type": "INT64"}]}
    table_id = step("create", api.put_table(table))
    step("create_again", api.put_table(table))
    step("create_bool", api.put_table({"name": "b", "columns": [{"name": "x", "type": "BOOL"}]}))
    step("describe", api.get_table(table_id))
    step("describe_unknown", api.get_table("1"))
    good, bad = lines_file(engine, "good", ["1", "2"]), lines_file(engine, "bad", ["1", "x"])
    copy = lambda path: {"queryDefinition": {"sourceFilepath": path, "destinationTableName": "t"}}
    step("copy", api.post_query(copy(good)))
    step("copy_bad", api.post_query(copy(bad)))
    failed = [q["queryId"] for q in api.get_queries()[1] if q["status"] == "FAILED"][0]
    step("error", api.get_error(failed))
    query_id = step("select", api.post_query({"queryDefinition": {"columnClauses": [of("t", "id")]}}))
    step("query", api.get_query(query_id))
    step("error_of_completed", api.get_error(query_id))
    step("result", api.get_result(query_id, {"rowLimit": 1, "flushResult": True}))
    step("result_flushed", api.get_result(query_id))
    step("select_missing_table", api.post_query({"queryDefinition": {"columnClauses": [of("u", "id")]}}))
    step("invalid", api.post_query({"queryDefinition": {}}))
    step("tables", api.get_tables())
    step("info", api.system_info())
    step("drop", api.delete_table(table_id))
    step("drop_again", api.delete_table(table_id))
    return spark.createDataFrame([(n, s) for n, s in steps], "step string, status long")


LIFECYCLE = (
    ("create", 200), ("create_again", 400), ("create_bool", 400), ("describe", 200), ("describe_unknown", 404), ("copy", 200),
    ("copy_bad", 400), ("error", 200), ("select", 200), ("query", 200), ("error_of_completed", 400), ("result", 200),
    ("result_flushed", 400), ("select_missing_table", 400), ("invalid", 400), ("tables", 200), ("info", 200), ("drop", 200),
    ("drop_again", 404),
)
QUERIES["lifecycle"] = lifecycle_query
SQL["lifecycle"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({s} AS BIGINT))" for n, s in LIFECYCLE) + ") t(step, status)"


def describe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHOW TABLES with DESCRIBE of each."""
    engine = engine_over(spark, sf_dir, "nation", "orders")
    rows = [(t.name, i, n, k.value) for t in engine.catalog.tables() for i, (n, k) in enumerate(t.columns)]
    return spark.createDataFrame(rows, "table_name string, place long, column_name string, type string")


QUERIES["describe"] = describe_query
SQL["describe"] = (
    "SELECT table_name, row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) - 1 AS place, column_name, "
    "CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'INT64' ELSE 'VARCHAR' END AS type "
    "FROM information_schema.columns WHERE table_name IN ('nation', 'orders') AND data_type IN ('BIGINT', 'INTEGER', 'VARCHAR')"
)


def table_statistics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_statistics(spark.read.parquet(f"{sf_dir}/part.parquet"))


PART = (("p_partkey", "p_size"), ("p_name", "p_brand", "p_type"))
QUERIES["table_statistics"] = table_statistics_query
SQL["table_statistics"] = " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, CAST(NULL AS BIGINT) AS byte, count({c}) AS n, avg({c}) AS mean FROM part" for c in PART[0]]
    + [f"SELECT '{c}', CAST('0x' || pair AS BIGINT), count(*), CAST(NULL AS DOUBLE) FROM "
       f"(SELECT unnest(regexp_extract_all(hex(encode({c})), '..')) AS pair FROM part) GROUP BY pair" for c in PART[1]]
)


def validate_equal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between orders and the table that its CSV was copied to: nothing."""
    source = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*COPIED)
    return differences(source, copy_query(spark, sf_dir))


def validate_different_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between orders and a version of it with a changed status, a renamed column and rows taken out."""
    source = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*COPIED)
    status = F.when(F.col("o_orderkey") == 7, "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    changed = source.where("o_custkey <> 5").select("o_orderkey", F.col("o_custkey").alias("customer"), status, "o_orderpriority")
    return differences(source, changed)


QUERIES |= {"validate_equal": validate_equal_query, "validate_different": validate_different_query}
VALUES = "has different values"
_CHANGED = (
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = 7 THEN '?' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority "
    "FROM orders WHERE o_custkey <> 5"
)
_ROW = "SELECT CAST({} AS INTEGER) AS place, '{}' AS column_name, '{}' AS problem"
SQL["validate_equal"] = _ROW.format(0, "", "") + " WHERE false"
SQL["validate_different"] = " UNION ALL ".join(
    [_ROW.format(1, "o_custkey", "expected name o_custkey but received customer")]
    + [_ROW.format(-1, "", "tables have different numbers of rows") + f" WHERE (SELECT count(*) FROM orders) <> (SELECT count(*) FROM ({_CHANGED}))"]
    + [_ROW.format(-1, "", "rows differ") + f" WHERE EXISTS (SELECT {', '.join(COPIED)} FROM orders EXCEPT ALL ({_CHANGED}))"]
    + [_ROW.format(i, c, VALUES) + f" WHERE EXISTS (SELECT {c} FROM orders EXCEPT ALL SELECT {c} FROM ({_CHANGED})) "
       f"OR EXISTS (SELECT {c} FROM ({_CHANGED}) EXCEPT ALL SELECT {c} FROM orders)" for i, c in enumerate(COPIED)]
)


def copy_short_row_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY of files with a short or a long row, into tables as wide as the file and narrower: status codes and stored rows."""
    from quernstone.api import Api

    engine = new_engine(spark)
    api = Api(engine)
    out = []
    for width in (3, 2):
        columns = [{"name": n, "type": k} for n, k in (("id", "INT64"), ("note", "VARCHAR"), ("more", "VARCHAR"))][:width]
        for name, lines in (("even", ["1,x,y", "2,v,w"]), ("short", ["1,x,y", "2", "3,z,w"]), ("long", ["1,x,y", "2,v,w,u"])):
            table = f"{name}{width}"
            api.put_table({"name": table, "columns": columns})
            status, _ = api.post_query({"queryDefinition": {"sourceFilepath": lines_file(engine, table, lines), "destinationTableName": table}})
            out.append((name, width, status, engine.select({"columnClauses": [of(table, "id")]}).count()))
    return spark.createDataFrame(out, "file string, width long, status long, stored long")


def copy_no_header_destination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY of a file without a header whose columns are named by destinationColumns, in another order."""
    from quernstone.api import Api

    engine = new_engine(spark)
    api = Api(engine)
    api.put_table({"name": "t", "columns": [{"name": "id", "type": "INT64"}, {"name": "note", "type": "VARCHAR"}]})
    definition = {"sourceFilepath": lines_file(engine, "t", ["x,11", "y,22"]), "destinationTableName": "t", "destinationColumns": ["note", "id"]}
    if api.post_query({"queryDefinition": definition})[0] != 200:
        raise RuntimeError("the copy failed")
    return engine.select({"columnClauses": [of("t", "id"), of("t", "note")]}).toDF("id", "note")


def bodies_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of replies as JSON: results by column, job records, stored errors, and what type checks and limits report."""
    from quernstone.api import Api

    engine = engine_over(spark, sf_dir, "region")
    api = Api(engine)
    out: list[tuple[str, str]] = []

    def note(name: str, reply: tuple, query_id: str = "") -> None:
        text = json.dumps(reply[1], sort_keys=True)
        out.append((name, text.replace(query_id, "ID") if query_id else text))

    key, name = of("region", "r_regionkey"), of("region", "r_name")
    definition = {"columnClauses": [key, name], "orderByClause": [{"columnIndex": 0}], "limitClause": {"limit": 2}}
    query_id = api.post_query({"queryDefinition": definition})[1]
    note("record", api.get_query(query_id), query_id)
    note("result", api.get_result(query_id, {"flushResult": True}))
    note("flushed", api.get_result(query_id))
    for what, bad in (
        ("type_add", {"columnClauses": [op("ADD", name, lit(1))]}),
        ("type_where", {"columnClauses": [key], "whereClause": key}),
        ("type_function", {"columnClauses": [fn("STRLEN", key)]}),
        ("order_outside", {"columnClauses": [key], "orderByClause": [{"columnIndex": 3}]}),
        ("limit_negative", {"columnClauses": [key], "limitClause": {"limit": -1}}),
        ("limit_text", {"columnClauses": [key], "limitClause": {"limit": "x"}}),
    ):
        note(what, api.post_query({"queryDefinition": bad}))
    failed = [q["queryId"] for q in api.get_queries()[1] if q["status"] == "FAILED"]
    note("error", api.get_error(failed[0]))
    return spark.createDataFrame(out, "step string, body string")


QUERIES |= {"copy_short_row": copy_short_row_query, "copy_no_header_destination": copy_no_header_destination_query, "bodies": bodies_query}
SQL["copy_short_row"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', CAST({w} AS BIGINT), CAST({s} AS BIGINT), CAST({r} AS BIGINT))"
    for w in (3, 2) for n, s, r in (("even", 200, 2), ("short", 400, 0), ("long", 400, 0))
) + ") t(file, width, status, stored)"
_RECORD = (
    '{"isResultAvailable": true, "queryDefinition": {"columnClauses": [{"columnName": "r_regionkey", "tableName": "region"}, '
    '{"columnName": "r_name", "tableName": "region"}], "limitClause": {"limit": 2}, "orderByClause": [{"columnIndex": 0}]}, '
    '"queryId": "ID", "status": "COMPLETED"}'
)
_REFUSED = '{{"problems": [{{"context": "{}", "error": "{}"}}]}}'
_ADD = _REFUSED.format("columnClauses[0]", "ADD takes INT64 values, not VARCHAR and INT64")
BODIES = (
    ("record", _RECORD),
    ("result", '[{"columns": [[0, 1], ["AFRICA", "AMERICA"]], "rowCount": 2}]'),
    ("flushed", '{"message": "Result of this query is not available"}'),
    ("type_add", _ADD),
    ("type_where", _REFUSED.format("whereClause", "WHERE must be BOOL")),
    ("type_function", _REFUSED.format("columnClauses[0]", "STRLEN takes (VARCHAR), not (INT64)")),
    ("order_outside", _REFUSED.format("orderByClause[0]", "ORDER BY index 3 is not among the projections")),
    ("limit_negative", _REFUSED.format("limitClause", "limit must be a non-negative 32-bit integer")),
    ("limit_text", _REFUSED.format("limitClause", "limit must be a non-negative 32-bit integer")),
    ("error", _ADD),
)
SQL["bodies"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{b}')" for n, b in BODIES) + ") t(step, body)"
SQL["copy_no_header_destination"] = "SELECT * FROM (VALUES (CAST(11 AS BIGINT), 'x'), (CAST(22 AS BIGINT), 'y')) t(id, note)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_select(spark, sf_dir, tables=("orders",), names=FLAGSHIP_NAMES, definition=FLAGSHIP)
