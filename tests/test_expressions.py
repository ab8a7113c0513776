"""Every operator and function, the strict type rules, and random trees against a plain evaluator."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quernstone.catalogue import col, fn, lit, op
from quernstone.plans.expressions import FUNCTIONS, parse, type_of
from quernstone.problems import QueryError
from quernstone.types import Type

COLUMNS = {"i": Type.INT64, "j": Type.INT64, "s": Type.VARCHAR, "t": Type.VARCHAR, "b": Type.BOOL}


def evaluate(e, row):
    if "value" in e:
        return e["value"]
    if "columnName" in e:
        return row[e["columnName"]]
    if "functionName" in e:
        a = [evaluate(x, row) for x in e["arguments"]]
        ascii_map = lambda s, f: "".join(f(c) if c.isascii() else c for c in s)
        return {
            "STRLEN": lambda: len(a[0].encode()),
            "CONCAT": lambda: a[0] + a[1],
            "REPLACE": lambda: a[0].replace(a[1], a[2]) if a[1] else a[0],
            "UPPER": lambda: ascii_map(a[0], str.upper),
            "LOWER": lambda: ascii_map(a[0], str.lower),
        }[e["functionName"]]()
    if "operand" in e:
        v = evaluate(e["operand"], row)
        return not v if e["operator"] == "NOT" else -v
    a, b = evaluate(e["leftOperand"], row), evaluate(e["rightOperand"], row)
    key = lambda v: v.encode() if isinstance(v, str) else v
    a, b = key(a), key(b)
    return {
        "ADD": lambda: a + b, "SUBTRACT": lambda: a - b, "MULTIPLY": lambda: a * b,
        "DIVIDE": lambda: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1),
        "AND": lambda: a and b, "OR": lambda: a or b, "EQUAL": lambda: a == b, "NOT_EQUAL": lambda: a != b,
        "LESS_THAN": lambda: a < b, "LESS_EQUAL": lambda: a <= b, "GREATER_THAN": lambda: a > b, "GREATER_EQUAL": lambda: a >= b,
    }[e["operator"]]()


ROWS = [
    {"i": 7, "j": -2, "s": "mało", "t": "A-b", "b": True},
    {"i": -7, "j": 3, "s": "", "t": "ZŁOTY zł", "b": False},
    {"i": 0, "j": 5, "s": "aXbX", "t": "X", "b": True},
]
numbers = st.deferred(
    lambda: st.one_of(
        st.integers(-1000, 1000).map(lit), st.sampled_from(["i", "j"]).map(col),
        st.builds(op, st.sampled_from(["ADD", "SUBTRACT"]), numbers, numbers),
        st.builds(lambda a, n: op("MULTIPLY", a, lit(n)), numbers, st.integers(-3, 3)),
        st.builds(lambda a, n: op("DIVIDE", a, lit(n)), numbers, st.sampled_from([-3, 2, 7])),
        st.builds(lambda a: op("MINUS", a), numbers), st.builds(lambda a: fn("STRLEN", a), strings),
    )
)
strings = st.deferred(
    lambda: st.one_of(
        st.text("aXłŁz ", max_size=4).map(lit), st.sampled_from(["s", "t"]).map(col), st.builds(lambda a, b: fn("CONCAT", a, b), strings, strings),
        st.builds(lambda a: fn("UPPER", a), strings), st.builds(lambda a: fn("LOWER", a), strings),
        st.builds(lambda a, b, c: fn("REPLACE", a, b, c), strings, st.text("aX", max_size=2).map(lit), st.text("ł", max_size=2).map(lit)),
    )
)
booleans = st.deferred(
    lambda: st.one_of(
        st.booleans().map(lit), st.just(col("b")), st.builds(op, st.sampled_from(["AND", "OR"]), booleans, booleans),
        st.builds(lambda a: op("NOT", a), booleans),
        st.builds(op, st.sampled_from(["EQUAL", "NOT_EQUAL", "LESS_THAN", "LESS_EQUAL", "GREATER_THAN", "GREATER_EQUAL"]), numbers, numbers),
        st.builds(op, st.sampled_from(["EQUAL", "LESS_THAN", "GREATER_EQUAL"]), strings, strings),
        st.builds(op, st.sampled_from(["EQUAL", "LESS_THAN", "GREATER_EQUAL"]), booleans, booleans),
    )
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(trees=st.lists(st.one_of(numbers, strings, booleans), min_size=4, max_size=10))
def test_random_trees_match_the_evaluator(spark, trees):
    from pyspark.sql import functions as F

    from quernstone.functions.scalar import to_column

    df = spark.createDataFrame(ROWS, "i long, j long, s string, t string, b boolean").coalesce(1)
    columns = {c: F.col(c) for c in COLUMNS}
    parsed = [parse(t) for t in trees]
    for p, t in zip(parsed, trees):
        kind = type_of(p, COLUMNS)
        python = {Type.INT64: int, Type.VARCHAR: str, Type.BOOL: bool}[kind]
        assert type(evaluate(t, ROWS[0])) is python
    got = df.select(*[to_column(p, columns).alias(f"c{k}") for k, p in enumerate(parsed)]).collect()
    assert [tuple(r) for r in got] == [tuple(evaluate(t, row) for t in trees) for row in ROWS]


@pytest.mark.parametrize(
    "bad",
    [
        op("ADD", lit("1"), lit(1)), op("ADD", lit(True), lit(1)), op("AND", lit(1), lit(True)), op("EQUAL", lit("1"), lit(1)),
        op("NOT", lit(1)), op("MINUS", lit(True)), fn("STRLEN", lit(1)), fn("CONCAT", lit("a")), fn("REPLACE", lit("a"), lit("b")),
        fn("UPPER"), fn("NOPE", lit("a")), {"operator": "NOT", "leftOperand": lit(True), "rightOperand": lit(True)},
        {"operator": "MINUS", "leftOperand": lit(1), "rightOperand": lit(1)}, lit(None), lit(1.5), lit(2**63), col("nope"), {}, 5,
        {"operator": "ADD", "leftOperand": lit(1)},
    ],
)
def test_ill_typed_or_malformed_is_rejected(bad):
    with pytest.raises(QueryError):
        type_of(parse(bad), COLUMNS)


def test_depth_is_bounded():
    tree = lit(1)
    for _ in range(5000):
        tree = op("MINUS", tree)
    with pytest.raises(QueryError):
        parse(tree)


def test_every_function_has_a_column():
    from quernstone.functions import scalar
    from quernstone.plans import expressions as e

    assert set(scalar.FUNCTIONS) == set(FUNCTIONS)
    assert set(scalar.OPERATORS) == set(e.BINARY) and set(scalar.UNARY) == set(e.UNARY)
