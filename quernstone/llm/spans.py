"""Positions of regular-expression matches inside a row, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 512
SPANS = "array<struct<s:int,e:int>>"


def prefix_sums(values: Column) -> Column:
    """array<int>: for each of an array of ints the sum of those before it.

    Taken in blocks, as growing one array would be quadratic in its length.
    """
    size = F.size(values)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    )

    def running(xs: Column, start: Column) -> Column:
        return F.aggregate(
            xs,
            F.struct(start.alias("p"), F.expr("cast(array() as array<int>)").alias("out")),
            lambda acc, x: F.struct((acc["p"] + x).alias("p"), F.concat(acc["out"], F.array(acc["p"])).alias("out")),
            lambda acc: acc["out"],
        )

    before = running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)), F.lit(0))
    inside = F.zip_with(blocks, before, running)
    return F.when(size > 0, F.flatten(inside)).otherwise(F.expr("cast(array() as array<int>)"))


def match_ends(gaps: Column, matches: Column) -> Column:
    """array<struct<s, e>>: start and end (exclusive, code points) of each match.

    `gaps` is split(text, regex, -1) and `matches` regexp_extract_all(text, regex, 0) for a regex
    that never matches empty text: the lengths of both, summed alternately, are the positions.
    Running sums are taken in blocks, as growing one array would be quadratic in the matches.
    """
    size = F.size(matches)
    lengths = F.zip_with(
        F.slice(gaps, F.lit(1), size), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))
    )
    blocks = F.transform(
        F.sequence(F.lit(0), ((size - 1) / BLOCK).cast("int")),
        lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)),
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["g"] + x["m"]))
    before = F.aggregate(
        sums,
        F.struct(F.lit(0).alias("p"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, x: F.struct((acc["p"] + x).alias("p"), F.concat(acc["out"], F.array(acc["p"])).alias("out")),
        lambda acc: acc["out"],
    )
    inside = F.zip_with(
        blocks,
        before,
        lambda b, p: F.aggregate(
            b,
            F.struct(p.alias("p"), F.expr(f"cast(array() as {SPANS})").alias("out")),
            lambda acc, x: F.struct(
                (acc["p"] + x["g"] + x["m"]).alias("p"),
                F.concat(
                    acc["out"],
                    F.array(F.struct((acc["p"] + x["g"]).alias("s"), (acc["p"] + x["g"] + x["m"]).alias("e"))),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        ),
    )
    return F.when(size > 0, F.flatten(inside)).otherwise(F.expr(f"cast(array() as {SPANS})"))
