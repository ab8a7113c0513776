"""Mixing sources to target weights: capped water-filling and seeded repetitions (DataFrame only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import checkpoint, read

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
BROADCAST_SOURCES = 20_000
SALTS = 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def rank_sources(sources: DataFrame) -> DataFrame:
    """Adds `place`, the 0-based place of each source by code point, null last.

    Ranges are sorted in parallel; only the row counts of the ranges (one row a partition) meet
    in one task.
    """
    ranged = checkpoint(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    )
    ahead = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return (
        ranged.withColumn("_row", F.row_number().over(within))
        .join(ahead, "_part")
        .withColumn("place", F.col("_ahead") + F.col("_row") - 1)
        .drop("_part", "_row", "_ahead")
    )


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds `target` to (source, source_size, weight): shares of `total` by weight, none above
    max_epochs times its size; the excess is shared again by weight until none is above.

    Every round clamps all sources above their cap at once and takes two sums; a clamped source
    stays clamped, so the rounds end. Where the caps together are below `total`, all are clamped.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = -1.0
    while True:
        clamped = F.col("weight") * F.lit(level) > cap if level >= 0 else F.lit(False)
        caps, weight, above = sources.agg(
            F.sum(F.when(clamped, cap).otherwise(0.0)),
            F.sum(F.when(clamped, 0.0).otherwise(F.col("weight").cast("double"))),
            F.count(F.when(clamped, 1)),
        ).first()
        if not weight:
            level = float("inf")
            break
        new = max((total - caps) / weight, 0.0)
        if new == level or (level >= 0 and above == last_above):
            level = new
            break
        last_above, level = above, new
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(share > cap, cap).otherwise(share) if level < float("inf") else cap)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    total_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1",
    carry: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of `docs`; with `carry` also
    `_row`, a struct of all its columns.

    `docs` needs doc_id, source and text; other columns are ignored or carried in the struct, so
    clashing names are harmless. Sizes are counts of words; null or empty text has size 0. Null sources are one
    source, placed last. Every document is taken floor(target / source_size) whole times; the
    rest of the target is filled by further repetitions of the source's documents in the order
    of a seeded hash, the last of them fractional, so that a source's taken words are its
    rounded target and no document exceeds max_epochs (rounded up) times its size. Rows that
    repeat are separate rows; of rows that tie in hash, id and size it does not matter which
    comes first. A null doc_id hashes as the empty string. An empty table gives an empty table.

    Scale: the text is read once, into (id, source, size); sums are pre-aggregated by source and
    hash bucket, so one hot source is spread over BUCKETS groups and only the one bucket of it
    that holds the boundary is sorted. Carried rows stay where they are, but for that bucket's.
    """
    sized = checkpoint(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("_hash", order).withColumn("_bucket", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))

    keyed = hashed(sized)
    buckets = checkpoint(keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("bucket_size")))
    sources = rank_sources(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    by_place = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = checkpoint(sources.select("source", "source_size", by_place.alias("weight")))
    count, everything = sources.agg(F.count("*"), F.sum("source_size")).first()
    sources = water_fill(sources, total_share * (everything or 0), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("whole", whole.cast("bigint")).withColumn(
        "rest", (F.round("target").cast("bigint") - F.col("whole") * F.col("source_size"))
    )
    few = (count or 0) <= BROADCAST_SOURCES

    def with_source(df: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """Null-safe left join on `source`; broadcast while the sources are few, else salted."""
        on = [df[k].eqNullSafe(right[k]) for k in keys]
        if few:
            joined = df.join(F.broadcast(right), on, "left")
        else:
            left = df.withColumn("_salt", F.pmod(F.xxhash64("_hash"), F.lit(SALTS)))
            salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
            on = [left[k].eqNullSafe(salted[k]) for k in keys] + [left["_salt"] == salted["_salt"]]
            return left.join(salted, on, "left").drop(salted["_salt"], *[salted[k] for k in keys]).drop("_salt")
        return joined.drop(*[right[k] for k in keys])

    # where the boundary of the fractional pass falls: at most one bucket of each source
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = buckets.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    edges = edges.withColumn("_before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    edges = (
        edges.where("_before < rest and _before + bucket_size >= rest")
        .groupBy("source")
        .agg(F.min(F.struct("_bucket", "_before")).alias("_edge"))
        .select("source", F.col("_edge._bucket").alias("edge_bucket"), F.col("_edge._before").alias("edge_before"))
    )
    table = sources.join(edges.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    table = checkpoint(table)
    if carry:
        whole_rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", words(F.col("text")).alias("size"))
        keyed = hashed(whole_rows)
    rows = with_source(keyed, table, ["source"])
    inside = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    at_edge = F.coalesce(F.col("_bucket") == F.col("edge_bucket"), F.lit(False))
    plain = rows.where(~at_edge).withColumn(
        "extra", F.when(F.coalesce(F.col("_bucket") < F.col("edge_bucket"), F.lit(False)), F.col("size")).otherwise(F.lit(0))
    )
    edge = rows.where(at_edge).withColumn(
        "_cum", F.col("edge_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_cum")))).drop("_cum")
    return plain.unionByName(edge).select(
        *["_row"] * carry,
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"),
    )


def repeat(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: the columns of `docs`, `epoch` (from 0) and `epoch_words`, a row per repetition taken.

    A repetition that is taken in part ends after epoch_words words, its n_chars follows. Documents that the mix
    takes no word of are left out (an empty text has none to take). Columns of the two names are replaced.
    """
    columns = [c for c in docs.columns if c not in ("epoch", "epoch_words")]
    rows = mix(docs.select(*columns), carry=True, **options).where("taken > 0").select("_row", "size", "taken")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), ((F.col("taken") - 1) / F.col("size")).cast("int"))))
    rows = rows.withColumn("epoch_words", F.least("size", F.col("taken") - F.col("epoch") * F.col("size")))
    rows = rows.withColumn("text", F.col("_row.text"))
    # cut behind the last word taken: the pieces between words are kept as they stand
    gaps = F.split("text", WORD, -1)
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    count = F.col("epoch_words").cast("int")
    pieces = F.zip_with(F.slice(gaps, F.lit(1), count), F.slice(found, F.lit(1), count), lambda g, w: F.concat(g, w))
    partial = F.col("epoch_words") < F.col("size")
    text = F.when(partial, F.array_join(pieces, "")).otherwise(F.col("text"))
    rows = rows.withColumn("_text", text)
    new = {"text": F.col("_text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(partial, F.length("_text").cast("bigint")).otherwise(F.col("_row.n_chars"))
    return rows.select(
        *[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns],
        "epoch",
        "epoch_words",
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
summed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT source, source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM summed),
fill AS (
  SELECT 0 AS round, 1.5::DOUBLE * sum(source_size)::DOUBLE / sum(weight) AS level FROM placed
  UNION ALL
  SELECT round + 1, (SELECT (1.5::DOUBLE * sum(source_size)::DOUBLE
           - sum(CASE WHEN weight * level > 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size ELSE 0 END))
           / sum(CASE WHEN weight * level > 2.0::DOUBLE * source_size THEN 0 ELSE weight END) FROM placed)
  FROM fill WHERE round < 40),
targets AS (
  SELECT source, source_size, least(weight * level, 2.0::DOUBLE * source_size) AS target
  FROM placed, (SELECT level FROM fill ORDER BY round DESC LIMIT 1)),
parts AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM targets),
rests AS (
  SELECT *, CAST(round(target) AS BIGINT) - whole * source_size AS rest FROM parts),
running AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.whole, r.rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM running
"""
