"""Helpers that the training-data operators share: reading tables, checkpoints, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch between the JVM and Python where rows hold whole texts.
TEXT_BATCH_ROWS = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch to TEXT_BATCH_ROWS where it is larger.

    The default of 10,000 rows holds tens of MB of text, and with long texts hundreds, once in each of
    the JVM's off-heap buffers and again in Python. Operators that send texts to Python call this.
    """
    if not 0 < int(spark.conf.get(BATCH_SETTING, "10000")) <= TEXT_BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(TEXT_BATCH_ROWS))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` through the cluster's shared checkpoint folder.

    The folder is the session's `spark.checkpoint.dir`. Only where that is unset, and only in
    local mode (tests), a folder of our own is set; on a cluster that would not survive the loss
    of a machine, so it is an error there.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or in local mode one of our own; see checkpoint()."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quernstone-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder's name below the shared one, with its scheme, that nothing else uses; deleted when the session ends."""
    place = _path(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    files = place.getFileSystem(_hadoop(spark))
    files.mkdirs(place)
    files.deleteOnExit(place)
    files.delete(place, True)  # it was made to be marked only; Spark writes where nothing is
    return re.sub("^file:/+", "file:///", files.makeQualified(place).toString())


def read_part(part: str, columns: list[str]) -> pa.Table:
    """Rows of one folder of a partitioned Parquet table, wherever this is called, such as in a task."""
    files, path = fs.FileSystem.from_uri(part)
    return pyarrow.dataset.dataset(path, filesystem=files, format="parquet").to_table(columns=columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again: for rows with texts, which compress well."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever it is, with all that is in it."""
    place = _path(spark, folder)
    place.getFileSystem(_hadoop(spark)).delete(place, True)


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jsc.hadoopConfiguration()


#: Ids that are broadcast at most; a hash table of so many takes some 60 MB.
BROADCAST_IDS = 2_000_000


def checked_ids(ids: DataFrame) -> DataFrame:
    """Distinct ids, to be joined with texts: broadcast if counted and few, else left to a shuffle join.

    Broadcast, the texts stay where they are; the count is of all ids, so the choice can't be wrong.
    """
    ids = checkpoint(ids.distinct())
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def text_md5(text: Column) -> Column:
    """16 bytes that stand for the whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long): the least node it reaches.

    Alternating large-star and small-star steps (Kiveris et al., "Connected components in
    MapReduce and beyond", 2014) until the edge set is a forest of stars. Each step is two small
    shuffles and a checkpoint; nothing but two sums per round reaches the driver. Self-links,
    repeated links and either direction are accepted; links with a null end are ignored; an
    empty input gives an empty output. Hot nodes are harmless: per node only a minimum is kept
    (pre-aggregated before the shuffle) and neighbours stay separate rows.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    links = edges.where("a is not null and b is not null and a <> b")
    links = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: each larger neighbour of u moves to the least of u's neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star: u and its smaller neighbours move to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        links = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        links = checkpoint(links)
        state = links.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        ).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
