"""Quality classification by an interpolated modified Kneser-Ney model of trusted text.

The model is over characters as they stand (white space as one space, any digit as 0), of order 5
in symbols: a code point below DIRECT is one symbol, any other is two, its upper and lower bits, so
every character of every script is told apart. Counts of trusted texts are summed per n-gram in
Spark; continuation counts, discounts and interpolated probabilities (Chen and Goodman, "An empirical
study of smoothing techniques for language modeling", 1998) are joins and sums of those counts, sharded
by n-gram.

Documents are scored by joins too. A block is what one task reads. Each block's distinct n-grams are
joined with the model's shards, and their bits are written to the shared folder, a file a block, which
the task that scores the block reads. So an n-gram is shuffled once per block instead of once per
document, texts aren't shuffled at all, and no row of the model passes through the driver.

A document's perplexity is over all its characters; the limit is a quantile, per language, of the
perplexities of held-out trusted documents. For the decision a text's bits are averaged with a fixed
number of usual characters, as a few characters are no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.codes import SPACE, STOP
from quernstone.llm.common import bounded_batches, checkpoint, new_folder, read, read_part, remove

ORDER = 5
WIDTH = 12  # bits of a symbol in an n-gram's key; symbol 0 stands before a text
DIRECT = 1984  # code points that are symbols themselves; then 1,088 upper and 1,024 lower parts of others
LOWER = DIRECT + (0x110000 >> 10)
HELD = 5  # one in so many trusted documents sets the limits instead of training
QUANTILE = 0.99  # of held-out clean texts, so one in a hundred is the wanted loss
PRIOR_CHARS = 50  # a text is judged as if so many characters of its language's usual perplexity stood before it
BUFFER_CHARS = 1 << 19
BUFFER_KEYS = 2_000_000
BROADCAST_IDS = 2_000_000


def mask(k: int) -> int:
    """Of the last k symbols of a key."""
    return (1 << (WIDTH * k)) - 1


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point itself, SPACE for white space, "0" for digits; STOP for U+0000."""
    table = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        if not 0xD800 <= point < 0xE000:
            if chr(point).isspace():
                table[point] = SPACE
            elif chr(point).isdecimal():
                table[point] = ord("0")
    table[0] = STOP
    return table


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text with runs of white space as one, and the place of each."""
    codes = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != SPACE
    if len(keep):
        keep[1:] |= codes[:-1] != SPACE
    at = np.flatnonzero(keep)
    return codes[at], at


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the ORDER symbols that end at each symbol, where each text's keys begin, and each text's characters."""
    codes, at = normal("\0".join(texts))
    bounds = np.searchsorted(at, np.cumsum([0] + [len(t) + 1 for t in texts]))
    real = codes != STOP
    chars = np.diff(np.concatenate([[0], np.cumsum(real)])[bounds])
    wide = codes >= DIRECT
    if wide.any():
        twice = 1 + wide
        place = np.concatenate([[0], np.cumsum(twice)])
        split = np.repeat(np.where(wide, DIRECT + (codes >> 10), codes), twice)
        split[place[1:][wide] - 1] = LOWER + (codes[wide] & 1023)
        codes, real, bounds = split, np.repeat(real, twice), place[bounds]
    symbols = codes.astype(np.int64)
    symbols[~real] = 0
    begin = np.zeros(len(symbols), bool)
    begin[bounds[:-1][bounds[:-1] < len(symbols)]] = True
    index = np.arange(len(symbols))
    depth = index - np.maximum.accumulate(np.where(begin, index, 0))
    keys = symbols.copy()
    for k in range(1, ORDER):
        before = np.zeros(len(symbols), np.int64)
        before[k:] = symbols[:-k]
        keys |= np.where(depth >= k, before, 0) << (WIDTH * k)
    return keys[real], np.concatenate([[0], np.cumsum(real)])[bounds], chars


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        start, n, texts = 0, 0, []
        column = batch.column("text")
        for i in range(batch.num_rows):
            texts.append(column[i].as_py() or "")
            n += len(texts[-1])
            if n >= BUFFER_CHARS or i == batch.num_rows - 1:
                yield batch.slice(start, i + 1 - start), texts
                start, n, texts = i + 1, 0, []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, n): the task's n-grams and their occurrences in rows to train from; a key may come again."""
    held, size = [], 0
    block = TaskContext.get().partitionId()

    def out() -> pa.RecordBatch:
        keys, n = zip(*held)
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(n)).astype(np.int64)
        blocks = pa.array(np.full(len(keys), block), pa.int32())
        return pa.RecordBatch.from_arrays([blocks, pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["block", "key", "n"])

    for rows, texts in _buffers(batches):
        keys, bounds, _ = _keys(texts)
        train = np.repeat(rows.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
        distinct, at = np.unique(keys, return_inverse=True)
        held.append((distinct, np.bincount(at, weights=train, minlength=len(distinct))))
        size += len(distinct)
        if size > BUFFER_KEYS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def ngrams(docs: DataFrame) -> DataFrame:
    """(block, key, n): each block's distinct runs of ORDER symbols, in all texts of docs (..., train, text), and
    how often they stand in rows with `train`; tasks sum their own first. Checkpointed.
    """
    found = docs.mapInArrow(_count, "block int, key long, n long")
    return checkpoint(found.groupBy("block", "key").agg(F.sum("n").alias("n")))


class Discounts:
    """Modified Kneser-Ney's three discounts of one order, from its counts of counts."""

    def __init__(self, counts: dict[int, int]):
        n1, n2, n3, n4 = (counts.get(k, 0) for k in (1, 2, 3, 4))
        if min(n1, n2, n3, n4) == 0:
            self.values = (0.5, 0.75, 0.9)
        else:
            y = n1 / (n1 + 2 * n2)
            plain = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            self.values = tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(plain, 1))

    def of(self, n):
        return F.when(n == 1, self.values[0]).when(n == 2, self.values[1]).otherwise(self.values[2])


class Model:
    """Sharded tables per order: p of (key, p), the interpolated probability of an n-gram's last symbol, and
    weight of (key, weight), what a context of so many symbols leaves to the next lower order; floor is order 0.
    """

    def __init__(self) -> None:
        self.p: dict[int, DataFrame] = {}
        self.weight: dict[int, DataFrame] = {}
        self.floor = 1.0


def train(counts: DataFrame) -> Model:
    """The model of ngrams()' counts; without any, every symbol has probability 1.

    The highest order has raw counts, the others the number of different symbols to their left.
    Everything is joins and sums on n-gram keys, so the tables are sharded by key at any size.
    """
    counts = counts.where("n > 0").groupBy("key").agg(F.sum("n").alias("n"))
    orders = {ORDER: checkpoint(counts)}
    for k in range(ORDER - 1, 0, -1):
        lower = orders[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(mask(k))).alias("key")).agg(F.count("*").alias("n"))
        orders[k] = checkpoint(lower)
    of_counts: dict[int, dict[int, int]] = {k: {} for k in orders}
    few = [table.where("n <= 4").select(F.lit(k).alias("k"), "n") for k, table in orders.items()]
    for k, n, times in reduce(DataFrame.unionByName, few).groupBy("k", "n").count().collect():
        of_counts[k][n] = times
    model = Model()
    model.floor = 1.0 / (orders[1].count() + 1)
    for k in range(1, ORDER + 1):
        discount = Discounts(of_counts[k])
        table = orders[k].select("key", "n", F.shiftright("key", WIDTH).alias("context"), discount.of(F.col("n")).alias("d"))
        totals = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum(F.least("d", "n")).alias("left"))
        totals = totals.withColumn("weight", F.col("left") / F.col("total"))
        model.weight[k - 1] = totals.select(F.col("context").alias("key"), "weight")
        joined = table.join(totals, "context")
        below: Column = F.lit(model.floor)
        if k > 1:
            lower = model.p[k - 1].select(F.col("key").alias("suffix"), F.col("p").alias("below"))
            joined = joined.withColumn("suffix", F.col("key").bitwiseAND(F.lit(mask(k - 1)))).join(lower, "suffix")
            below = F.col("below")
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        model.p[k] = checkpoint(joined.select("key", (own + F.col("weight") * below).alias("p")))
    return model


def resolve(keys: DataFrame, model: Model) -> DataFrame:
    """(key, bits) for distinct keys of ORDER symbols: -log2 of the probability of the last one after the others.

    Joins with each order's shards from the lowest: an n-gram's own probability, or else that of the
    order below times the weight that its context leaves (1 if the context is unknown).
    """
    found = keys.select("key", F.lit(model.floor).alias("value"))
    for k in range(1, ORDER + 1):
        suffix = F.col("key").bitwiseAND(F.lit(mask(k)))
        found = found.select("key", "value", suffix.alias("suffix"), F.shiftright(suffix, WIDTH).alias("context"))
        own, left = model.p[k].withColumnRenamed("key", "suffix"), model.weight[k - 1].withColumnRenamed("key", "context")
        if k == 1:  # 4,096 symbols at most, and one empty context
            own, left = F.broadcast(own), F.broadcast(left)
        elif k == 2:
            left = F.broadcast(left)
        found = found.join(own, "suffix", "left").join(left, "context", "left")
        found = found.select("key", F.coalesce("p", F.coalesce("weight", F.lit(1.0)) * F.col("value")).alias("value"))
    return found.select("key", (-F.log2("value")).alias("bits"))


def _block_bits(folder: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    rows = read_part(f"{folder}/block={block}", ["key", "bits"])
    key, bits = rows.column("key").to_numpy(), rows.column("bits").to_numpy()
    order = np.argsort(key, kind="stable")
    return key[order], bits[order]


def _score(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    known = None
    for batch, texts in _buffers(batches):
        keys, bounds, chars = _keys(texts)
        bits = np.zeros(0)
        if len(keys):
            if known is None:
                known = _block_bits(folder, TaskContext.get().partitionId())
            distinct, which = np.unique(keys, return_inverse=True)
            at = np.minimum(np.searchsorted(known[0], distinct), len(known[0]) - 1)
            if not np.array_equal(known[0][at], distinct):
                raise RuntimeError("a partition of the documents holds other texts than when its n-grams were taken")
            bits = known[1][at][which]
        total = np.concatenate([[0.0], np.cumsum(bits)])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(total[bounds[1:]] - total[bounds[:-1]]), pa.array(chars, pa.int64())],
            [*batch.schema.names[:-1], "bits", "chars"],
        )


def perplexities(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` (keys..., train, text) with bits and chars instead of text, and the folder that it reads.

    The model is trained from the rows with `train`. Every row is scored by itself, so repeated rows and
    null keys stay as they are; a text without characters has 0 and 0. The blocks are the partitions of
    `docs`, which is read twice by the same plan; if a partition held other texts the second time, the
    job would fail, not score wrongly. A task that is run again reads the same file. The caller removes
    the folder after the last read.
    """
    found = ngrams(docs)
    bits = resolve(found.select("key").distinct(), train(found))
    folder = new_folder(docs.sparkSession, "ngrams")
    answers = found.select("block", "key").join(bits, "key").repartition("block").sortWithinPartitions("block", "key")
    answers.write.partitionBy("block").parquet(folder)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(lambda it: _score(it, folder), f"{fields}, bits double, chars long"), folder


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) for every row of docs (doc_id, text, lang).

    `trusted` holds the doc_ids of trusted documents; all of their texts, but one in HELD by hash, train
    the model, and that one sets its language's limit: the quantile of their perplexities per
    character. A language without held-out trusted text takes the limit over all
    of it; with no trusted text at all everything is kept. Null lang is a language of its own.
    Null and empty texts have a null perplexity and aren't kept.
    Rows that repeat are judged each. Other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "lang", "text")
    picked = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD)) == 0
    marks = checkpoint(trusted.where("doc_id is not null").select("doc_id").distinct())
    few = marks.count() <= BROADCAST_IDS  # else the texts are shuffled to the ids
    marks = marks.withColumn("trusted", F.lit(True))
    docs = docs.join(F.broadcast(marks) if few else marks, "doc_id", "left")
    marked = F.coalesce("trusted", F.lit(False))
    scored, folder = perplexities(docs.select("doc_id", "lang", marked.alias("trusted"), (marked & ~picked).alias("train"), "text"))
    average = F.col("bits") / F.col("chars")
    perplexity = F.when(F.col("chars") > 0, F.pow(F.lit(2.0), average)).alias("perplexity")
    scored = checkpoint(scored.select("doc_id", "lang", "trusted", perplexity, "bits", "chars"))
    remove(docs.sparkSession, folder)
    held = scored.where(picked).where("trusted and perplexity is not null")
    measures = (
        F.percentile_approx("perplexity", quantile, 10000).alias("limit"),
        F.percentile_approx("perplexity", 0.5, 10000).alias("usual"),
    )
    limits = held.groupBy("lang").agg(*measures).withColumnRenamed("lang", "_lang")
    limit, usual = held.agg(*measures).first()
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.coalesce("limit", F.lit(limit).cast("double"))
    usual = F.log2(F.coalesce("usual", F.lit(usual).cast("double")))
    judged = F.pow(F.lit(2.0), (F.col("bits") + usual * PRIOR_CHARS) / (F.col("chars") + PRIOR_CHARS))
    keep = F.col("perplexity").isNotNull() & F.coalesce(judged <= threshold, F.lit(True))
    return joined.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), keep.alias("keep"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return judge(read(spark, sf_dir, "documents"), trusted)
