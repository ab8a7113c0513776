"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the set of its five-word shingles (fewer words: one shingle of them all), each weighing
(1 + ln tf) * idf. Document frequencies are counted over all documents in a sketch of fixed width,
so idf = 1 + log(documents / count) / log(documents) tells boilerplate from ordinary text at any
size of corpus. Consistent weighted samples (Ioffe, "Improved consistent sampling, weighted minhash
and L1 sketching", 2010) are banded; candidates are verified by exact weighted Jaccard similarity.

Exact copies are one class from the start. In a band's bucket every text is held against the
bucket's least id; a text that doesn't match that one is held against all others of the bucket, so
the pairs of a group of mutual copies are never listed, yet no candidate pair between two
components stays unverified. Of such pairs only those are verified, and their texts moved, whose samples
agree as often as a pair of the wanted similarity would but for once in 30,000 times: four bits of each
sample are compared in the join. There is no cap on buckets or candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.codes import SPACE, STOP, lowered, normal
from quernstone.llm.common import bounded_batches, checked_ids, checkpoint, connected_components, read, text_md5

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SKETCH_BITS = 18
DEVIATIONS = 4.0  # by which a pair's agreeing samples may fall short of those expected
BUFFER_CHARS = 1 << 19
TABLE = 1 << 16
SEED = 77
BLOCK = 1024

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        n = max(n, 1 << 20)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles' hashes, sorted, and their counts."""
    low = [lowered(t) for t in texts]
    codes, at = normal("\0".join(low))
    raw = np.cumsum([0] + [len(t) + 1 for t in low])
    word = (codes != SPACE) & (codes != STOP)
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(codes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * up[: len(codes)], dtype=np.uint64)])
    words = _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    doc = np.searchsorted(raw, at[begin], side="right") - 1 if len(begin) else np.zeros(0, np.int64)
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    grams = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    factor = 1
    for k in range(WORDS):
        factor = (factor * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)
        grams += words[k : k + len(grams)] * np.uint64(factor)
    grams = _mix(grams)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1], return_counts=True))
        elif b > a:
            powers = np.cumprod(np.full(b - a, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
            whole = (words[a:b] * powers).sum(dtype=np.uint64, keepdims=True)
            out.append((_mix(whole + powers[-1:]), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def _buffers(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows with their texts' shingles, of bounded size (or one text)."""
    for batch in batches:
        column = batch.column(text)
        start, n, texts = 0, 0, []
        for i in range(batch.num_rows):
            texts.append(column[i].as_py() or "")
            n += len(texts[-1])
            if n >= BUFFER_CHARS or i == batch.num_rows - 1:
                yield batch.slice(start, i + 1 - start), shingles(texts)
                start, n, texts = i + 1, 0, []


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    docs = 0
    for _, found in _buffers(batches):
        for grams, _ in found:
            docs += len(grams) > 0
        every = np.concatenate([g for g, _ in found])
        counts += np.bincount(_slots(every), minlength=len(counts))
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(slots, -1), pa.int32()), pa.array(np.append(counts[slots], docs), pa.int64())], ["slot", "n"]
    )


def idf_table(docs: DataFrame) -> np.ndarray:
    """idf by slot of the sketch, from every document; 2**SKETCH_BITS sums reach the driver at any size."""
    rows = docs.select("text").mapInArrow(_sketch, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    frame = rows.toPandas()
    counts = np.zeros(1 << SKETCH_BITS)
    real = frame["slot"].to_numpy() >= 0
    counts[frame["slot"].to_numpy()[real]] = frame["n"].to_numpy()[real]
    total = max(int(frame["n"].to_numpy()[~real].sum()), 2)
    return (1.0 + np.log(np.maximum(total / np.maximum(counts, 1.0), 1.0)) / np.log(total)).astype(np.float32)


def weights(grams: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1.0 + np.log(counts)).astype(np.float32) * idf[_slots(grams)]


class Sampler:
    """Consistent weighted samples; the variates of an element and sample come from fixed tables by hash."""

    def __init__(self, samples: int, seed: int = SEED):
        rng = np.random.Generator(np.random.Philox(seed))
        gamma = np.sort(rng.gamma(2.0, 1.0, 64 * TABLE)).reshape(TABLE, 64).mean(axis=1)
        self.r = gamma.astype(np.float32)
        self.inverse = (1.0 / gamma).astype(np.float32)
        self.log_c = np.log(gamma).astype(np.float32)
        self.beta = ((np.arange(TABLE) + 0.5) / TABLE).astype(np.float32)
        self.odd = (rng.integers(0, 1 << 62, samples, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def __call__(self, grams: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One hash for each sample: of the element chosen and its quantised weight."""
        samples = len(self.odd)
        least = np.full(samples, np.inf, np.float32)
        chosen = np.zeros(samples, np.uint64)
        every = np.arange(samples)
        log_w = np.log(weight)
        for i in range(0, len(grams), BLOCK):
            part = grams[i : i + BLOCK]
            h = part[None, :] * self.odd[:, None]
            h ^= h >> np.uint64(32)
            h *= M1
            a = (h >> np.uint64(48)).astype(np.intp)
            c = ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)
            b = ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1.0 / TABLE)
            t = np.floor(log_w[None, i : i + BLOCK] * self.inverse[a] + b)
            value = self.log_c[c] - self.r[a] * (t - b + np.float32(1.0))
            at = np.argmin(value, axis=1)
            best = value[every, at]
            better = best < least
            least = np.where(better, best, least)
            step = t[every, at].astype(np.int64).astype(np.uint64)
            chosen = np.where(better, _mix(part[at] + step * np.uint64(BASE)), chosen)
        return chosen


def nibbles(chosen: np.ndarray) -> np.ndarray:
    """The first four bits of each sample, 16 samples to a word."""
    parts = (chosen >> np.uint64(60)).reshape(-1, 16)
    return (parts << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def agreeing(a: Column, b: Column) -> Column:
    """How many of two texts' samples agree in their four bits."""

    def differing(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    words = BANDS * ROWS // 16
    return F.lit(BANDS * ROWS) - reduce(lambda x, y: x + y, [differing(i) for i in range(words)])


def least_agreeing(similarity: float) -> int:
    """Of the samples of a pair with this similarity, but for DEVIATIONS; four bits agree by chance once in 16 times."""
    n, p = BANDS * ROWS, similarity + (1 - similarity) / 16
    return math.floor(n * p - DEVIATIONS * math.sqrt(n * p * (1 - p)))


def _signatures(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    sampler = Sampler(BANDS * ROWS)
    for batch, found in _buffers(batches):
        bands, sizes, marks = [], [], []
        for grams, counts in found:
            if not len(grams):
                bands.append(None)
                sizes.append(0.0)
                marks.append(None)
                continue
            weight = weights(grams, counts, idf)
            chosen = sampler(grams, weight).reshape(BANDS, ROWS)
            joined = np.zeros(BANDS, np.uint64)
            for k in range(ROWS):
                joined = _mix(joined * np.uint64(BASE) + chosen[:, k])
            bands.append(joined.view(np.int64))
            marks.append(nibbles(chosen.ravel()).view(np.int64))
            sizes.append(float(weight.sum(dtype=np.float64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("md5"), pa.array(sizes, pa.float64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))],
            ["doc_id", "md5", "total", "bands", "marks"],
        )


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of sorted distinct hashes with weights."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    shared = np.minimum(a[1][at[same]], b[1][same]).sum(dtype=np.float64)
    every = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - shared
    return float(shared / every) if every > 0 else 0.0


def _verified(batches: Iterator[pa.RecordBatch], idf: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    last, known = None, None
    for batch in batches:
        a, b, good = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        other = batch.column("text_a")
        for part, found in _buffers(iter([batch]), "text_b"):
            offset = len(good)
            for i, (grams, counts) in enumerate(found):
                k = offset + i
                if a[k] != last:
                    own, n = shingles([other[k].as_py() or ""])[0]
                    last, known = a[k], (own, weights(own, n, idf))
                good.append(weighted_jaccard(known, (grams, weights(grams, counts, idf))))
        keep = [k for k, s in enumerate(good) if s >= least - 1e-9]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for k in keep], pa.int64()) for x in (a, b)] + [pa.array([good[k] for k in keep], pa.float64())],
            ["a", "b", "similarity"],
        )


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Those of `pairs` (a, b) whose texts reach `least`: (a, b, similarity).

    Only texts of the pairs' ids are shuffled. They are joined by id, first b's, then a's, so a text that is compared often is not copied
    through a shuffle but meets its partners after the join; a hot `a` is split by the skew join.
    """
    texts = texts.join(checked_ids(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))), "doc_id")
    first = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    both = first.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = both.select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda it: _verified(it, idf, least), "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept) for every document: class_id is the least doc_id of its component.

    docs: doc_id, text; other columns are ignored. Links are equal texts and pairs whose weighted
    Jaccard similarity is at least `similarity`. Texts without words (null and empty ones too) link
    with nothing. Rows that repeat a doc_id are one document: they share its class and each is
    returned. A null doc_id has a null class and is kept. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id is not null")
    idf = idf_table(known)
    signed = checkpoint(
        known.select("doc_id", text_md5(F.col("text")).alias("md5"), "text").mapInArrow(
            lambda it: _signatures(it, idf), "doc_id long, md5 binary, total double, bands array<long>, marks array<long>"
        )
    )
    worded = signed.where("bands is not null")
    first = lambda name: F.first(name).alias(name)
    classes = checkpoint(worded.groupBy("md5").agg(F.min("doc_id").alias("rep"), first("total"), first("bands"), first("marks")))
    rows = classes.select("rep", "total", "marks", F.posexplode("bands").alias("band", "value"))
    buckets = rows.groupBy("band", "value").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = checkpoint(
        rows.join(buckets.hint("merge"), ["band", "value"]).select("band", "value", "leader", "rep", "total", "marks")
    )
    # a similarity of s needs totals within a factor s of each other
    fits = F.expr(f"least(total, total_a) >= {similarity} * greatest(total, total_a) * (1 - 1e-9)")
    fits = fits & (agreeing(F.col("marks"), F.col("marks_a")) >= least_agreeing(similarity))
    own = members.groupBy("rep").agg(first("total"), first("marks"))
    own = own.select(F.col("rep").alias("a"), F.col("total").alias("total_a"), F.col("marks").alias("marks_a"))
    stars = members.where("rep <> leader").groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).agg(first("total"), first("marks"))
    stars = stars.join(own, "a").where(fits).select("a", "b")
    links = checkpoint(verify(checkpoint(stars), known, idf, similarity).select("a", "b"))
    # the rest: members that their bucket's leader doesn't link, against all of the bucket outside their component
    parts = checkpoint(connected_components(links))
    matched = links.select(F.col("a").alias("leader"), F.col("b").alias("rep")).distinct()
    labelled = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "part", F.coalesce("component", "rep")
    )
    loose = labelled.where("rep <> leader").join(matched, ["leader", "rep"], "left_anti")
    loose = loose.select(
        "band", "value", F.col("rep").alias("x"), F.col("total").alias("total_a"), F.col("marks").alias("marks_a"), F.col("part").alias("part_x")
    )
    rest = (
        loose.join(labelled.select("band", "value", "leader", "rep", "total", "marks", "part"), ["band", "value"])
        .where("x <> rep and rep <> leader and part <> part_x")
        .where(fits)
        .select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b"))
        .distinct()
    )
    rest = checkpoint(rest)
    more = checkpoint(verify(rest, known, idf, similarity).select("a", "b")) if rest.take(1) else rest
    # a doc_id with several texts joins their classes
    same = signed.join(classes.select("md5", "rep"), "md5").select("doc_id", "rep")
    least = checkpoint(same.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")))
    several = same.join(least.where("least < most").select("doc_id", "least"), "doc_id").where("rep > least")
    more = more.unionByName(several.select(F.col("least").alias("a"), F.col("rep").alias("b")))
    # what is left joins the components so far, of which each is one node
    label = lambda df, name: df.join(parts.toDF(name, "_part"), name, "left").withColumn(name, F.coalesce("_part", name)).drop("_part")
    last = connected_components(label(label(more, "a"), "b"))
    own = label(least.select("doc_id", F.col("least").alias("part")), "part")
    own = own.join(last.toDF("part", "_last"), "part", "left").select("doc_id", F.coalesce("_last", "part").alias("class_id"))
    out = docs.select("doc_id").join(own, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without the documents that are not the least of their class."""
    gone = checked_ids(near_duplicates(docs, similarity).where("not kept").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
