"""Benchmark decontamination: q-gram lemma filtering with banded alignment.

Texts are compared as runs of lower-case letters and digits with one space between them. Every
benchmark item is cut into overlapping segments; a document holds an item if it holds a segment
within the edit budget. A segment of n characters with at most e edits shares at least
n + 1 - q(e + 1) of its q-grams, all of them on e + 1 neighbouring diagonals. So the shared q-grams
are counted in bands of 2(e + 1) diagonals that overlap by half, bands below the bound are dropped,
and what remains is verified by banded alignment of the segment with the band's region. Items of
fewer than LEAST characters are too short for edits: they are held where they stand exactly, as whole
words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.codes import SPACE, STOP, lowered, normal
from quernstone.llm.common import bounded_batches, checked_ids, read

Q = 8
SEGMENT, STRIDE = 80, 40
BUDGET = 0.1
LEAST = 24  # characters of an item that may hold edits; shorter ones, from Q characters, must be exact
POSTINGS = 2_000_000  # meetings of a document's q-grams with segments that are counted at once
#: Characters of benchmark text that one pass over the documents takes; more are taken in blocks.
BLOCK_CHARS = 8_000_000
BUFFER_CHARS = 1 << 20
BITS = 22
BASE = 0x9E3779B97F4A7C15
WRAP = (1 << 64) - 1
MATCHES = "doc_id long, item_id long, start long, end long, edits int"


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 8 codes, by doubling."""
    h = codes.astype(np.uint64)
    step, base = 1, BASE
    while step < Q:
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * np.uint64(base) + h[step:]
        base = (base * base) & WRAP
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


@dataclass
class Index:
    """Segments of benchmark items: their codes, bounds and q-grams."""

    item: np.ndarray
    codes: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    begin: np.ndarray
    segment: np.ndarray
    place: np.ndarray
    order: np.ndarray  # rank of the q-gram times the number of segments, plus the segment; ascending
    bits: np.ndarray


def index_items(items: list[tuple[int, str]]) -> Index | None:
    item, codes, budget, need, hashes, segs, places = [], [], [], [], [], [], []
    for key, text in items:
        whole, _ = normal(lowered(text or ""))
        whole = whole[whole != STOP]
        if len(whole) and whole[-1] == 32:
            whole = whole[:-1]
        if len(whole) and whole[0] == 32:
            whole = whole[1:]
        n = len(whole)
        if n < Q:
            continue
        starts = sorted({*range(0, max(n - SEGMENT, 0) + 1, STRIDE), max(n - SEGMENT, 0)})
        for s in starts:
            part = whole[s : s + SEGMENT]
            e = min(int(BUDGET * len(part)), (len(part) - Q) // Q) if n >= LEAST else 0
            h = grams(part)
            segs.append(np.full(len(h), len(item)))
            places.append(np.arange(len(h)))
            hashes.append(h)
            item.append(key)
            codes.append(part)
            budget.append(e)
            need.append(len(part) + 1 - Q * (e + 1))
    if not item:
        return None
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    keys, begin = np.unique(h[order], return_index=True)
    bits = np.zeros(1 << BITS, bool)
    bits[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
    begin = np.append(begin, len(h))
    segment = np.concatenate(segs)[order]
    ranked = np.repeat(np.arange(len(keys)), np.diff(begin)) * len(item) + segment
    return Index(
        np.array(item), codes, np.array(budget), np.array(need), keys, begin, segment, np.concatenate(places)[order], ranked, bits
    )


def align(pattern: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of the whole pattern in `text`, on diagonals first..last, or None above `most`.

    Only cells on those diagonals and `most` to either side are filled, row by row of the pattern.
    """
    low, width = first - most, last - first + 2 * most + 1
    diag = np.arange(low, low + width)
    far = len(pattern) + most + 1
    ok = (diag >= 0) & (diag <= len(text))
    cost = np.where(ok, 0, far)
    start = diag.copy()
    slots = np.arange(width)
    for i, code in enumerate(pattern):
        at = diag + i  # the text character that a diagonal step takes
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == code
        step = np.where(inside, cost + ~same, far)
        drop = np.append(cost[1:] + 1, far)  # pattern character without text
        new = np.minimum(step, drop)
        began = np.where(step <= drop, start, np.append(start[1:], 0))
        # text characters without pattern: a running minimum along the row
        lead = new - slots
        best = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == best, slots, 0))
        fits = (at + 1 >= 0) & (at + 1 <= len(text))
        cost = np.where(fits, best + slots, far)
        start = began[source]
        if cost.min() > most:
            return None
    k = int(np.argmin(cost))
    return (int(cost[k]), int(start[k]), int(diag[k] + len(pattern))) if cost[k] <= most else None


def within_budget(
    codes: np.ndarray, patterns: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, span: int, most: int
) -> np.ndarray:
    """Edits of align() for many (pattern row, first diagonal) at once, each in codes[low:high]; above `most`: most + 1.

    Costs only, all candidates a row of the pattern at a time; the hopeless leave every few rows.
    """
    n = patterns.shape[1]
    width = span + 2 * most
    slots = np.arange(width, dtype=np.int16)
    out = np.full(len(patterns), most + 1)
    alive = np.arange(len(patterns))
    diag = first[:, None] - most + slots
    far = np.int16(n + most + 1)
    cost = np.where((diag >= low[:, None]) & (diag <= high[:, None]), np.int16(0), far)
    low, high = low[:, None], high[:, None]
    for i in range(n):
        at = diag + i
        inside = (at >= low) & (at < high)
        same = inside & (codes[np.minimum(np.maximum(at, 0), len(codes) - 1)] == patterns[:, i, None])
        step = np.where(inside, cost + ~same, far)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + np.int16(1))
        step = np.minimum.accumulate(step - slots, axis=1) + slots
        cost = np.where((at + 1 >= low) & (at + 1 <= high), step, far)
        if i % 6 == 5 or i == n - 1:
            good = cost.min(axis=1) <= most
            if not good.all():
                alive, diag, cost, low, high, patterns = (x[good] for x in (alive, diag, cost, low, high, patterns))
                if not len(alive):
                    return out
    out[alive] = cost.min(axis=1)
    return out


def _meetings(index: Index, hit: np.ndarray, slot: np.ndarray, first: int, last: int) -> Iterator[tuple]:
    """(place in the buffer, segment, place in it) of the q-grams `slot` that stand at `hit`, for segments first..last.

    A q-gram that many segments have meets them all at each of its places, so segments are halved until no more
    than POSTINGS meetings are held at once; all meetings of a segment come together.
    """
    n = len(index.item)
    low, high = np.searchsorted(index.order, slot * n + first), np.searchsorted(index.order, slot * n + last)
    count = high - low
    total = int(count.sum())
    if total > POSTINGS and last - first > 1:
        middle = (first + last) // 2
        yield from _meetings(index, hit, slot, first, middle)
        yield from _meetings(index, hit, slot, middle, last)
    elif total:
        where = np.repeat(low - np.cumsum(count) + count, count) + np.arange(total)
        yield np.repeat(hit, count), index.segment[where], index.place[where]


def _regions(index: Index, bounds: np.ndarray, at: np.ndarray, segment: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (document, segment, first diagonal) of bands that hold as many shared q-grams as the lemma asks for."""
    diag = at - place
    doc = np.searchsorted(bounds, at, side="right") - 1
    half = index.budget[segment] + 1
    offset = SEGMENT * 2
    for shift in (0, 1):  # two sets of bands, apart by half a band
        band = (diag + offset + shift * half) // (2 * half)
        key = (band * len(index.item) + segment) * len(bounds) + doc
        _, which, n = np.unique(key, return_inverse=True, return_counts=True)
        some = np.flatnonzero(n[which] >= index.need[segment])
        # of those, only different places of the segment count
        both = np.unique(key[some] * SEGMENT + place[some]) // SEGMENT
        keys, n = np.unique(both, return_counts=True)
        d, rest = keys % len(bounds), keys // len(bounds)
        s, band = rest % len(index.item), rest // len(index.item)
        first = band * 2 * (index.budget[s] + 1) - offset - shift * (index.budget[s] + 1)
        yield np.stack([d, s, first])[:, n >= index.need[s]]


def _whole_words(codes: np.ndarray, start: int, end: int) -> bool:
    edge = (SPACE, STOP)
    return (start == 0 or codes[start - 1] in edge) and (end == len(codes) or codes[end] in edge)


def _scan(codes: np.ndarray, bounds: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, segment, start, end, edits) in a buffer of documents; bounds: where each begins, and the end."""
    h = grams(codes)
    hit = np.flatnonzero(index.bits[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    if not len(hit):
        return
    slot = np.searchsorted(index.keys, h[hit])
    slot[slot == len(index.keys)] = 0
    real = index.keys[slot] == h[hit]
    hit, slot = hit[real], slot[real]
    found = [np.zeros((3, 0), np.int64)]
    for at, segment, place in _meetings(index, hit, slot, 0, len(index.item)):
        found += _regions(index, bounds, at, segment, place)
    d, s, first = np.concatenate(found, axis=1)
    if not len(d):
        return
    size = np.array([len(c) for c in index.codes])
    edits = index.budget[s] + 1
    for n in np.unique(size[s]):
        mine = np.flatnonzero(size[s] == n)
        e = int(index.budget[s[mine[0]]])
        distinct, row = np.unique(s[mine], return_inverse=True)
        patterns = np.stack([index.codes[k] for k in distinct])[row]
        edits[mine] = within_budget(
            codes, patterns, first[mine], bounds[d[mine]], bounds[d[mine] + 1] - 1, 2 * e + 2, e
        )
    good = np.flatnonzero(edits <= index.budget[s])
    for doc_at, seg, begin, cost in zip(d[good].tolist(), s[good].tolist(), first[good].tolist(), edits[good].tolist()):
        pattern, e = index.codes[seg], int(index.budget[seg])
        left = max(int(bounds[doc_at]), begin - e)
        right = min(int(bounds[doc_at + 1]) - 1, begin + 2 * (e + 1) + len(pattern) + e)
        if cost == 0:
            for at in range(left, right - len(pattern) + 1):
                end = at + len(pattern)
                if (codes[at:end] == pattern).all() and (len(pattern) >= LEAST or _whole_words(codes, at, end)):
                    yield doc_at, seg, at, end, 0
                    break
            continue
        shown = align(pattern, codes[left:right], begin - left, begin - left + 2 * e + 1, e)
        if shown:
            yield doc_at, seg, left + shown[1], left + shown[2], shown[0]


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, n = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            if not text:
                continue
            ids.append(key)
            texts.append(lowered(text))
            n += len(text) + 1
            if n >= BUFFER_CHARS:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _matches(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for ids, texts in _buffers(batches):
        codes, at = normal("\0".join(texts))
        raw = np.cumsum([0] + [len(t) + 1 for t in texts])
        bounds = np.searchsorted(at, raw)
        best: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        for doc, seg, start, end, edits in _scan(codes, bounds, index):
            s = int(at[start]) - int(raw[doc])
            e = int(at[end - 1]) + 1 - int(raw[doc])
            best[(doc, seg, s)] = (s, e, edits)
        rows = sorted((doc, int(index.item[seg]), *v) for (doc, seg, _), v in best.items())
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[d] for d in columns[0]], pa.int64()),
                pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.int64()),
                pa.array(columns[4], pa.int32()),
            ],
            ["doc_id", "item_id", "start", "end", "edits"],
        )


def segments_found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """MATCHES rows: every segment of an item found in a document, places in code points.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null and empty texts
    match nothing, nor do items of fewer than Q letters and digits; items that repeat are one
    item by their id; documents that repeat are scanned each. Empty tables give an empty result.

    The benchmark is a query set held against all rows: it is cut into blocks of at most
    BLOCK_CHARS characters (or one item), each of which costs one pass over the documents; only a
    block's index goes to the executors. Documents aren't shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text").dropDuplicates()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    found = spark.createDataFrame([], MATCHES)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = index_items([(r[0], r[1]) for r in part])
        if index:
            found = found.unionByName(docs.mapInArrow(lambda it, index=index: _matches(it, index), MATCHES))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_segments, start, end, edits) for every document and item it holds."""
    return (
        segments_found(docs, benchmark)
        .groupBy("doc_id", "item_id")
        .agg(
            F.count("*").alias("n_segments"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.min("edits").alias("edits"),
        )
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item of the benchmark; a null doc_id is never dropped."""
    leaks = checked_ids(segments_found(docs, benchmark).select("doc_id").where("doc_id is not null"))
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))
