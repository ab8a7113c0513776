"""Language identification by hyperdimensional profiles.

Each letter has a seeded random vector of +1 and -1. A trigram is the product of its letters' vectors,
permuted (rolled) by their place; a text is the sum of its trigrams, a language the sum of its texts.
Words are delimited by one boundary letter. Documents are compared with the languages by cosine,
both taken relative to the mean of the languages, as what all languages share decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import bounded_batches, read

DIMENSIONS = 512
SEED = 20_011
UNDETERMINED = "und"
CHUNK_CHARS = 1 << 20
#: A text of so many letters with a lesser cosine is in none of the languages. Random letters and other scripts have up to
#: 0.1 (random vectors: a deviation of 0.044), clean texts of such length 0.43 at least (sf0.01).
LEAST_LETTERS, LEAST_SCORE = 200, 0.11


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint64)
    for block in range(0, 0x110000, 0x1000):
        for point in range(block, block + 0x1000):
            if not 0xD800 <= point < 0xE000 and chr(point).isalpha():
                table[point] = point
    return table


class Profiles:
    """Trigram vectors, made as they are met; kept while they are fewer than `most`."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED, most: int = 60_000):
        self.dimensions, self.seed, self.most = dimensions, seed, most
        self.letter: dict[int, np.ndarray] = {}
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, dimensions), np.int8)

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letter:
            bits = np.random.Generator(np.random.Philox(key=self.seed, counter=point)).integers(0, 2, self.dimensions)
            self.letter[point] = (bits * 2 - 1).astype(np.int8)
        return self.letter[point]

    def _stacked(self, points: np.ndarray, roll: int) -> np.ndarray:
        distinct, at = np.unique(points, return_inverse=True)
        return np.roll(np.stack([self._letter(int(p)) for p in distinct]), roll, axis=1)[at]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Rows of +1 and -1 for sorted distinct trigram keys."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        missing = keys if not len(self.keys) else keys[self.keys[at] != keys]
        if len(missing):
            new = (
                self._stacked(missing >> np.uint64(42), 2)
                * self._stacked((missing >> np.uint64(21)) & np.uint64(0x1FFFFF), 1)
                * self._stacked(missing & np.uint64(0x1FFFFF), 0)
            )
            if len(self.keys) + len(missing) > self.most:
                if len(missing) == len(keys):
                    self.keys, self.rows = missing, new
                    return new
                self.keys, self.rows = np.zeros(0, np.uint64), self.rows[:0]
                return self.vectors(keys)
            merged = np.concatenate([self.keys, missing])
            order = np.argsort(merged, kind="stable")
            self.keys, self.rows = merged[order], np.concatenate([self.rows, new])[order]
            at = np.searchsorted(self.keys, keys)
        return self.rows[at]

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dimensions)
        for i in range(0, len(keys), 8192):
            part = self.vectors(keys[i : i + 8192]).astype(np.float32)
            out += counts[i : i + 8192].astype(np.float32) @ part
        return out


def trigrams(text: str | None) -> np.ndarray:
    """Keys of all trigrams of the whole text, 21 bits a letter; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[points]
    here = letters > 0
    if not here.any():
        return np.zeros(0, np.uint64)
    keep = here.copy()
    keep[1:] |= here[:-1]  # one boundary after each word
    letters = np.concatenate([np.zeros(1, np.uint64), letters[keep]])
    letters = letters if letters[-1] == 0 else np.concatenate([letters, np.zeros(1, np.uint64)])
    if len(letters) > 1 and letters[0] == 0 and letters[1] == 0:
        letters = letters[1:]
    return (letters[:-2] << np.uint64(42)) | (letters[1:-1] << np.uint64(21)) | letters[2:]


def _train(batches: Iterator[pd.DataFrame], dimensions: int, seed: int) -> Iterator[pd.DataFrame]:
    profiles = Profiles(dimensions, seed)
    sums: dict[str, np.ndarray] = {}

    def add(lang: str, parts: list[np.ndarray]) -> None:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        sums[lang] = sums.get(lang, 0.0) + profiles.bundle(keys, counts)

    waiting: dict[str, tuple[list, int]] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            keys = trigrams(text)
            if len(keys):
                parts, n = waiting.get(lang, ([], 0))
                parts.append(keys)
                if n + len(keys) > CHUNK_CHARS:
                    add(lang, parts)
                    waiting.pop(lang)
                else:
                    waiting[lang] = (parts, n + len(keys))
    for lang, (parts, _) in waiting.items():
        add(lang, parts)
    for lang, total in sums.items():
        yield pd.DataFrame({"lang": lang, "place": np.arange(dimensions), "value": total})


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit vectors of all non-null `lang` values of `docs`, from the whole of every text.

    Each task sums its own texts, so what is shuffled and collected is languages x dimensions.
    """
    bounded_batches(docs.sparkSession)
    rows = (
        docs.where("lang is not null and text is not null")
        .select("lang", "text")
        .mapInPandas(lambda it: _train(it, dimensions, seed), "lang string, place int, value double")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
    )
    vectors: dict[str, np.ndarray] = {}
    for lang, place, value in rows.collect():
        vectors.setdefault(lang, np.zeros(dimensions))[place] = value
    return {k: v / np.linalg.norm(v) for k, v in sorted(vectors.items()) if np.linalg.norm(v) > 0}


def predict(
    docs: DataFrame, languages: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED
) -> DataFrame:
    """`docs` with lang_pred and score (0 to 1) for every row; only `text` is looked at.

    Null texts and texts without a letter, and all texts if nothing was learned, are `und` with score
    0. Ties go to the language that sorts first. Columns of these two names are replaced.
    """
    bounded_batches(docs.sparkSession)
    names = list(languages)
    made = ("lang_pred", "score")
    fields = [f for f in docs.schema.fields if f.name not in made]
    docs = docs.select(*[docs[f.name] for f in fields])
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if names:
        matrix = np.stack([languages[n] for n in names])
        middle = matrix.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
        matrix = matrix - middle
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions, seed)
        for batch in batches:
            found, scores = [], []
            for text in batch.column("text"):
                keys = trigrams(text.as_py()) if names else ()
                if not len(keys):
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                vector = profiles.bundle(*np.unique(keys, return_counts=True))
                vector = vector / max(np.linalg.norm(vector), 1e-12) - middle
                cosines = matrix @ vector / max(np.linalg.norm(vector), 1e-12)
                best = int(np.argmax(cosines))
                found.append(names[best])
                scores.append(float(min(max(cosines[best], 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [f.name for f in schema]
            )

    return docs.mapInArrow(run, schema)


def accepted(told: DataFrame, languages: dict[str, np.ndarray]) -> DataFrame:
    """The rows of predict() whose language is told.

    Rejected are null texts, texts without a letter and, where two languages or more were learned, texts of
    LEAST_LETTERS letters with a score below LEAST_SCORE; shorter ones are too little evidence for that. If
    nothing was learned only the former go.
    """
    if not languages:
        return told.where(F.col("text").rlike(r"\p{L}"))
    letters = F.length(F.regexp_replace("text", r"\P{L}", ""))
    alien = (F.col("score") < LEAST_SCORE) & (letters >= LEAST_LETTERS) if len(languages) > 1 else F.lit(False)
    return told.where((F.col("lang_pred") != UNDETERMINED) & ~alien)


def held_out(docs: DataFrame) -> DataFrame:
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    return docs.withColumn("held_out", rest == 2)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(read(spark, sf_dir, "documents"))
    languages = learn(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), languages).drop("text")
