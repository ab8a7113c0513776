"""The corpus pipeline: language, near-duplicates, benchmark leaks, secrets, then the mix of sources.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Between stages the
rows are written as Parquet to the shared checkpoint folder and read again, so a stage starts from files
and not from a lineage. Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontaminate, language, minhash, mixing, secrets
from quernstone.llm.common import new_folder, read, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predicts each text's language and writes it to `lang`, over a label that is null or says otherwise.

    Languages are learned from three quarters of the labelled texts. Documents go whose language can't be told
    (language.accepted): null texts, texts without a letter, and long texts that are near to no language. If no
    document has a label, nothing is learned and lang stays null. Rows that repeat, or have no doc_id, are told
    each; ties go to the language that sorts first; an empty table stays empty; columns other than those of
    documents are dropped.
    """
    languages = language.learn(language.held_out(docs).where("not held_out"))
    told = language.accepted(language.predict(docs.select(*COLUMNS), languages), languages)
    return told.withColumn("lang", F.when(F.col("lang_pred") != language.UNDETERMINED, F.col("lang_pred"))).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates.

    Texts without words (null and empty ones too) and rows without a doc_id are no duplicates and stay. Rows that
    repeat a doc_id are one document and stay or go together. An empty table stays empty.
    """
    return minhash.keep_one(docs).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage.

    Null and empty texts hold none, nor are null items held. Rows that repeat a doc_id go together, a row
    without one stays. An empty table stays empty, and an empty benchmark leaves all.
    """
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by a mark and n_chars to match.

    Null texts stay null; rows that repeat are cut each; an empty table stays empty.
    """
    return secrets.redact(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and repetition that the mix takes; the last may hold the first words only.

    A null source is a source of its own; texts without words are taken no times; rows that repeat are each a
    document. The choice is by hash, so reruns agree. An empty table gives no rows.
    """
    return mixing.repeat(docs.select(*COLUMNS))


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: No SQL: the language, near-duplicate and alignment stages can't be expressed; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's rows are deleted when the next one's are written, the last's at the session's end."""
    docs, last = read(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            break
        folder = new_folder(spark, f"pipeline-{number}")
        out.write.parquet(folder)
        if last:
            remove(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(folder), folder
    return out
