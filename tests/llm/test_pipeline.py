"""The pipeline's rows against the stages' plain versions, one on the result of the other."""

import random
from collections import Counter

import numpy as np
from brute import cut, leaks, mix, near_classes, size
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import decontaminate, language, minhash, secrets
from quernstone.llm.common import read
from quernstone.llm.registry import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_language(text, languages):
    """The language of largest cosine, and the cosine, with vectors bound letter by letter."""
    vector, dimensions = {}, language.DIMENSIONS

    def letter(c):
        if c not in vector:
            point = 0 if c == " " else ord(c)
            bits = np.random.Generator(np.random.Philox(key=language.SEED, counter=point)).integers(0, 2, dimensions)
            vector[c] = bits * 2 - 1
        return vector[c]

    words = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    counts = Counter(words[i : i + 3] for i in range(len(words) - 2))
    bundle = sum(n * np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2]) for g, n in counts.items())
    names, middle = sorted(languages), np.mean([languages[n] for n in sorted(languages)], axis=0)
    own = bundle / np.linalg.norm(bundle) - middle
    cosines = [float((languages[n] - middle) @ own / np.linalg.norm(languages[n] - middle) / np.linalg.norm(own)) for n in names]
    best = int(np.argmax(cosines))
    return names[best], min(max(cosines[best], 0.0), 1.0)


def test_predictions_match_a_plain_version(spark):
    docs = language.held_out(read(spark, DATA, "documents"))
    languages = language.learn(docs.where("not held_out"))
    for r in language.predict(docs.select("doc_id", "text"), languages).collect():
        lang, score = plain_language(r.text, languages)
        assert (r.lang_pred, round(r.score, 6)) == (lang, round(score, 6))


def test_languages_fill_and_correct_labels_and_alien_texts_go(spark):
    docs = read(spark, DATA, "documents").select(*COLUMNS).withColumn("lang", F.when(F.col("doc_id") % 10 == 3, "de").when(F.col("doc_id") % 10 != 4, F.col("lang")))
    truth = {r.doc_id: r.lang for r in read(spark, DATA, "documents").collect()}
    got = corpus_pipeline.language_stage(spark, docs, DATA).collect()
    assert len(got) == len(truth) and sum(r.lang == truth[r.doc_id] for r in got) >= 0.95 * len(got)
    r = random.Random(1)
    alien = ["".join(r.choice(letters) for _ in range(1500)) for letters in ("abcdefghijklmnopqrstuvwxyz   ", "абвгдежзиклмнопрст  ")]
    more = docs.unionByName(spark.createDataFrame([(-i, t, None, "x", 1500) for i, t in enumerate(alien, 1)], docs.schema))
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, more, DATA).collect()} == set(truth)
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_stage(spark, blank, DATA).count() == len(truth)


def test_run_matches_the_plain_stages(spark):
    rows = [tuple(r) for r in read(spark, DATA, "documents").select(*COLUMNS).collect()]
    languages = language.learn(language.held_out(read(spark, DATA, "documents")).where("not held_out"))
    told = [(r, *plain_language(r[1], languages)) for r in rows if any(c.isalpha() for c in r[1] or "")]
    rows = [(r[0], r[1], lang, r[3], r[4]) for r, lang, score in told if score >= language.LEAST_SCORE or sum(c.isalpha() for c in r[1]) < language.LEAST_LETTERS]
    assert rows and sum(r[2] == lang for r, lang, _ in told) >= 0.98 * len(told)
    kept = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = minhash.idf_table(kept)
    idf = lambda g: float(table[minhash._slots(minhash.shingles([" ".join(g)])[0][0])[0]])
    classes = near_classes({r[0]: r[1] for r in rows}, idf)
    rows = [r for r in rows if classes[r[0]] == r[0]]
    held = {r.doc_id for r in decontaminate.contaminated(kept, read(spark, DATA, "benchmark")).collect()}
    items = {r.item_id: r.text for r in read(spark, DATA, "benchmark").collect()}
    some = {r[0]: r[1] for r in rows if r[0] in held} | {r[0]: r[1] for r in rows[:12]}
    assert {d for d, _ in leaks(some, items)} == held & set(some)
    rows = [r for r in rows if r[0] not in held]
    kept = kept.where(F.col("doc_id").isin([r[0] for r in rows]))
    spans = {r.doc_id: [tuple(x) for x in r.found] for r in secrets.scan(kept).collect()}
    rows = [(i, cut(t, spans[i]), lang, s, len(cut(t, spans[i])) if spans[i] else n) for i, t, lang, s, n in rows]
    taken = mix([(r[0], r[3], r[1]) for r in rows])
    want = []
    for r, t in zip(rows, taken):
        n, epoch = size(r[1]), 0
        while t > 0:
            want.append((r[0], epoch, min(n, t), r[2], r[3], r[1] if t >= n else None))
            t, epoch = t - n, epoch + 1
    got = [(r.doc_id, r.epoch, r.epoch_words, r.lang, r.source, r.text) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert sorted(x[:5] for x in got) == sorted(x[:5] for x in want)
    whole = {x[:2]: x[5] for x in want if x[5] is not None}
    assert all(text == whole.get((i, e), text) and size(text) == n for i, e, n, _, _, text in got)


def test_stages_return_the_columns_of_documents_and_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 !", "en", "a", 4), (4, "some words here", None, None, 15)]
    rows += [(4, "some words here", None, None, 15), (None, "token=abcdef text", "en", "b", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, "[SECRET] text"), (4, "some words here"), (4, "some words here")]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.columns[:5] == COLUMNS and last.count() >= 3
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_registry_has_the_eleven(spark):
    names = list(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names
    assert set(oracle_sql()) <= set(names) and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
