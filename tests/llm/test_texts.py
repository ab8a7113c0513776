"""Near-duplicates, decontamination, language and quality against plain versions, and their edge cases."""

import math
import random
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import edits_within, leaks, near_classes, plain, segments, shingles, weighted_jaccard
from pyspark.sql import functions as F

from quernstone.llm import codes, decontaminate, language, minhash, quality
from quernstone.llm.common import connected_components, read, remove
from quernstone.llm.registry import queries

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)
VOCABULARY = ["".join(rng.choice(["th", "er", "on", "an", "re", "é", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def change(text, n, seed):
    r, w = random.Random(seed), text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"new{seed}x{k}"
    return " ".join(w)


# components


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    from brute import components

    r = random.Random(seed)
    links = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 230)]
    links += [(5, 5), (None, 3), links[0]]
    r.shuffle(links)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None]
    want = components({n for e in real for n in e} | {3}, real)
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# near-duplicates


def test_shingles_match_plain_ones():
    texts = ["", "one", "One, TWO three", prose(300, 1), "a b c d e f a b c d e f a b c d e", "Łódź ẞ İstanbul 𝒳𝒴 x_y z", "\0a\0b c d e f"]
    for text, (grams, counts) in zip(texts, minhash.shingles(texts)):
        want = shingles(text)
        assert sorted(counts.tolist()) == sorted(want.values()) and len(set(grams.tolist())) == len(want), text
    alone = [minhash.shingles([t])[0] for t in texts]
    for a, b in zip(alone, minhash.shingles(texts)):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_samples_agree_as_often_as_the_similarity():
    base = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    sampler = minhash.Sampler(512)
    r = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.9):
        n = int(2000 * share)
        a, b = np.sort(base[:2000]), np.sort(np.concatenate([base[:n], base[2000 : 4000 - n]]))
        weight = {int(g): float(w) for g, w in zip(base, r.uniform(0.5, 4.0, len(base)))}
        wa, wb = (np.array([weight[int(g)] for g in s], np.float32) for s in (a, b))
        wb = wb * np.float32(1.2)
        true = minhash.weighted_jaccard((a, wa), (b, wb))
        assert abs((sampler(a, wa) == sampler(b, wb)).mean() - true) < 0.08


def test_near_duplicates_match_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    base = prose(200, 5)
    rows += [(10_000 + k, change(base, k, 100 + k)) for k in range(8)] + [(10_020, base), (10_021, base)]
    rows += [(11_000 + k, prose(20, 7) + " " + prose(60, 300 + k)) for k in range(30)]
    docs = frame(spark, rows)
    table = minhash.idf_table(docs)
    idf = lambda g: float(table[minhash._slots(minhash.shingles([" ".join(g)])[0][0])[0]])
    want = near_classes(dict(rows), idf)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    border = {  # pairs that float32 or sampling may decide either way
        i for i in got if got[i] != want[i]
    }
    assert len(border) <= 1, {i: (got[i], want[i]) for i in border}


def test_agreeing_samples_tell_far_pairs_from_near_ones(spark):
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, (400, minhash.BANDS * minhash.ROWS), dtype=np.uint64) << np.uint64(1)
    b = np.where(r.random(a.shape) < np.repeat([[0.8], [0.3]], 200, axis=0), a, r.integers(0, 1 << 63, a.shape, dtype=np.uint64) << np.uint64(1))
    rows = [(minhash.nibbles(x).view(np.int64).tolist(), minhash.nibbles(y).view(np.int64).tolist()) for x, y in zip(a, b)]
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [x[0] for x in frame.select(minhash.agreeing(F.col("a"), F.col("b"))).collect()]
    assert got == ((a >> np.uint64(60)) == (b >> np.uint64(60))).sum(axis=1).tolist()
    least = minhash.least_agreeing(0.8)
    assert all(n >= least for n in got[:200]) and sum(n >= least for n in got[200:]) <= 4


def test_a_doc_id_with_several_texts_joins_their_classes(spark):
    a, b = prose(80, 1), prose(80, 2)
    rows = [(1, a), (2, b), (3, a), (3, b), (4, prose(80, 3)), (5, change(b, 1, 4))]
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (5, 1)]


def test_near_copies_are_found(spark):
    """Of copies with a few words changed, those of a similarity of 0.8 or more: at least 99 in 100."""
    rows, pairs = [], []
    for k in range(60):
        text = prose(150 + k, 2000 + k)
        rows.append((3 * k, text))
        for i in (1, 2):
            rows.append((3 * k + i, change(text, i + k % 3, 4000 + 3 * k + i)))
            pairs.append((3 * k, 3 * k + i))
    docs = frame(spark, rows)
    idf = minhash.idf_table(docs)
    sets = {i: s for (i, _), s in zip(rows, minhash.shingles([t for _, t in rows]))}
    near = [(a, b) for a, b in pairs if minhash.weighted_jaccard(*[(sets[i][0], minhash.weights(*sets[i], idf)) for i in (a, b)]) >= 0.8]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert len(near) > 60 and sum(got[a] == got[b] for a, b in near) >= 0.99 * len(near)
    assert all(got[i] // 3 == i // 3 for i in got)


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " ,. "), (4, None), (5, "a b"), (6, "a  b"), (7, "A, b"), (8, long), (9, long + " end"), (None, "a b")]
    rows += [(5, "a b"), (20, "same text of five words"), (19, "same text of five words")]
    docs = frame(spark, rows).withColumn("class_id", F.lit("clash"))
    got = sorted(((r.doc_id or -1, r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([
        (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False),
        (8, 8, True), (9, 8, False), (-1, None, True), (20, 19, False), (19, 19, True),
    ], key=repr)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash.keep_one(docs).select("doc_id").collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 2, 3, 4, 5, 5, 8, 19]


def test_members_that_their_leader_does_not_link_are_still_linked(spark):
    # 0 is least and like neither of 1 and 2, which are alike; a chain links what isn't alike at its ends
    shared = prose(100, 9)
    rows = [(0, shared + " " + prose(45, 10)), (1, shared + " " + prose(60, 12)), (2, change(shared + " " + prose(60, 12), 2, 3))]
    chain = [prose(300, 20)]
    for k in range(6):
        chain.append(change(chain[-1], 4, 500 + k))
    rows += [(100 + k, t) for k, t in enumerate(chain)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got[1] == got[2] == 1 and got[0] == 0
    assert {got[100 + k] for k in range(7)} == {100}


def test_weighted_jaccard_matches_plain():
    a, b = prose(120, 1), change(prose(120, 1), 5, 2)
    pair = [(g, minhash.weights(g, n, np.full(1 << minhash.SKETCH_BITS, 1.5, np.float32))) for g, n in minhash.shingles([a, b])]
    assert abs(minhash.weighted_jaccard(*pair) - weighted_jaccard(shingles(a), shingles(b), lambda g: 1.5)) < 1e-5
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
    assert minhash.weighted_jaccard(nothing, pair[0]) == minhash.weighted_jaccard(pair[0], nothing) == minhash.weighted_jaccard(nothing, nothing) == 0


# decontamination


def test_align_matches_a_full_table():
    r = random.Random(4)
    for _ in range(150):
        text = "".join(r.choice("abc ") for _ in range(r.randint(30, 90)))
        n = r.randint(12, 40)
        at = r.randint(0, max(0, len(text) - n))
        pattern = list(text[at : at + n])
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(pattern))
            pattern[k : k + 1] = r.choice([[], ["x"], ["a", "b"]])
            if not pattern:
                pattern = ["a"]
        code = lambda s: np.array([ord(c) for c in s], np.uint32)
        p, t, most = code(pattern), code(text), 4
        best = edits_within("".join(pattern), text)
        found = decontaminate.align(p, t, at - 4, at + 4, most)
        batch = decontaminate.within_budget(t, p[None], np.array([at - 4]), np.array([0]), np.array([len(t)]), 9, most)[0]
        assert batch == (found[0] if found else most + 1)
        if found:
            assert edits_within("".join(pattern), text[found[1] : found[2]]) == found[0] >= best
        elif best <= most:
            assert all(edits_within("".join(pattern), text[max(0, at - 8) : at + n + 8]) > most - 4 for _ in [0])


def test_decontamination_matches_brute_force(spark):
    r = random.Random(6)
    items = [(i, prose(r.randint(5, 60), 700 + i)) for i in range(14)] + [(50, "short one"), (51, None), (52, "")]
    docs = [(i, prose(r.randint(0, 120), 900 + i)) for i in range(40)]
    for i in range(60):
        k = r.randrange(14)
        text, noise = items[k][1], list(items[k][1])
        if i % 4 == 1:
            noise = list(text.upper().replace(" ", " \n, "))
        for _ in range({2: 3, 3: 40}.get(i % 4, 0)):
            noise[r.randrange(len(noise))] = r.choice("qxz")
        part = "".join(noise)
        part = part[: len(part) // 2] if i % 5 == 4 else part
        docs.append((100 + i, f"{prose(r.randint(0, 80), i)} {part} {prose(r.randint(0, 80), 50 + i)}"))
    docs += [(300, None), (301, ""), (302, "x"), (303, "a Short, ONE!"), (304, "short ones"), (305, "xshort one"), (306, "short one short one")]
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string").withColumn("doc_id", F.lit(7))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    want = leaks({i: t or "" for i, t in docs}, {i: t or "" for i, t in items})
    assert got == want and len(want) > 30 and {(303, 50), (306, 50)} <= got
    assert {(r.doc_id, r.start, r.end) for r in decontaminate.segments_found(frame(spark, docs[-4:]), bench).collect()} == {(303, 2, 12), (306, 0, 9)}


def test_a_qgram_that_all_segments_share_is_counted_in_parts(spark, monkeypatch):
    items = [(i, "the same opening words of all items " + prose(12, 300 + i)) for i in range(60)]
    docs = frame(spark, [(i, "the same opening words of all items " * 20 + items[i][1]) for i in range(12)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.segments_found(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "POSTINGS", 500)
    assert sorted(map(tuple, decontaminate.segments_found(docs, bench).collect())) == whole and len(whole) >= 12


def test_spans_point_at_the_passage(spark):
    item = prose(40, 1)
    docs = frame(spark, [(1, "İntro ẞ, " + item.upper() + "! tail")])
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    (row,) = decontaminate.contaminated(docs, bench).collect()
    text = docs.first().text
    assert plain(text[row.start : row.end]) == plain(item) and row.edits == 0


def test_benchmark_is_taken_in_blocks(spark, monkeypatch):
    docs, bench = read(spark, DATA, "documents"), read(spark, DATA, "benchmark")
    whole = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2500)
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()} == whole and whole


def test_decontamination_of_odd_tables(spark):
    bench = spark.createDataFrame([(9, prose(30, 1)), (None, prose(30, 2))], "item_id long, text string")
    docs = frame(spark, [(1, prose(30, 1)), (1, prose(30, 1)), (2, "clean"), (None, prose(30, 1)), (None, None)])
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert sorted(r.doc_id or -1 for r in decontaminate.remove_contaminated(docs, bench).collect()) == [-1, -1, 2]


def test_segments_cover_items():
    item = plain(prose(60, 3))
    index = decontaminate.index_items([(1, item)])
    assert ["".join(map(chr, c)) for c in index.codes] == segments(item)


def test_lowering_keeps_places():
    for text in ("İẞŁ𝒳", "plain", "ŉ"):
        assert len(codes.lowered(text)) == len(text)


# language


def test_held_out_accuracy_and_columns(spark):
    rows = queries()["op5_language"](spark, MORE).join(read(spark, MORE, "documents").select("doc_id", "lang"), "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0.0 <= r.score <= 1.0 for r in rows)


def test_trigrams_match_plain_ones():
    for text in ("", "a", "Ab, c!", "  x1y2z  ", "łódź-𝒳", "...", "a" * 100):
        w = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        padded = f" {w} " if w else ""
        want = sorted(padded[i : i + 3] for i in range(len(padded) - 2))
        got = sorted("".join(chr(int(k) >> s & 0x1FFFFF or 32) for s in (42, 21, 0)) for k in language.trigrams(text))
        assert got == want, text


def test_trigram_vectors_are_bound_and_cached():
    small, big = language.Profiles(most=3), language.Profiles()
    keys = np.unique(language.trigrams("the quick brown fox jumps"))
    assert (small.vectors(keys) == big.vectors(keys)).all() and (big.vectors(keys[3:5]) == big.vectors(keys)[3:5]).all()
    a, b, c = (big._letter(ord(x)) for x in "the")
    at = int(np.flatnonzero(keys == language.trigrams("the")[1])[0])
    assert (big.vectors(keys)[at] == np.roll(a, 2) * np.roll(b, 1) * c).all()
    assert set(np.unique(big.vectors(keys))) == {-1, 1}


def test_language_of_odd_rows(spark):
    train = spark.createDataFrame([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de"), (None, "fr"), ("12", "es"), ("x y", None)], "text string, lang string")
    known = language.learn(train)
    assert sorted(known) == ["de", "en"]
    rows = [(2**60 + 1, None), (2, ""), (3, "123 !"), (4, "the dog"), (4, "the dog"), (None, "die katze und der hund " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = [(r.doc_id, r.lang_pred) for r in language.predict(docs, known).collect()]
    assert sorted(got, key=repr) == sorted([(2**60 + 1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de")], key=repr)
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}
    assert language.predict(docs.limit(0), known).count() == 0 and language.learn(train.limit(0)) == {}


# quality


def symbols(text):
    """Of a text whose white space is normal: code points below 1984, else two parts, from the docs."""
    out = []
    for c in map(ord, text):
        out += [c] if c < 1984 else [1984 + (c >> 10), 3072 + (c & 1023)]
    return out


def kneser_ney(texts, order=3):
    """p(next | context) as a function, from definitions."""
    pad = lambda t: [0] * (order - 1) + symbols(t)
    counts = {order: Counter()}
    for t in texts:
        p = pad(t)
        for i in range(order - 1, len(p)):
            counts[order][tuple(p[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    vocabulary = len(counts[1]) + 1

    def discounts(k):
        n = [0] + [sum(v == c for v in counts[k].values()) for c in (1, 2, 3, 4)]
        if min(n[1:]) == 0:
            return (0.5, 0.75, 0.9)
        y = n[1] / (n[1] + 2 * n[2])
        return tuple(min(max(c - (c + 1) * y * n[c + 1] / n[c], 0.05), c - 0.05) for c in (1, 2, 3))

    d = {k: discounts(k) for k in counts}

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / vocabulary
        same = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return lower
        cut = lambda c: d[k][min(c, 3) - 1]
        total = sum(same.values())
        own = max(same.get(gram, 0) - cut(same[gram]), 0) if gram in same else 0
        return own / total + sum(min(cut(c), c) for c in same.values()) / total * lower

    return p


def plain_bits(texts, judged):
    p = kneser_ney(texts, quality.ORDER)
    code = [0] * (quality.ORDER - 1) + symbols(judged or "")
    return -sum(math.log2(p(tuple(code[k - quality.ORDER + 1 : k + 1]))) for k in range(quality.ORDER - 1, len(code)))


def scores(docs, texts):
    rows = docs.select("doc_id", F.lit(False).alias("train"), "text")
    both = rows.unionByName(texts.select(F.lit(-1).cast("long").alias("doc_id"), F.lit(True).alias("train"), "text"))
    scored, folder = quality.perplexities(both)
    rows = [(r.doc_id, r.bits, r.chars) for r in scored.where("not train").collect()]
    remove(docs.sparkSession, folder)
    return rows


def test_perplexity_matches_definitions(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("aab cł漢語") for _ in range(r.randint(1, 40))).strip() or "a" for _ in range(40)]
    texts = [" ".join(t.split()) or "a" for t in texts]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    judged = ["abc", "cab ab a", "zzz", "ł" * 30, "a", "", None, "qab zab", "漢語 ab", "字a漢", "\U0001f600"]
    got = {i: (bits, chars) for i, bits, chars in scores(spark.createDataFrame(list(enumerate(judged)), "doc_id long, text string"), train)}
    for i, text in enumerate(judged):
        assert got[i][1] == len(text or "") and got[i][0] == pytest.approx(plain_bits(texts, text), abs=1e-6), text


def test_scores_are_the_same_in_any_number_of_shards_and_blocks(spark, monkeypatch):
    docs = read(spark, DATA, "documents").select("doc_id", "text").limit(60)
    texts = [r.text for r in docs.limit(6).collect()]
    same = docs.first().doc_id
    more = [(same, texts[0]), (same, texts[0]), (same, texts[1])] + [(None, t) for t in (*texts, texts[2], None, "")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = lambda shards, blocks: sorted(((i, round(b, 4), c) for i, b, c in with_shards(shards, blocks)), key=repr)

    def with_shards(shards, blocks):
        spark.conf.set("spark.sql.shuffle.partitions", str(shards))
        monkeypatch.setattr(quality, "BUFFER_KEYS", 3000 * shards)
        try:
            return scores(docs.repartition(blocks), docs.select("text"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    whole = rows(1, 1)
    assert len(whole) == 72 and rows(5, 7) == whole


def test_other_texts_at_the_second_reading_are_an_error(spark):
    def other(batches):
        for batch in batches:
            text = pa.array([uuid.uuid4().hex for _ in range(batch.num_rows)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([True] * batch.num_rows), text], ["doc_id", "train", "text"])

    scored, folder = quality.perplexities(spark.range(3).mapInArrow(other, "doc_id long, train boolean, text string"))
    with pytest.raises(Exception, match="other texts"):
        scored.collect()
    remove(spark, folder)


def test_limits_and_decisions_match_a_plain_version(spark):
    """Limits by language from held-out trusted rows, and keep, over rows that repeat and have no id or language."""
    rows = [(r.doc_id, r.text, r.lang) for r in read(spark, MORE, "documents").where("doc_id < 300").collect()]
    rows += [rows[0], rows[0], (rows[0][0], rows[1][1], "xx"), (None, rows[2][1], None), (5, "", "en"), (6, None, "en"), (7, "Zq Zq Zq", "xx")]
    trusted = sorted({r[0] for r in rows if r[0] is not None and r[0] % 3})
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.judge(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()
    picked = {r.doc_id for r in docs.select("doc_id").distinct().where(F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 0).collect()}
    texts = [t for i, t, _ in rows if i in trusted and i not in picked and t is not None]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    numbered = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "doc_id long, text string")
    bits = {k: (b, c) for k, b, c in scores(numbered, train)}
    perplexity = {k: 2 ** (b / c) if c else None for k, (b, c) in bits.items()}

    def quantile(values, q):
        return sorted(values)[max(math.ceil(q * len(values)) - 1, 0)]

    held = [(rows[k][2], v) for k, v in perplexity.items() if v is not None and rows[k][0] in trusted and rows[k][0] in picked]
    want = []
    for k, (doc_id, _, lang) in enumerate(rows):
        own = [v for of, v in held if of == lang] or [v for _, v in held]
        limit, usual = quantile(own, quality.QUANTILE), quantile(own, 0.5)
        b, c = bits[k]
        n = quality.PRIOR_CHARS
        keep = bool(c) and 2 ** ((b + math.log2(usual) * n) / (c + n)) <= limit
        want.append((doc_id, lang, perplexity[k] and round(perplexity[k], 6), round(limit, 6), keep))
    assert sorted(((r.doc_id, r.lang, r.perplexity and round(r.perplexity, 6), round(r.threshold, 6), r.keep) for r in got), key=repr) == sorted(want, key=repr)
    assert 0 < sum(w[-1] for w in want) < len(want)


def test_quality_keeps_clean_and_drops_junk(spark):
    rows = queries()["op4_quality"](spark, MORE).join(read(spark, MORE, "labels"), "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.05


def test_quality_drops_repeated_words(spark):
    docs = read(spark, MORE, "documents").select("doc_id", "text")
    rows = queries()["op4_quality"](spark, MORE).join(read(spark, MORE, "labels"), "doc_id").join(docs, "doc_id").collect()
    junk = [r.keep for r in rows if r.quality == 0 and len(r.text.split()) > 6 * len(set(r.text.split()))]
    clean = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    assert len(junk) >= 8 and not any(junk) and sum(clean) / len(clean) >= 0.99


def test_quality_of_odd_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "ab ab"), (3, "ab ab"), (None, "ab"), (4, "ab " * 50_000)]).withColumn("keep", F.lit("x"))
    trusted = spark.createDataFrame([(3,), (4,), (None,), (99,)], "doc_id long")
    got = {(r.doc_id, r.perplexity is None, r.keep) for r in quality.judge(docs, trusted).collect()}
    assert {(1, True, False), (2, True, False)} <= got and len(got) == 5
    assert quality.judge(docs.limit(0), trusted).count() == 0
    assert {r.keep for r in quality.judge(docs.where("doc_id = 3"), trusted.limit(0)).collect()} == {True}
