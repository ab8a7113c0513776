"""Near-duplicate embeddings against all pairs in double precision."""

import math

import duckdb
import numpy as np
import pytest
from brute import components
from pyspark.sql import functions as F

from quernstone.llm import embeddings
from quernstone.llm.common import read
from quernstone.llm.registry import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


def expected(rows, cosine=embeddings.COSINE):
    good = [(i, np.array(v, np.float64)) for i, v in rows if usable(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in good]
    links, count = [], [0] * len(unit)
    for a in range(len(unit)):
        for b in range(a):
            if len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= cosine:
                links.append((unit[a][0], unit[b][0]))
                count[a] += 1
                count[b] += 1
    parts = components({i for i, _ in rows}, links)
    out = [(i, n, parts[i]) for (i, _), n in zip(unit, count)]
    return sorted(out + [(i, 0, parts[i]) for i, v in rows if not usable(v)])


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def clusters(seed, n, size, dim=16, noise=0.12):
    r = np.random.default_rng(seed)
    out = []
    for c in range(n):
        center = r.normal(size=dim)
        for _ in range(size[c % len(size)]):
            out.append((center + noise * np.linalg.norm(center) / math.sqrt(dim) * r.normal(size=dim)).astype(np.float32).tolist())
    return out


def run(spark, rows, **how):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("n_links", F.lit("clash"))
    got = embeddings.near_vectors(frame.repartition(3), **how).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in got)


def test_links_match_all_pairs(spark):
    vectors = clusters(1, 40, (1, 3, 60, 7), noise=0.2)
    rows = [(i * 3 + 1, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[5]) for i in range(4)]
    rows += [(2000, [2 * x for x in vectors[7]])]
    assert run(spark, rows) == expected(rows)


def test_unusable_vectors_and_lengths(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]),
        (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [1e-30, 0.0]), (13, [-1.0, 0.0]),
    ]
    assert run(spark, rows) == expected(rows)


def test_empty_single_and_null_id(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0, 2.0])]) == [(5, 0, 5)]
    frame = spark.createDataFrame([(None, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_vectors(frame).collect()), key=repr) == [(1, 0, 1, True), (None, 0, None, True)]


def test_query_matches_all_pairs(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in read(spark, DATA, "embeddings").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in queries()["op7_embeddings"](spark, DATA).collect())
    assert got == expected(rows)


def grouped(seed, n, dim=64, sizes=(1, 2, 3) * 12 + (10, 40, 400)):
    """Unit vectors in groups of these sizes, whose members lie at cosines about 0.95 to each other, in random order."""
    r = np.random.default_rng(seed)
    out = []
    while sum(map(len, out)) < n:
        center = r.normal(size=dim)
        spread = r.uniform(0.05, 0.24, (sizes[len(out) % len(sizes)], 1)) * np.linalg.norm(center) / math.sqrt(dim)
        out.append(center + spread * r.normal(size=(len(spread), dim)))
    x = r.permutation(np.concatenate(out))[:n]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(2))
def test_graph_finds_links_of_small_groups_of_vectors_it_does_not_hold(seed):
    x = grouped(seed, 10_000)
    held, asked = x[:6000], x[6000:]
    graph = embeddings.Graph(held, 0.95)
    assert len(graph.layers) > 1
    graph.audit()
    assert all(share is None or share >= embeddings.RECALL for share in graph.recall)
    exact = asked.astype(np.float32) @ graph.vectors.T >= 0.95
    found = np.zeros(exact.shape, bool)
    for i in range(0, len(asked), 500):
        q, v = graph.search(asked[i : i + 500], 0.95)
        found[q + i, v] = True
    assert not (found & ~exact).any()
    links = exact.sum(axis=1)
    for few, many in ((1, 3), (4, 60), (61, 10_000)):
        mine = (links >= few) & (links <= many)
        assert mine.sum() > 100 and (found & exact)[mine].sum() >= 0.99 * links[mine].sum(), (few, many)


def test_audit_widens_the_beam_for_one_class_alone(monkeypatch):
    monkeypatch.setattr(embeddings, "TOP", 64)
    monkeypatch.setattr(embeddings, "BEAM", 1)
    graph = embeddings.Graph(grouped(5, 3000, sizes=(1, 2, 800)), 0.95)
    graph.audit()
    assert graph.beam > 1 and all(share is None or share >= embeddings.RECALL for share in graph.recall)


def test_several_layers_and_shards_in_spark(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "HELD_BYTES", 64 * 8 * 700)
    rows = [(i, v.tolist()) for i, v in enumerate(grouped(9, 3000, sizes=(1, 2, 3, 60)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(frame).collect()}
    want = {i: (n, c) for i, n, c in expected(rows)}
    lost = sum(n for n, _ in want.values()) - sum(n for n, _ in got.values())
    assert got.keys() == want.keys() and 0 <= lost <= 0.01 * sum(n for n, _ in want.values())


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(oracle_sql()["op7_embeddings"])
    names = [d[0] for d in want.description]
    got = queries()["op7_embeddings"](spark, DATA).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_boundary_is_decided_in_double(spark):
    c = embeddings.COSINE
    other = [c, math.sqrt(1 - c * c)]
    for eps in (-1e-7, 1e-7):
        rows = [(1, [1.0, 0.0]), (2, [other[0] + eps, other[1]])]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        v = np.array(rows[1][1])
        assert (v[0] / np.linalg.norm(v) >= c) == (eps > 0)
        assert [r.n_links for r in embeddings.near_vectors(frame).collect()] == [int(eps > 0)] * 2
