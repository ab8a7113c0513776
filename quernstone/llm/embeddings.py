"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Distinct vectors are spread over shards of bounded size by hash. Each shard gets a graph: nested
layers, each a random sixteenth of the one below; in a layer a node's edges are a diverse choice of
its nearest nodes (exact, by blocked products, as shards are bounded) made mutual, and in all but
the top layer also edges to its nearest nodes of the layer above. The top layer, of TOP nodes at most, is
scanned whole for the entry points; a beam descends from them.

Beams are widened until the shard's audit passes: queries of its own and of vectors that it doesn't
hold, in classes by how many links they have there, are held against brute force, and each class
must reach RECALL by itself, so large groups can't hide what is lost of small ones. A beam as wide as
the shard is a scan.

Then every vector is a query to every shard, in one job: graphs lie in the shared folder, a file a shard,
and a task that holds a block of queries asks one after the other. What lies within the threshold is
followed along the edges to its end, so groups wider than the beam are found whole. Cosines are
decided in double precision.
"""

from __future__ import annotations

import logging
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import checkpoint, connected_components, new_folder, read, read_part, remove

log = logging.getLogger("quernstone")

COSINE = 0.95
SHARD = 25_000
LEAST_SHARDS = 4
EDGES, ABOVE = 24, 6
BEAM = 24
RATIO = 16
TOP = 2048
RECALL = 0.99
AUDITS = 150  # queries of each kind and class
CLASSES = (3, 60)  # up to 3 links, up to 60, more
HELD_BYTES = 64_000_000  # of vectors in a shard, and of queries that a task holds at once
QUERY_BLOCK = 256
SEED = 5


class Layer:
    """Nodes of one layer: their places in the shard, and edges as places in the layer (-1: none)."""

    def __init__(self, members: np.ndarray, edges: np.ndarray):
        self.members, self.edges = members, edges


class Graph:
    def __init__(self, vectors: np.ndarray, least: float, seed: int = SEED):
        self.vectors, self.least = vectors.astype(np.float32), least
        self.beam = BEAM
        self.degree = np.zeros(len(vectors), np.int64)
        self.recall: list[float | None] = []
        order = np.random.default_rng(seed).permutation(len(vectors))
        sizes = [len(vectors)]
        while sizes[-1] > TOP:
            sizes.append(max(sizes[-1] // RATIO, 1))
        nested = [np.sort(order[:n]) for n in sizes]
        self.layers: list[Layer] = []  # from the top
        for i in range(len(nested) - 1, -1, -1):
            upper = nested[i + 1] if i + 1 < len(nested) else None
            self.layers.append(Layer(nested[i], self._edges(nested[i], upper)))

    def _edges(self, members: np.ndarray, upper: np.ndarray | None) -> np.ndarray:
        x = self.vectors[members]
        n, wide = len(members), min(len(members) - 1, 2 * EDGES)
        if wide < 1:
            return np.full((n, 1), -1, np.int32)
        chosen = np.full((n, EDGES), -1, np.int32)
        up = np.zeros((n, 0), np.int32)
        if upper is not None:
            at = np.searchsorted(members, upper)
            k = min(ABOVE, len(upper))
            up = np.zeros((n, k), np.int32)
        for i in range(0, n, 512):
            rows = slice(i, min(i + 512, n))
            sims = x[rows] @ x.T
            sims[np.arange(sims.shape[0]), np.arange(rows.start, rows.stop)] = -2
            if n == len(self.vectors):
                self.degree[rows] = (sims >= self.least).sum(axis=1)
            near = np.argpartition(-sims, wide - 1, axis=1)[:, :wide]
            own = np.take_along_axis(sims, near, 1)
            by = np.argsort(-own, axis=1, kind="stable")
            near, own = np.take_along_axis(near, by, 1), np.take_along_axis(own, by, 1)
            # diversity: skip a candidate that is closer to a chosen one than to the node, then fill up with those
            group = x[near]
            among = group @ group.transpose(0, 2, 1)
            taken = np.zeros(near.shape, bool)
            for c in range(wide):
                shadowed = (taken & (among[:, :, c] > own[:, c, None])).any(axis=1)
                taken[:, c] = ~shadowed & (taken.sum(axis=1) < EDGES)
            rank = np.argsort(~taken, axis=1, kind="stable")[:, :EDGES]
            chosen[rows, : rank.shape[1]] = np.take_along_axis(near, rank, 1)
            if up.shape[1]:
                far = sims[:, at]
                up[rows] = at[np.argpartition(-far, up.shape[1] - 1, axis=1)[:, : up.shape[1]]]
        edges = np.concatenate([chosen, up], axis=1)
        # mutual edges: as many incoming ones again, nearest first
        source = np.repeat(np.arange(n, dtype=np.int32), edges.shape[1])
        target = edges.ravel()
        ok = (target >= 0) & (target != source)
        source, target = source[ok], target[ok]
        close = np.einsum("ij,ij->i", x[source], x[target])
        by = np.lexsort((-close, target))
        source, target = source[by], target[by]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        fits = place < EDGES
        back = np.full((n, EDGES), -1, np.int32)
        back[target[fits], place[fits]] = source[fits]
        return np.concatenate([edges, back], axis=1)

    def _descend(self, layer: Layer, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple:
        """(beam places, their cosines, visited) after a best-first search from `entry` (places in the layer)."""
        q, n = len(queries), len(layer.members)
        x = self.vectors[layer.members]
        rows = np.arange(q)
        visited = np.zeros((q, n + 1), bool)
        visited[:, n] = True  # the place of missing edges
        visited[rows[:, None], entry] = True
        sims = np.einsum("qd,qed->qe", queries, x[entry])
        pad = max(beam - entry.shape[1], 0)
        ids = np.pad(entry, ((0, 0), (0, pad)), constant_values=n)
        sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-3.0)
        done = ids == n
        active = rows
        while len(active):
            open_sims = np.where(done[active], -4.0, sims[active])
            best = np.argmax(open_sims, axis=1)
            going = open_sims[np.arange(len(active)), best] > -3.5
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            near = layer.edges[ids[active, best]].astype(np.int64)
            near[near < 0] = n
            # an edge listed twice counts once
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near = np.where(visited[active[:, None], near], n, near)
            visited[active[:, None], near] = True
            real = near < n
            own = np.full(near.shape, -3.0, np.float32)
            r, c = np.nonzero(real)
            own[r, c] = np.einsum("ij,ij->i", queries[active[r]], x[near[r, c]])
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], own], axis=1)
            all_done = np.concatenate([done[active], ~real], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, top, 1)
            sims[active] = np.take_along_axis(all_sims, top, 1)
            done[active] = np.take_along_axis(all_done, top, 1)
        return ids, sims, visited

    def search(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) pairs of all vectors found with cosine >= least, in single precision."""
        queries = queries.astype(np.float32)
        if len(self.layers) == 1 or self.beam >= len(self.vectors):
            return np.nonzero(queries @ self.vectors.T >= least)
        members = self.layers[0].members
        beam = min(self.beam, len(members))
        entry = np.argpartition(-(queries @ self.vectors[members].T), beam - 1, axis=1)[:, :beam]
        for layer in self.layers[1:]:
            ids, sims, _ = self._descend(layer, queries, np.searchsorted(layer.members, members[entry]), beam)
            real = ids < len(layer.members)
            entry = np.where(real, ids, ids[np.arange(len(ids)), np.argmax(sims, 1)][:, None])
            members = layer.members
        layer, n = self.layers[-1], len(self.vectors)
        found_q, found_v = [], []
        hits = sims >= least
        r, c = np.nonzero(hits)
        found_q.append(r)
        found_v.append(ids[r, c])
        # follow the edges of what lies within the threshold; a beam that it fills may have dropped some
        full = np.flatnonzero(hits.all(axis=1))
        for q in full:
            frontier = ids[q][hits[q]]
            known = np.zeros(n, bool)
            known[frontier] = True
            tried = known.copy()
            while len(frontier):
                near = layer.edges[frontier].ravel()
                near = np.unique(near[near >= 0])
                near = near[~tried[near]]
                tried[near] = True
                frontier = near[self.vectors[near] @ queries[q] >= least]
                known[frontier] = True
            inside = np.flatnonzero(known)
            new = np.setdiff1d(inside, ids[q][hits[q]])
            found_q.append(np.full(len(new), q))
            found_v.append(new)
        return np.concatenate(found_q), np.concatenate(found_v)

    def audit(self, audits: int = AUDITS, recall: float = RECALL, seed: int = SEED) -> None:
        """Doubles the beam until every class of queries finds its share of links; `recall` keeps the last shares.

        Queries are up to `audits` vectors of the shard from each class of links, and as many turned away from such
        vectors by any angle within the threshold, which stand for vectors of other shards.
        """
        rng = np.random.default_rng(seed + 1)
        of = np.searchsorted(CLASSES, self.degree)
        sample = np.concatenate([rng.permutation(np.flatnonzero(of == c))[:audits] for c in range(len(CLASSES) + 1)])
        own = self.vectors[sample].astype(np.float64)
        noise = rng.standard_normal(own.shape)
        noise -= np.einsum("ij,ij->i", noise, own)[:, None] * own
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        turn = rng.uniform(self.least, 1.0, (len(own), 1))
        queries = np.concatenate([own, turn * own + np.sqrt(1 - turn**2) * noise]).astype(np.float32)
        wanted = queries @ self.vectors.T >= self.least
        links = wanted.sum(axis=1)
        of = np.searchsorted(CLASSES, links)
        while True:
            found = np.zeros(wanted.shape, bool)
            for i in range(0, len(queries), QUERY_BLOCK):
                q, v = self.search(queries[i : i + QUERY_BLOCK], self.least)
                found[q + i, v] = True
            hits = (found & wanted).sum(axis=1)
            shares = [(hits[of == c].sum(), links[of == c].sum()) for c in range(len(CLASSES) + 1)]
            self.recall = [float(h / n) if n else None for h, n in shares]
            if all(r is None or r >= recall for r in self.recall) or self.beam >= len(self.vectors):
                return
            self.beam *= 2


class Shard:
    """A searchable shard: ids, how many rows share each vector, unit vectors, the graph, and its own components."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, unit: np.ndarray, cosine: float):
        self.ids, self.copies, self.unit, self.cosine = ids, copies, unit, cosine
        self.graph = Graph(unit, cosine - 1e-5)
        self.graph.audit()
        self.component = np.arange(len(ids))
        parent = self.component

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(0, len(ids), QUERY_BLOCK):
            q, v = self._links(unit[i : i + QUERY_BLOCK])
            for a, b in zip((q + i).tolist(), v.tolist()):
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        self.component = np.array([root(i) for i in range(len(ids))])

    def _links(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, v = self.graph.search(unit, self.cosine - 1e-5)
        exact = np.einsum("ij,ij->i", unit[q], self.unit[v]) >= self.cosine
        return q[exact], v[exact]

    def links(self, ids: np.ndarray, unit: np.ndarray) -> list[tuple[int, int, int]]:
        """(query id, id of a component of this shard that it links with, links with it), other than itself."""
        out: dict[tuple[int, int], int] = {}
        for i in range(0, len(ids), QUERY_BLOCK):
            q, v = self._links(unit[i : i + QUERY_BLOCK])
            for a, b in zip((q + i).tolist(), v.tolist()):
                if self.ids[b] != ids[a]:
                    key = (int(ids[a]), int(self.ids[self.component[b]]))
                    out[key] = out.get(key, 0) + int(self.copies[b])
        return [(a, b, n) for (a, b), n in out.items()]


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = np.array(column.to_pylist(), dtype=np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _build(table: pa.Table, cosine: float) -> pa.Table:
    table = table.sort_by("rep")
    shard = Shard(
        table.column("rep").to_numpy(), table.column("copies").to_numpy(), _unit(table.column("embedding")), cosine
    )
    least = [r for r in shard.graph.recall if r is not None]
    columns = {
        "shard": table.column("shard").slice(0, 1),
        "graph": pa.array([pickle.dumps(shard, 5)], pa.binary()),
        "beam": pa.array([shard.graph.beam], pa.int32()),
        "recall": pa.array([min(least, default=1.0)], pa.float64()),
    }
    return pa.table(columns)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors, HELD_BYTES of them at a time."""
    ids: list[np.ndarray] = []
    units: list[np.ndarray] = []
    size = 0
    for batch in batches:
        step = max(HELD_BYTES // (8 * max(len(batch.column("embedding")[0]), 1)), 1) if batch.num_rows else 1
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            ids.append(part.column("rep").to_numpy())
            units.append(_unit(part.column("embedding")))
            size += units[-1].nbytes
            if size >= HELD_BYTES:
                yield np.concatenate(ids), np.concatenate(units)
                ids, units, size = [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(units)


def _ask(batches: Iterator[pa.RecordBatch], folder: str, shards: list[int]) -> Iterator[pa.RecordBatch]:
    for ids, unit in _blocks(batches):
        for number in shards:
            shard = pickle.loads(read_part(f"{folder}/shard={number}", ["graph"]).column("graph")[0].as_buffer())
            columns = list(zip(*shard.links(ids, unit))) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "other", "n"])


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    embeddings: vec_id, embedding; other columns (labels) are ignored. Two rows link where their cosine
    is at least `cosine`. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different length with each other. Rows with equal vectors are one node that
    counts as often as it occurs; a repeated vec_id counts as several rows. A null vec_id isn't linked,
    and is kept with a null component. An empty table gives an empty result.

    A shard has `shard_rows` vectors on average, fewer where they are long (HELD_BYTES); distinct vectors are
    spread by hash, so no shard is hot. A query reports, per component of a shard, one link and a count, not all
    its partners, so a group of thousands gives thousands of rows, not millions. Neither vectors nor graphs pass
    through the driver; each length of vectors is two jobs. The audits' beams and shares found are logged.
    """
    spark = embeddings.sparkSession
    good = (
        F.col("embedding").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
        & F.col("vec_id").isNotNull()
    )
    exact = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("embedding"))
    keyed = exact.where(good).select(
        "vec_id", "embedding", F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2")
    )
    nodes = keyed.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )
    nodes = checkpoint(nodes)
    found = None
    folders: list[str] = []
    for (size,) in nodes.select(F.size("embedding")).distinct().collect():
        own = nodes.where(F.size("embedding") == size)
        shards = max(LEAST_SHARDS, -(-own.count() // max(min(shard_rows, HELD_BYTES // (8 * size)), 1)))
        spread = own.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
        graphs = (
            spread.select("shard", "rep", "copies", "embedding")
            .groupBy("shard")
            .applyInArrow(lambda t: _build(t, cosine), "shard int, graph binary, beam int, recall double")
        )
        folder = new_folder(spark, "graphs")
        folders.append(folder)
        graphs.write.option("maxRecordsPerFile", 1).partitionBy("shard").parquet(folder)
        audits = spark.read.parquet(folder).select("shard", "beam", "recall").collect()  # three numbers a shard
        log.info("graphs of %d vectors' length: least recall %.4f, beams up to %d", size, min(a.recall for a in audits), max(a.beam for a in audits))
        built = sorted(a.shard for a in audits)
        asked = own.select("rep", "embedding").mapInArrow(
            lambda it, folder=folder, built=built: _ask(it, folder, built), "rep long, other long, n long"
        )
        answers = checkpoint(asked.groupBy("rep", "other").agg(F.sum("n").alias("n")))
        found = answers if found is None else found.unionByName(answers)
    if found is None:
        found = spark.createDataFrame([], "rep long, other long, n long")
    for folder in folders:
        remove(spark, folder)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    same = keyed.join(nodes.select("h1", "h2", "rep", "copies"), ["h1", "h2"]).select("vec_id", "rep", "copies")
    edges = found.select(F.col("rep").alias("a"), F.col("other").alias("b"))
    edges = edges.unionByName(same.where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    parts = connected_components(edges)
    linked = same.join(counts, "rep", "left").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links")
    )
    linked = linked.unionByName(exact.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n_links")))
    out = linked.join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


#: All cosines in double precision, and the least vector that each reaches by links.
OP7_SQL = f"""
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
unit AS (SELECT k, vec_id, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS u FROM good),
link AS (
  SELECT a.k AS a, b.k AS b, b.vec_id FROM unit a JOIN unit b
  ON a.k <> b.k AND len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= {COSINE}),
reached AS (
  SELECT k, vec_id AS least FROM unit
  UNION SELECT link.b, reached.least FROM reached JOIN link ON link.a = reached.k WHERE reached.least < link.vec_id),
counted AS (SELECT a AS k, count(*) AS n FROM link GROUP BY a),
grouped AS (SELECT k, min(least) AS component FROM reached GROUP BY k),
found AS (
  SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id
  FROM good JOIN grouped USING (k) LEFT JOIN counted USING (k)
  UNION ALL SELECT vec_id, 0, vec_id FROM embeddings e
  WHERE vec_id IS NULL OR embedding IS NULL OR len(embedding) = 0
    OR len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) > 0 OR len(list_filter(embedding, lambda v: v <> 0)) = 0)
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM found
"""
