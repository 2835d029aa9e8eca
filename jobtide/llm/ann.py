"""Approximate nearest neighbours from balanced posting lists (operator 10).

Fitting: a bounded sample (``SAMPLE`` vectors, first by hash of vec_id) is split into balanced halves until
the parts are small; their means, refined by a few Lloyd steps, are the centroids.  About ``PER_LIST``
vectors share a centroid, up to ``MAX_LISTS`` centroids, so the centroids and their neighbour graph are
bounded and broadcast.

Index: every vector goes to the posting list of its nearest centroid and, near a boundary, to the others
whose distance is within ``CLOSURE`` of the least.  Search: centroids are found by best-first search in the
in-memory graph; lists whose centroid is within ``PRUNE`` times the least distance are read, and the next nearest
until the lists read hold ``FLOOR`` times k + 1 different entries (all lists if there are fewer).  Lists are read in chunks of bounded size against chunks of queries, so a list that holds a third of all rows is
many tasks' work.  Distances found are exact cosines in double precision.

Equal vectors share one entry that knows their ``k + 1`` smallest ids, since ties go to the smaller id; equal
queries are searched once.

Cases: vectors that are null, zero, empty or hold null or non-finite components take no part, as queries or as
candidates, nor do those whose length differs from the sample's most common one; rows that repeat a vec_id
with the same vector are one candidate; with fewer than k candidates all are returned; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.common import checkpointed, stored, two_hashes

SAMPLE = 32_768
PER_LIST = 512
MAX_LISTS = 4096
REPLICAS = 8        # lists a vector may be copied to
CLOSURE = 1.02      # ... if their centroid is at most this much farther than the nearest
PRUNE = 1.3         # lists read for a query, by the same ratio
FLOOR = 32          # ... and on until they hold this many times k + 1 entries
DEGREE = 32         # neighbours of a centroid in the graph
CHUNK = 4096        # vectors or queries of a list that meet in one task


class Centroids:
    """Unit centroids with a neighbour graph, searched best-first for many vectors at once."""

    def __init__(self, points: np.ndarray):
        self.points = points
        k = len(points)
        near = np.argsort(-(points @ points.T), axis=1, kind="stable")[:, 1:DEGREE + 1]
        jump = np.random.default_rng(7).integers(0, max(k, 1), (k, 4))    # long links keep the graph connected
        self.graph = np.concatenate([near, jump], axis=1)
        self.start = np.unique(np.linspace(0, max(k - 1, 0), 16).astype(int))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found for each row of x, nearest first: ids, distances."""
        rows, k = len(x), len(self.points)
        beam = min(beam, k)
        seen = np.zeros((rows, k), bool)
        ids = np.tile(self.start, (rows, 1))
        seen[:, self.start] = True
        sim = x @ self.points[self.start].T
        done = np.zeros(ids.shape, bool)
        every = np.arange(rows)[:, None]
        while True:
            open_ = np.where(done, -np.inf, sim)
            pick = np.argsort(-open_, axis=1, kind="stable")[:, :4]
            if not np.isfinite(open_).any():
                break
            fresh = np.isfinite(np.take_along_axis(open_, pick, 1))
            np.put_along_axis(done, pick, True, 1)
            more = self.graph[np.take_along_axis(ids, pick, 1)].reshape(rows, -1)
            new = ~seen[every, more] & np.repeat(fresh, self.graph.shape[1], axis=1)
            order = np.argsort(more, axis=1, kind="stable")       # a centroid reached twice counts once
            twice = np.zeros_like(new)
            s = np.take_along_axis(more, order, 1)
            np.put_along_axis(twice, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
            new &= ~twice
            row, col = np.nonzero(new)
            seen[row, more[row, col]] = True
            far = np.where(new, np.einsum("rd,rmd->rm", x, self.points[more]), -np.inf)
            ids, sim = np.concatenate([ids, more], 1), np.concatenate([sim, far], 1)
            done = np.concatenate([done, ~new], 1)
            top = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
            ids, sim, done = (np.take_along_axis(m, top, 1) for m in (ids, sim, done))
        order = np.argsort(-sim, axis=1, kind="stable")
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        return ids, np.sqrt(np.maximum(0, 2 - 2 * sim))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def balanced_means(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """k means of balanced parts of x (unit rows), refined by Lloyd steps."""
    rng, parts = np.random.default_rng(seed), [np.arange(len(x))]
    while len(parts) < k:
        parts.sort(key=len)
        part = parts.pop()
        if len(part) < 2:
            parts.append(part)
            break
        a, b = x[rng.choice(part, 2, replace=False)]
        for _ in range(4):      # halves by the difference of two means
            order = part[np.argsort((x[part] @ (a - b)), kind="stable")]
            half = len(part) // 2
            b, a = x[order[:half]].mean(axis=0), x[order[half:]].mean(axis=0)
        parts += [order[:half], order[half:]]
    means = _unit(np.stack([x[p].mean(axis=0) for p in parts]))
    for _ in range(3):
        near = np.concatenate([np.argmax(x[i:i + 4096] @ means.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(means)
        np.add.at(total, near, x)
        means = _unit(np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, total, means))
    return means


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v, k1, k2 of the vectors that take part."""
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(~bad).where(F.exists("v", lambda c: c != 0)).select("vec_id", "v", *two_hashes(F.col("v")))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: entry (its smallest vec_id), v, ids (its k + 1 smallest), k1, k2."""
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    return rows.dropDuplicates(["k1", "k2", "vec_id"]).withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("k1", "k2").agg(
        F.min("vec_id").alias("entry"), F.min_by("v", "vec_id").alias("v"), ids.alias("ids"))


def fit(found: DataFrame) -> tuple[Centroids | None, int]:
    """Centroids of the distinct vectors and their number of components."""
    n = found.count()
    if not n:
        return None, 0
    rows = found.select("entry", "v").orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).collect()
    sizes = np.array([len(r.v) for r in rows])
    dim = int(np.bincount(sizes).argmax())
    x = _unit(_scaled(np.array([r.v for r in rows if len(r.v) == dim], np.float64)))
    return Centroids(balanced_means(x, max(1, min(MAX_LISTS, -(-n // PER_LIST), len(x) // 4)))), dim


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two to a largest magnitude of 0.5 to 1: no square overflows or vanishes, and cosines
    are the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return _scaled(column.flatten().to_numpy().astype(np.float64).reshape(-1, dim))


def _to_lists(held, dim: int, beam: int, ratio: float, counts: np.ndarray | None = None, least: int = 0):
    """Rows id, v become list, id, v, first (its nearest list) for every list within the ratio and, beyond it, for the
    next nearest until those before hold ``least`` of the counted entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids, far = centroids.search(_unit(_matrix(piece.column(1), dim)), beam)
                read = far <= ratio * far[:, :1] + 1e-12
                if counts is not None:
                    held_by = counts[ids]
                    read |= np.cumsum(held_by, axis=1) - held_by < least
                row, col = np.nonzero(read)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row, col].astype(np.int32)), piece.column(0).take(pa.array(row)),
                     piece.column(1).take(pa.array(row)), pa.array(col == 0)], ["list", "id", "v", "first"])
    return run


def _nearest(dim: int, k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "entry": [], "score": []}
        if left.num_rows and right.num_rows:
            ids = left.column("id").to_numpy()
            x = _matrix(left.column("v").combine_chunks(), dim)
            norm = np.sqrt((x * x).sum(axis=1))
            queries, q = right.column("id").to_numpy(), _matrix(right.column("v").combine_chunks(), dim)
            for at in range(0, len(q), 256):
                sim = _unit(q[at:at + 256]) @ (x / norm[:, None]).T
                for i, s in enumerate(sim):
                    edge = np.partition(s, -(k + 1))[-(k + 1)] if len(s) > k + 1 else -2.0
                    near = np.flatnonzero(s >= edge - 1e-9)
                    a = q[at + i]
                    exact = (x[near] * a).sum(axis=1) / (norm[near] * np.sqrt((a * a).sum()))
                    top = np.lexsort((ids[near], -exact))[:k + 1]
                    out["query"] += [queries[at + i]] * len(top)
                    out["entry"] += ids[near][top].tolist()
                    out["score"] += exact[top].tolist()
        return pa.table({"query": pa.array(out["query"], pa.int64()), "entry": pa.array(out["entry"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})
    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, prune: float = PRUNE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (both tables: vec_id, embedding)."""
    sc = vectors.sparkSession.sparkContext
    found = stored(entries(usable(vectors), k), "ann-entries")
    centroids, dim = fit(found)
    wanted = usable(queries).where(F.size("v") == dim).dropDuplicates(["k1", "k2", "vec_id"])
    if centroids is None:
        return wanted.where("false").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                                            F.lit(0.0).alias("score"))
    wanted = checkpointed(wanted)
    # one search for equal queries, under the smallest of their ids
    asked = wanted.groupBy("k1", "k2").agg(F.min("vec_id").alias("query"), F.min_by("v", "vec_id").alias("v"))
    asked = checkpointed(asked)
    held, n = sc.broadcast(centroids), len(centroids.points)
    to_lists = lambda df, *how: df.mapInArrow(
        _to_lists(held, dim, *how), f"list int, id long, v {found.schema['v'].dataType.simpleString()}, first boolean")
    posts = to_lists(found.where(F.size("v") == dim).select("entry", "v"), REPLICAS * 3, CLOSURE)
    posts = checkpointed(posts)
    counts = np.zeros(n, np.int64)      # each entry in its nearest list only, so copies count once
    for r in posts.where("first").groupBy("list").count().collect():
        counts[r["list"]] = r["count"]
    reads = checkpointed(to_lists(asked.select("query", "v"), n, prune, counts, FLOOR * (k + 1)))
    # chunks of each list's vectors meet chunks of its queries; n lists, so the counts are small
    sizes = posts.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("np")).join(
        reads.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("nq")), "list")
    sizes = F.broadcast(sizes)
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = posts.join(sizes, "list").select("list", part("np").alias("p"), span("nq").alias("q"), "id", "v")
    right = reads.join(sizes, "list").select("list", span("np").alias("p"), part("nq").alias("q"), "id", "v")
    near = left.groupBy("list", "p", "q").cogroup(right.groupBy("list", "p", "q")) \
        .applyInArrow(_nearest(dim, k), "query long, entry long, score double")
    best = lambda by, n: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), n))
    near = near.distinct().withColumn("r", best("query", "entry")).where(F.col("r") <= k + 1) \
        .join(found.select("entry", "ids"), "entry") \
        .select("query", "score", F.explode("ids").alias("vec_id")) \
        .withColumn("r", best("query", "vec_id")).where(F.col("r") <= k + 1).select("query", "vec_id", "score")
    names = wanted.select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct() \
        .join(asked.select("query", "k1", "k2"), ["k1", "k2"]).select("query_id", "query")
    return near.join(names, "query").where("vec_id <> query_id") \
        .withColumn("rank", best("query_id", "vec_id")).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
