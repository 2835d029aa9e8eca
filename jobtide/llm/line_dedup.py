"""Reversible line deduplication (operator 2).

State, all of it tables split into shards by line key:

* ``postings``: one row per (key, document) with the lines the document holds, exact;
* ``refs``: the reference-count table, per key the number of documents and the largest doc_id;
* ``filters``: one cuckoo filter per shard over the keys of ``refs``.  A filter answers "surely
  absent" without touching the tables and, unlike a Bloom filter, supports deletion.

``insert`` adds documents, ``delete`` takes documents away and brings the counts back, so a line
that lost its copies is kept again.  ``dropped`` / ``apply`` decide which lines of a set of documents
go: keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose their
lines except in the largest doc_id that holds the key.

Filter sizes follow the number of keys (``KEYS_PER_SHARD`` keys per shard); a filter whose insertion
fails is built again with twice the buckets, so no key is ever left out.

Cases: a null or empty text is one empty line; equal lines of one document count once as a document
and drop together; rows with the same doc_id are one document for counting; a null doc_id is a
document of its own that sorts below every other; extra columns are ignored (``apply`` keeps them);
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import SPACE, ascii_lower, checkpointed, two_hashes

MIN_CHARS = 20
MIN_DOCS = 3
KEYS_PER_SHARD = 1 << 18
SLOTS = 4            # fingerprints per cuckoo bucket
MAX_FILTER_BYTES = 32 << 20   # filters above this are not broadcast; the exact tables answer alone


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def explode_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, th (text hash, tells rows of one doc_id apart), pos, k1, k2 of every long line."""
    lines = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"),
                        F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("line"))
    return lines.where(F.char_length("line") >= min_chars) \
        .select("doc_id", "th", "pos", *two_hashes(F.col("line")))


def postings_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return explode_lines(docs, min_chars).groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("lines"))


def refs_of(postings: DataFrame) -> DataFrame:
    """The reference counts: documents per key and the document whose copy stays."""
    return postings.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))


def insert(postings: DataFrame | None, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Postings after the documents came in; a (key, document) already present is not counted twice."""
    new = postings_of(docs, min_chars)
    if postings is None:
        return new
    return postings.unionByName(new).groupBy("k1", "k2", "doc_id").agg(F.max("lines").alias("lines"))


def delete(postings: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Postings after the documents left; their references are gone, other documents' stay."""
    gone = doc_ids.select(F.col("doc_id").alias("gone")).distinct()
    return postings.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


# --- cuckoo filters -------------------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key lives in one of two buckets."""

    def __init__(self, n_keys: int = 0, table: np.ndarray | None = None):
        want = max(1, -(-n_keys * 10 // (SLOTS * 8)))
        self.table = np.zeros((1 << (want - 1).bit_length(), SLOTS), np.uint16) if table is None else table

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(keys.astype(np.uint64))
        mask = np.uint64(len(self.table) - 1)
        fp = (h >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        one = h & mask
        return fp, one, self._other(fp, one)

    def _other(self, fp, bucket):
        return (bucket ^ _mix(np.asarray(fp, np.uint64))) & np.uint64(len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(keys)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray, seed: int = 1) -> bool:
        """Insert distinct keys; False when some key finds no place."""
        rng = np.random.default_rng(seed)
        fp, a, b = self._places(keys)
        left = np.arange(len(keys))
        for bucket in (a, b):          # most keys find a free place at once
            for s in range(SLOTS):
                free = left[self.table[bucket[left], s] == 0]
                place, first = np.unique(bucket[free], return_index=True)
                self.table[place, s] = fp[free[first]]
                left = np.setdiff1d(left, free[first], assume_unique=True)
        for i in left.tolist():        # the rest push others out
            f, at = fp[i], int(a[i])
            for _ in range(500):
                row = self.table[at]
                if (row == 0).any():
                    row[np.flatnonzero(row == 0)[0]] = f
                    break
                s = int(rng.integers(SLOTS))
                f, row[s] = row[s], f
                at = int(self._other(f, np.uint64(at)))
            else:
                return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted before."""
        fp, a, b = self._places(keys)
        for f, one, two in zip(fp, a, b):
            for at in (int(one), int(two)):
                hit = np.flatnonzero(self.table[at] == f)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break


def build_filter(keys: np.ndarray) -> CuckooFilter:
    size = len(keys)
    while True:
        made = CuckooFilter(size)
        if made.insert(keys):
            return made
        size = 2 * size + 8


def shard_filters(refs: DataFrame, n_shards: int) -> DataFrame:
    """One cuckoo filter per shard of the key space: shard, n_keys, table."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        shard, key = (np.concatenate(x) for x in zip(*parts))
        for s in np.unique(shard):
            mine = np.unique(key[shard == s])
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([s], pa.int32()), "n_keys": pa.array([len(mine)], pa.int64()),
                 "filter": pa.array([build_filter(mine).table.tobytes()], pa.binary())})

    keyed = refs.select(F.pmod("k2", F.lit(n_shards)).cast("int").alias("shard"), "k1")
    return keyed.repartition(n_shards, "shard").mapInArrow(make, "shard int, n_keys long, filter binary")


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, n_shards: int) -> DataFrame:
    """Filters after keys came into the reference table and others left it: only touched shards'
    fingerprints change.  ``added`` and ``removed`` are key tables (k1, k2), each key once."""
    keyed = lambda d, sign: d.select(F.pmod("k2", F.lit(n_shards)).cast("int").alias("shard"), "k1",
                                     F.lit(sign).alias("sign"))
    changes = keyed(added, 1).unionByName(keyed(removed, -1))

    def change(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = (left if left.num_rows else right).column("shard")[0].as_py()
        key, sign = right.column("k1").to_numpy(), right.column("sign").to_numpy()
        blob = left.column("filter")[0].as_py() if left.num_rows else b""
        n = left.column("n_keys")[0].as_py() if left.num_rows else 0
        made = CuckooFilter(table=np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()) \
            if blob else CuckooFilter(len(key))
        made.remove(key[sign < 0])
        full = not made.insert(np.unique(key[sign > 0]))
        n += int((sign > 0).sum()) - int((sign < 0).sum())
        # A full filter can't grow from fingerprints alone: an empty table rules nothing out until ``rebuild_full``.
        return pa.table({"shard": pa.array([shard], pa.int32()), "n_keys": pa.array([n], pa.int64()),
                         "filter": pa.array([b"" if full else made.table.tobytes()], pa.binary())})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")) \
        .applyInArrow(change, "shard int, n_keys long, filter binary")


def rebuild_full(filters: DataFrame, refs: DataFrame, n_shards: int) -> DataFrame:
    """The filters, those that were full (empty tables) built anew from the reference table's keys (k1, k2)."""
    full = [r.shard for r in filters.where(F.length("filter") == 0).select("shard").collect()]      # at most n_shards
    if not full:
        return filters
    mine = refs.where(F.pmod("k2", F.lit(n_shards)).cast("int").isin(full))
    return filters.where(F.length("filter") > 0).unionByName(shard_filters(mine, n_shards))


def maybe_in(lines: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """The lines whose key the shard's filter doesn't rule out."""
    sc = lines.sparkSession.sparkContext
    held = sc.broadcast({r.shard: r.filter for r in filters.collect()})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: CuckooFilter(table=np.frombuffer(t, np.uint16).reshape(-1, SLOTS)) if t else None
                  for s, t in held.value.items()}
        for b in batches:
            k1, shard = b.column("k1").to_numpy(), np.mod(b.column("k2").to_numpy(), n_shards)
            keep = np.zeros(b.num_rows, bool)
            for s in np.unique(shard):
                if int(s) in tables:
                    at = np.flatnonzero(shard == s)
                    table = tables[int(s)]
                    keep[at] = table.contains(k1[at]) if table else True       # a full filter rules nothing out
            yield b.filter(pa.array(keep))

    return lines.mapInArrow(probe, lines.schema)


# --- decisions ------------------------------------------------------------------------------------

def dropped(docs: DataFrame, postings: DataFrame, min_chars: int = MIN_CHARS,
            min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, th, drop (array of line positions) for the documents that lose lines.

    The reference counts of the keys held often enough are the exact table; their sharded cuckoo
    filters, when within MAX_FILTER_BYTES, keep all other lines from being shuffled to it.
    """
    refs = refs_of(postings).where(F.col("docs") >= min_docs).select("k1", "k2", "keeper")
    refs = checkpointed(refs)
    n = refs.count()
    lines = explode_lines(docs, min_chars)
    shards = max(1, -(-n // KEYS_PER_SHARD))
    if n and n * 5 <= MAX_FILTER_BYTES:   # at most five bytes a key
        lines = maybe_in(lines, shard_filters(refs, shards), shards)
    hits = lines.join(refs, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return hits.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop"))


def _lines_and_drops(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """The documents with __lines (null for a null text) in place of text, and __drop."""
    d = drops.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("drop").alias("__drop"))
    lines = docs.withColumn("__lines", F.when(F.col("text").isNotNull(), text_lines(F.col("text")))) \
        .withColumn("__hash", F.xxhash64("text")).drop("text")
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th"))
    return lines.join(d, on, "left").drop("__id", "__th", "__hash")


def _kept(lines: Column, drop: Column) -> Column:
    """The lines joined again without those at the dropped positions; null lines give null."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return F.array_join(F.when(drop.isNull(), lines).otherwise(F.transform(left, lambda i: F.get(lines, i))), "\n")


def apply(docs: DataFrame, postings: DataFrame | None = None, min_chars: int = MIN_CHARS,
          min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with all columns, their repeated lines gone from ``text``."""
    postings = insert(None, docs, min_chars) if postings is None else postings
    out = _lines_and_drops(docs, dropped(docs, postings, min_chars, min_docs))
    return out.withColumn("text", _kept(F.col("__lines"), F.col("__drop"))).select(*docs.columns)


def digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = docs.select("doc_id", "text")
    out = _lines_and_drops(docs, dropped(docs, insert(None, docs, min_chars), min_chars, min_docs))
    text = F.coalesce(_kept(F.col("__lines"), F.col("__drop")), F.lit(""))
    return out.select(
        "doc_id",
        F.when(F.col("__lines").isNull(), 1).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
