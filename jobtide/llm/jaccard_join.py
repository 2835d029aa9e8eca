"""Exact n-gram Jaccard join with set-relation skipping (operator 3).

Sets are the distinct word shingles of a document, as 64-bit hashes.  Documents with equal sets form a
class and one set of it is compared.  Sets and links are keyed by class, never by doc_id, since rows of one
doc_id may hold different texts.

1. All sets agree on an order of shingles: those that a count-min sketch proves unique come first, then
   by frequency class (counted over all rows), then by hash.  Two sets linked at a similarity t share a
   shingle among the first n - ceil(t n) + 1 of each; unique ones can't be shared, so a set whose prefix
   is all unique has no partner and leaves here.
2. Index lists: prefix shingle -> sets.  The set with the fewest unique shingles of a list is its leader.
   Each set is compared with the leader it shares most lists with; the sets linked to one leader make a
   cluster with known distances to it.
3. What is still open: lists that hold several components.  A list is cut into blocks, one per
   cluster, with the block's least position and size range; pairs of blocks whose positions or
   sizes rule out a link are skipped unread.  For the pairs of clusters left, the leaders' distance is
   computed once and the members' answers follow from it: |x ^ y| >= |p ^ q| - |x ^ p| - |y ^ q| skips the
   cluster pair, then single pairs; only what remains is compared.
4. Links are joined into components without gathering any group.

Every comparison that is skipped is proven to be no link or to join what is one component already, so
components are exact.

Cases: a text with fewer words than a shingle is one shingle of all its words; null, empty and blank
texts have the empty set, link with nothing and are their own component; equal texts are linked; rows
with the same doc_id are one node; a null doc_id is a node that sorts last (in ``keep_one`` each such row is a
node of its own); extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.bytescan import mix, pieces
from jobtide.llm.common import checkpointed, small, stored
from jobtide.llm.components import components
from jobtide.llm.repeat_sketch import repeated

SHINGLE = 4
PERCENT = 85
LAST_ID = (1 << 63) - 1
FREQUENT = 3              # a task reports shingles it meets this often
MAX_FREQUENT = 1 << 18    # frequency classes broadcast; others count as rare (order only, never results)
MAX_BROADCAST = 1 << 19


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text with words."""
    for p in pieces(batch):
        p.words()
        words = p.word_hashes(lower=True)
        h, at = p.windows(words, size)
        cut = np.searchsorted(at, p.first)
        for i in range(len(p.first) - 1):
            a, b = p.first[i], p.first[i + 1]
            if b - a >= size:
                yield p.rows.start + i, np.unique(h[cut[i]:cut[i + 1]])
            elif b > a:    # the whole sequence as one shingle; its length tells it from longer ones
                total = mix(np.cumsum(mix(words[a:b] + np.arange(1, b - a + 1, dtype=np.uint64))))[-1:]
                yield p.rows.start + i, total ^ np.uint64(b - a)


def _keys(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)


def _class(n: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """63-bit numbers of classes."""
    return (mix(k1 * np.uint64(0x9E3779B97F4A7C15) + mix(k2 + n.astype(np.uint64))) >> np.uint64(1)).view(np.int64)


def _set_keys(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            k = np.zeros((2, batch.num_rows), np.uint64)
            for i, s in shingle_sets(batch, size):
                n[i] = len(s)
                k[0, i], k[1, i] = _keys(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), pa.array(_class(n, k[0], k[1]), mask=n == 0)], ["id", "n", "cls"])
    return run


def _hashes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, s in shingle_sets(batch, size):
                yield s
    return run


def _frequent(size: int, sketch):
    """Shingles a task meets FREQUENT times or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            h, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep])], ["s", "c"])
        held, n = [], 0
        for batch in batches:
            for _, s in shingle_sets(batch, size):
                held.append(s[sketch.maybe(s)])
                n += len(held[-1])
                if n >= 4 << 20:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)
    return run


def _prefixes(size: int, percent: int, sketch, frequent):
    """row (the text's doc), id (its class), n, unique (shingles proven unique), tokens and places of the prefix's other shingles, the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = (np.frombuffer(x, t) for x, t in zip(frequent.value, (np.uint64, np.uint8)))
        for batch in batches:
            ids = batch.column("id").to_numpy()
            rows = []
            for i, s in shingle_sets(batch, size):
                n = len(s)
                prefix = n - -(-percent * n // 100) + 1
                shared = sketch.maybe(s)
                unique = n - int(shared.sum())
                if unique >= prefix:
                    continue
                s2 = s[shared]
                if len(known):
                    at = np.minimum(np.searchsorted(known, s2), len(known) - 1)
                    rank = np.where(known[at] == s2, level[at], 0)
                else:
                    rank = np.zeros(len(s2), np.uint8)
                first = np.lexsort((s2, rank))[:prefix - unique]
                k1, k2 = _keys(s)
                rows.append({"row": int(ids[i]), "id": int(_class(np.array([n]), np.array([k1]), np.array([k2]))[0]), "n": n, "unique": unique, "tokens": s2[first].view(np.int64),
                             "places": np.arange(unique, unique + len(first)), "set": s.tobytes()})
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY)
    return run


_ENTRY = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("unique", pa.int64()), ("tokens", pa.list_(pa.int64())),
                    ("places", pa.list_(pa.int64())), ("set", pa.binary())])
_ENTRY_SQL = "row long, id long, n long, unique long, tokens array<bigint>, places array<bigint>, set binary"


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("set_a"), batch.column("set_b")
        both = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64),
                                   assume_unique=True)) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64())],
                                         ["a", "b", "both"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both (intersection size), na, nb of the pairs."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("set").alias("set_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = joined.select("a", "b", "set_a", "set_b").mapInArrow(_intersect, "a long, b long, both long")
    sizes = sets.select("id", "n")
    return both.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")


def _linked(percent: int):
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def _far(gap, total, percent: int):
    """A distance no link can have: |x ^ y| > (1 - t) / (1 + t) * (|x| + |y|)."""
    return (100 + percent) * gap > (100 - percent) * total


def links(docs: DataFrame, reps: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """a, b: links between classes that connect all that are connected.  ``reps``: row, id (class) of one row of each."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = repeated(docs.select("text"), _hashes(size), total * 4 // 10)
    counts = docs.select("text").mapInArrow(_frequent(size, sketch), "s long, c long") \
        .groupBy("s").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "s").limit(MAX_FREQUENT).toArrow()
    known, many = counts["s"].to_numpy().view(np.uint64), counts["c"].to_numpy()
    order = np.argsort(known)
    level = np.floor(np.log2(many[order].astype(np.float64) + 1e-9)).astype(np.uint8)
    frequent = sc.broadcast((known[order].tobytes(), level.tobytes()))
    del counts, known, many
    found = texts.mapInArrow(_prefixes(size, percent, sketch, frequent), _ENTRY_SQL)
    found = stored(found, "shingle-sets")
    sketch.held.destroy()       # what they were for is written
    frequent.destroy()
    entries = found.join(reps, ["row", "id"], "left_semi").dropDuplicates(["id"])
    sets = entries.select("id", "n", "set")
    index = checkpointed(entries.select("id", "n", "unique", F.arrays_zip("tokens", "places").alias("t"))
                         .select("id", "n", "unique", F.explode("t").alias("t"))
                         .select("id", "n", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"),
                                 (F.col("unique") * 1000 / F.col("n")).cast("long").alias("apart")))
    # 2. every set against the leader it shares most lists with
    lead = index.groupBy("token").agg(F.min(F.struct("apart", "id")).alias("lead"), F.count("*").alias("many")) \
        .where("many > 1").select("token", F.col("lead.id").alias("leader"))
    choice = index.join(lead, "token").where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("c")) \
        .groupBy("id").agg(F.max(F.struct("c", (-F.col("leader")).alias("l"))).alias("best")) \
        .select(F.col("id").alias("a"), (-F.col("best.l")).alias("b"))
    stars = checkpointed(overlaps(choice, sets).where(_linked(percent)).select(
        "a", "b", (F.col("na") + F.col("nb") - 2 * F.col("both")).alias("d")))
    comps = checkpointed(components(stars.select("a", "b")))
    # 3. lists that still hold several components, in blocks of one cluster each
    place = index.join(comps, "id", "left").join(stars.withColumnRenamed("a", "id"), "id", "left").select(
        "token", "id", "n", "place", F.coalesce("component", "id").alias("comp"),
        F.coalesce("b", "id").alias("lead"), F.coalesce("d", F.lit(0)).alias("d"))
    open_ = place.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
        .where("lo <> hi").select("token")
    rest = checkpointed(place.join(open_, "token", "left_semi"))
    blocks = rest.groupBy("token", "lead", "comp").agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("place")).alias("left"),
        F.max("d").alias("d"))
    x, y = (blocks.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("lead", "comp", "n0", "n1", "left", "d")))
            for s in "xy")
    # sizes may meet, and the shingles from the shared one on may suffice for the smaller union
    meet = (F.col("lead_x") < F.col("lead_y")) & (F.col("comp_x") != F.col("comp_y")) \
        & (100 * F.col("n1_x") >= percent * F.col("n0_y")) & (100 * F.col("n1_y") >= percent * F.col("n0_x")) \
        & ((100 + percent) * F.least("left_x", "left_y") >= percent * (F.col("n0_x") + F.col("n0_y")))
    meets = checkpointed(x.join(y, "token").where(meet).select(
        "token", F.col("lead_x").alias("a"), F.col("lead_y").alias("b")))
    known = checkpointed(overlaps(meets.select("a", "b").distinct(), sets)
                         .withColumn("gap", F.col("na") + F.col("nb") - 2 * F.col("both")))
    direct = known.where(_linked(percent)).select("a", "b")
    # leaders that are linked by now make their clusters one component: nothing is open between them
    now = checkpointed(components(stars.select("a", "b").union(direct)))
    reach = rest.groupBy("lead").agg(F.max("d").alias("r"), F.max("n").alias("m"))
    near = known.join(reach.toDF("a", "ra", "ma"), "a").join(reach.toDF("b", "rb", "mb"), "b") \
        .where(~_far(F.col("gap") - F.col("ra") - F.col("rb"), F.col("ma") + F.col("mb"), percent)) \
        .where("ra + rb > 0").join(now.toDF("a", "ca"), "a", "left").join(now.toDF("b", "cb"), "b", "left") \
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "gap")
    # what b's members on this list allow: their largest distance to the leader, sizes and shingles left
    there = blocks.select("token", F.col("lead").alias("b"), F.col("n0").alias("n0_b"), F.col("n1").alias("n1_b"),
                          F.col("left").alias("left_b"), F.col("d").alias("d_b"))
    lists = meets.join(near, ["a", "b"]).join(there, ["token", "b"])
    u, v = (rest.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "place", "lead", "d"))) for s in "uv")
    left = lists.join(u.withColumnRenamed("lead_u", "a"), ["token", "a"]) \
        .where(~_far(F.col("gap") - F.col("d_u") - F.col("d_b"), F.col("n_u") + F.col("n1_b"), percent)) \
        .where((100 * F.col("n_u") >= percent * F.col("n0_b")) & (100 * F.col("n1_b") >= percent * F.col("n_u"))) \
        .where((100 + percent) * F.least(F.col("n_u") - F.col("place_u"), "left_b") >= percent * (F.col("n_u") + F.col("n0_b")))
    single = left.join(v.withColumnRenamed("lead_v", "b"), ["token", "b"]) \
        .where((F.col("id_u") != F.col("a")) | (F.col("id_v") != F.col("b"))) \
        .where(~_far(F.col("gap") - F.col("d_u") - F.col("d_v"), F.col("n_u") + F.col("n_v"), percent)) \
        .where((100 + percent) * F.least(F.col("n_u") - F.col("place_u"), F.col("n_v") - F.col("place_v"))
               >= percent * (F.col("n_u") + F.col("n_v"))) \
        .select(F.col("id_u").alias("a"), F.col("id_v").alias("b")).distinct()
    return stars.select("a", "b").union(direct) \
        .union(overlaps(single, sets).where(_linked(percent)).select("a", "b"))


def classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """id, n_shingles, cls (the set's class), rep (smallest id with the same set) of every row."""
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text")
    keys = texts.mapInArrow(_set_keys(size), "id long, n long, cls long")
    keys = checkpointed(keys)
    reps = keys.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"))
    return keys.join(reps, "cls", "left").select("id", F.col("n").alias("n_shingles"), "cls", "rep")


def _ties(rows: DataFrame, null_is_one: bool) -> DataFrame:
    """a, b: every class of a doc_id's rows tied to the least of them."""
    held = rows.where("cls is not null").select("id", "cls").distinct()
    least = held.where(F.col("id") != LAST_ID).groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")) \
        .where("a <> b").select("id", "a")
    ties = held.join(least, "id").select("a", F.col("cls").alias("b"))
    if null_is_one:
        none = held.where(F.col("id") == LAST_ID).select("cls")
        ties = ties.union(none.select(F.lit(none.agg(F.min("cls")).first()[0]).cast("long").alias("a"), F.col("cls").alias("b")))
    return ties.where("a <> b")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, null_is_one: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; rows without a doc_id are one node or each its own."""
    rows = checkpointed(classes(docs, size))
    reps = rows.where("id = rep").select(F.col("id").alias("row"), F.col("cls").alias("id")).distinct()
    found = links(docs, reps, size, percent)
    # rows of one doc_id with different sets tie their classes together
    comps = checkpointed(components(found.union(_ties(rows, null_is_one))))
    least = checkpointed(comps.join(reps, "id").groupBy("component").agg(F.min("row").alias("least")))
    named = comps.join(small(least, least.count(), MAX_BROADCAST), "component").select(F.col("id").alias("cls"), "least")
    out = rows.join(named, "cls", "left")
    real = lambda c: F.when(c != LAST_ID, c)
    return out.select(real(F.col("id")).alias("doc_id"), "n_shingles",
                      real(F.coalesce("least", "rep", "id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, one of each group of linked ones: that with the smallest doc_id
    (all its rows).  Documents without words and rows without a doc_id stay."""
    groups = join(docs, size, percent, null_is_one=False).where("n_shingles > 0 and doc_id <> component_id")
    gone = checkpointed(groups.select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(small(gone, gone.count(), MAX_BROADCAST), F.col("doc_id") == F.col("__gone"), "left_anti")
