"""Fixed virtual slots (operator 4).

Every record hashes into one of ``n_slots`` virtual slots and never leaves it.  The bytes and rows
of a slot are aggregated, and a versioned slot-to-shard map says which shard holds which slot.
Rebalancing edits the map only: it moves or swaps whole slots, so few records change shard.

* version 0: slot modulo shards;
* ``rebalance``: next version, shard bytes brought as close together as the slots allow;
* ``grow``: next version with one more shard that takes slots from the others only into itself.

Law of ``assign``: ``bytes`` (shard sizes near equal).  The map has ``n_slots`` rows whatever the
input, so it may pass through the driver and be broadcast.

Cases: a null text has size 1 (0 bytes plus 1) and the CRC of the empty text; a null doc_id hashes
like any value; repeated rows share a virtual slot and get different positions; an empty table gives
an empty result and version 0 of the map; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtide.llm.common import small

N_SLOTS = 4096
N_SHARDS = 16


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot: the narrow columns everything else works on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slots)).cast("int").alias("vslot"))


def slot_weights(slots: DataFrame, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each virtual slot (n_slots values each)."""
    size, rows = np.zeros(n_slots, np.int64), np.zeros(n_slots, np.int64)
    for r in slots.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.vslot], rows[r.vslot] = r.b, r.n
    return size, rows


def initial_map(n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> np.ndarray:
    return np.arange(n_slots, dtype=np.int64) % n_shards


def rebalance(owner: np.ndarray, weights: np.ndarray, n_shards: int) -> np.ndarray:
    """The map with slots moved or swapped between the fullest and the emptiest shard until
    no such step brings the two closer together."""
    owner = owner.copy()
    load = np.bincount(owner, weights=weights, minlength=n_shards).astype(np.int64)
    while True:     # every step brings two loads closer together, so this ends
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = int(load[hi] - load[lo])
        a, b = np.flatnonzero(owner == hi), np.flatnonzero(owner == lo)
        if not len(a):
            break
        # One slot of hi against one slot of lo or against nothing: the shift nearest gap / 2.  For each slot of hi
        # the best of lo stands next to its weight less gap / 2 among the sorted weights.
        order = np.argsort(weights[b], kind="stable")
        give = np.concatenate([[0], weights[b][order]])
        ascending = np.argsort(give, kind="stable")
        near = np.searchsorted(give[ascending], weights[a] - gap / 2)
        near = ascending[np.clip(np.stack([near - 1, near]), 0, len(give) - 1)]
        shift = weights[a] - give[near]
        off = np.where((shift > 0) & (shift < gap), np.abs(2 * shift - gap), gap)
        if off.min() >= gap:
            break
        side, i = np.unravel_index(off.argmin(), off.shape)
        j = near[side, i]
        owner[a[i]] = lo
        if j:
            owner[b[order[j - 1]]] = hi
        load[hi] -= shift[side, i]
        load[lo] += shift[side, i]
    return owner


def grow(owner: np.ndarray, weights: np.ndarray, n_shards: int) -> np.ndarray:
    """One more shard: the fullest shard hands over slots until the new one holds its share."""
    owner, new = owner.copy(), n_shards
    load = np.bincount(owner, weights=weights, minlength=n_shards + 1).astype(np.int64)
    while True:
        hi = int(load[:n_shards].argmax())
        mine = np.flatnonzero(owner == hi)
        fits = mine[(weights[mine] > 0) & (load[new] + weights[mine] <= load[hi] - weights[mine])]
        if not len(fits):
            return owner
        pick = fits[weights[fits].argmax()]
        owner[pick] = new
        load[hi] -= weights[pick]
        load[new] += weights[pick]


def write_map(spark: SparkSession, path: str, version: int, owner: np.ndarray) -> None:
    """Store one version of the map; earlier versions stay readable."""
    rows = [(i, int(s)) for i, s in enumerate(owner)]
    spark.createDataFrame(rows, "vslot int, shard int").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> np.ndarray:
    rows = spark.read.parquet(f"{path.rstrip('/')}/version={version}").collect()
    owner = np.zeros(len(rows), np.int64)
    for r in rows:
        owner[r.vslot] = r.shard
    return owner


def assign(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS,
           map_path: str | None = None) -> DataFrame:
    """Every record's shard and its gapless position there, sizes near equal.

    With ``map_path`` the two versions of the map (initial and rebalanced) are stored there.
    A position is the record's rank inside its virtual slot plus the rows of the slots before it in
    the shard, so no task ever sorts a whole shard.
    """
    spark = docs.sparkSession
    slots = with_slots(docs, n_slots)
    size, rows = slot_weights(slots, n_slots)
    first = initial_map(n_slots, n_shards)
    owner = rebalance(first, size, n_shards)
    if map_path:
        write_map(spark, map_path, 0, first)
        write_map(spark, map_path, 1, owner)
    base, seen = np.zeros(n_slots, np.int64), np.zeros(n_shards, np.int64)
    for s in range(n_slots):
        base[s] = seen[owner[s]]
        seen[owner[s]] += rows[s]
    table = spark.createDataFrame([(s, int(owner[s]), int(base[s])) for s in range(n_slots)],
                                  "vslot int, shard int, base long")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return slots.withColumn("rank", rank).join(small(table, n_slots, 1 << 16), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
