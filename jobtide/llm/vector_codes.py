"""Vector code compression: product codebooks fitted with norm-of-sum bounds (operator 13).

Vectors become integers (floor of ``SCALE`` times each component) and are cut into equal parts.  Every part position has a
codebook of entries; a vector's code is the index of the nearest entry for each part.  Entries start as the parts of the
vectors with the smallest ids, and each round replaces an entry by the floored mean of the parts assigned to it.  All
distances and means are integers, so the result doesn't depend on how rows are spread.

Assignments after the first are proven where possible instead of searched.  For each part, a row keeps a lower bound
on its distance to every entry but its own, and the round in which the bound was measured (its stamp).  All earlier
codebooks are kept.  In a later round the distance to the own entry is computed; entry j has moved by the norm
||c_j(now) - c_j(stamp)|| of its summed steps, which is at most the sum of the steps' norms.  If the own distance is less
than the bound minus the largest such displacement of another entry, the assignment stands, and bound and stamp stay as
they are; else the part is searched exactly and gets a new bound and stamp.  A row's state is a written table between rounds.

What passes through the driver is bounded by parts x entries: the codebooks and the sums of the parts assigned to each entry.

Cases: vectors that are null or hold null or non-finite components take no part, nor do empty ones and those whose length
differs from that of the kept vector with the smallest id; a length that the parts don't divide is filled up with
zeros; integers beyond ``limit`` are set to it, so that no squared distance leaves a long; with fewer vectors than
entries the codebooks are shorter; rows of one vec_id are ordered by their components; a null vec_id comes last; a sum of
errors beyond a long is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import small, stored

SCALE = 256
MAX_LABELS = 100_000    # labels whose sums are broadcast; more are joined by shuffle
SALTS = 16              # ... with a label's rows split over so many keys
_STATE = "vec_id long, label int, parts binary, code binary, bound binary, stamp binary"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not empty and holds finite components only."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ok)


def limit(size: int) -> int:
    """Largest magnitude of an integer component at which squared distances of ``size`` components fit a long."""
    return 1 << ((61 - max(size - 1, 1).bit_length()) // 2)


def integers(flat: np.ndarray, size: int, parts: int) -> np.ndarray:
    """Rows x parts x width integers of vectors of ``size`` components."""
    width, most = -(-size // parts), limit(size)
    out = np.zeros((len(flat) // size, parts * width), np.int64)
    out[:, :size] = np.clip(np.floor(flat.astype(np.float64).reshape(-1, size) * SCALE), -most, most)
    return out.reshape(-1, parts, width)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


def search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower one) and a lower bound on the distance to all others."""
    d = distances(x, entries)
    code = d.argmin(axis=1)
    d[np.arange(len(x)), code] = np.iinfo(np.int64).max
    return code, np.nextafter(np.sqrt(d.min(axis=1).astype(np.float64)).astype(np.float32), np.float32(0))


def net_moves(history: Sequence[np.ndarray], stamp: int) -> np.ndarray:
    """For each entry, the largest net displacement of any other entry from round ``stamp`` to now."""
    step = (history[-1] - history[stamp]).astype(np.float64)
    move = np.sqrt((step * step).sum(axis=1))
    if len(move) < 2:
        return np.zeros(len(move))
    order = np.argsort(move)
    return np.where(np.arange(len(move)) == order[-1], move[order[-2]], move[order[-1]])


def reassign(x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray, history: Sequence[np.ndarray]):
    """Codes, bounds and stamps against the newest codebook of one part, and the rows that had to be searched."""
    own = np.sqrt(((x - history[-1][code]) ** 2).sum(axis=1).astype(np.float64))
    least = np.zeros(len(x))
    for t in np.unique(stamp).tolist():
        at = stamp == t
        least[at] = bound[at] - net_moves(history, t)[code[at]] * (1 + 1e-9)
    open_ = np.flatnonzero(~(own * (1 + 1e-9) < least))
    code, bound, stamp = code.copy(), bound.copy(), stamp.copy()
    if len(open_):
        code[open_], bound[open_] = search(x[open_], history[-1])
        stamp[open_] = len(history) - 1
    return code, bound, stamp, open_


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _array(column: pa.Array, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _first(vectors: DataFrame, size: int, parts: int, codebooks: np.ndarray) -> DataFrame:
    """State after the first assignment: all parts searched."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = integers(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), size, parts)
            found = [search(x[:, p], codebooks[p]) for p in range(parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), _bytes(x.reshape(n, -1).astype("<i4")),
                 _bytes(np.stack([c for c, _ in found], 1).astype(np.uint8)),
                 _bytes(np.stack([b for _, b in found], 1).astype("<f4")), _bytes(np.zeros((n, parts), np.uint8))],
                ["vec_id", "label", "parts", "code", "bound", "stamp"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, _STATE)


def _opened(batch: pa.RecordBatch, parts: int):
    n = batch.num_rows
    x = _array(batch.column("parts"), "<i4", n).reshape(n, parts, -1).astype(np.int64)
    return x, _array(batch.column("code"), "u1", n).astype(np.int64)


def _next(state: DataFrame, parts: int, history: list[np.ndarray], last: bool) -> DataFrame:
    """State after one more assignment, or codes and errors after the last one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, code = _opened(batch, parts)
            bound, stamp = _array(batch.column("bound"), "<f4", n), _array(batch.column("stamp"), "u1", n)
            found = [reassign(x[:, p], code[:, p], bound[:, p], stamp[:, p], [h[p] for h in history]) for p in range(parts)]
            code = np.stack([f[0] for f in found], 1)
            if last:
                near = np.stack([history[-1][p][code[:, p]] for p in range(parts)], 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"),
                     pa.array([r.tobytes().hex() for r in code.astype(np.uint8)], pa.string()),
                     pa.array(((x - near) ** 2).sum(axis=(1, 2)))], ["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), batch.column("parts"), _bytes(code.astype(np.uint8)),
                     _bytes(np.stack([f[1] for f in found], 1).astype("<f4")),
                     _bytes(np.stack([f[2] for f in found], 1).astype(np.uint8))],
                    ["vec_id", "label", "parts", "code", "bound", "stamp"])

    return state.mapInArrow(run, "vec_id long, label int, code string, error long" if last else _STATE)


def updated(state: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floored mean of the parts assigned to it; unused entries stay."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, code = _opened(batch, parts)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], x[:, p])
                    count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat((p * entries + e) * width, width) + np.tile(np.arange(width), len(p))),
             pa.array(total[p, e].ravel()), pa.array(np.repeat(count[p, e], width))], ["place", "total", "n"])

    out = codebooks.reshape(-1).copy()
    sums = state.select("parts", "code").mapInArrow(run, "place long, total long, n long") \
        .groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in sums.collect():
        out[r.place] = r.total // r.n
    return out.reshape(codebooks.shape)


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error: the errors summed over equal labels, nulls together."""
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    n = sums.count()
    if n <= MAX_LABELS:
        return coded.join(small(sums, n, MAX_LABELS), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    salted = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mine = coded.withColumn("mine", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return mine.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("mine") == F.col("salt")), "left") \
        .drop("of", "salt", "mine")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every usable vector, and the final codebooks (parts x entries x width)."""
    if not 0 < entries <= 256:
        raise ValueError("an index is one byte: entries must be 1 to 256")
    if rounds < 1:
        raise ValueError("at least one round")
    kept = usable(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "embedding"))
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = kept.orderBy(*by_id).limit(1).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id long, label int, code string, error long"), \
            np.zeros((parts, 0, 0), np.int64)
    size = len(first[0].embedding)
    kept = kept.where(F.size("embedding") == size)
    seeds = kept.orderBy(*by_id).limit(entries).collect()
    history = [integers(np.array([r.embedding for r in seeds], np.float64).ravel(), size, parts).transpose(1, 0, 2)]
    state = stored(_first(kept, size, parts, history[0]), "codes-0")
    for k in range(1, rounds + 1):
        history.append(updated(state, history[-1]))
        state = stored(_next(state, parts, list(history), k == rounds), f"codes-{k}")
    return state, history[-1]


def digest(vectors: DataFrame) -> DataFrame:
    """Codes and errors, label_error, and one hash of the final codebooks."""
    coded, codebooks = compress(vectors)
    text = ",".join(map(str, codebooks.ravel().tolist()))
    return with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
