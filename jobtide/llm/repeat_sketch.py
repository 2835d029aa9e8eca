"""A count-min prefilter for hashes that occur more than once.

Every task sketches the hashes it meets: it sends, for each slice of the sketch, the 24-bit places of
its hashes (each at most twice, sorted, as differences).  The slices' sketches of all tasks are merged
by adding up two rows of counters, each addressed by other bits of the place.  A hash whose two
counters are both at least two may be repeated; a repeated hash always passes, since collisions
only add.  What comes back is one bit per counter.

The sketch has about one bit per unit the caller counts, and never more than ``MAX_SLICES`` slices
(96 MB of bits), so what is collected and broadcast is bounded.  Beyond that size its estimates get
looser and more hashes pass; none is lost.  Tasks beyond what one task a slice can read are merged in two levels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

ROW_BITS = 21                       # counters of a row of one slice
SLICE_BYTES = 2 << (ROW_BITS - 3)   # two rows of bits
MAX_SLICES = 192
FAN_UNITS = 64 * MAX_SLICES * SLICE_BYTES * 8   # units one level of merging takes
FLUSH = 2 << 20                     # hashes a task holds before it sends a part of its sketch
_ODD = np.uint32(0x9E3779B1)
SCHEMA = "slice int, salt int, once binary, twice binary"


def slices_for(units: int) -> int:
    return max(1, min(MAX_SLICES, -(-units // (SLICE_BYTES * 8))))


def _slice(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)


def _rows(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = place.astype(np.uint32)
    other = (place * _ODD) & np.uint32((1 << 24) - 1)
    return place & np.uint32((1 << ROW_BITS) - 1), other >> np.uint32(24 - ROW_BITS)


def _pack(sorted_places: np.ndarray) -> bytes:
    step = np.diff(sorted_places, prepend=np.uint32(0))
    small = not len(step) or step.max() < 1 << 16
    return (b"s" if small else b"l") + step.astype(np.uint16 if small else np.uint32).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw[1:], np.uint16 if raw[:1] == b"s" else np.uint32), dtype=np.uint32)


def fan_for(units: int) -> int:
    return max(1, -(-units // FAN_UNITS))


def sketch_parts(hashes: Iterator[np.ndarray], n_slices: int, fan: int = 1) -> Iterator[pa.RecordBatch]:
    """A task's sketch of its hashes, as rows of SCHEMA."""
    held, size = [], 0
    salt = TaskContext.get().partitionId() % fan

    def flush():
        # slice and place in one number: 24 low bits are the place
        h = np.concatenate(held)
        number = np.sort((_slice(h, n_slices) << np.uint64(24)) | (h & np.uint64((1 << 24) - 1)))
        new = np.ones(len(number), bool)
        new[1:] = number[1:] != number[:-1]
        again = ~new
        again[1:] &= new[:-1]            # the second of equal numbers
        out = []
        for kind in (number[new], number[again]):
            cut = np.searchsorted(kind >> np.uint64(24), np.arange(n_slices + 1))
            place = (kind & np.uint64((1 << 24) - 1)).astype(np.uint32)
            out.append([_pack(place[cut[s]:cut[s + 1]]) for s in range(n_slices)])
        return pa.RecordBatch.from_pydict({"slice": pa.array(range(n_slices), pa.int32()),
                                           "salt": pa.array([salt] * n_slices, pa.int32()),
                                           "once": pa.array(out[0], pa.binary()),
                                           "twice": pa.array(out[1], pa.binary())})

    for h in hashes:
        held.append(h)
        size += len(h)
        if size >= FLUSH:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of each (slice, salt) as two bits: at least one, at least two."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        rows: dict[tuple[int, int], list[np.ndarray]] = {}
        for s, salt, *raws in zip(*(batch.column(i).to_pylist() for i in range(4))):
            rows.setdefault((s, salt), []).extend(map(_unpack, raws))
        for key, places in rows.items():
            count = held.setdefault(key, np.zeros((2, 1 << ROW_BITS), np.uint8))
            for row, at in zip(count, _rows(np.concatenate(places))):
                add = np.bincount(at, minlength=1 << ROW_BITS)
                np.minimum(row + np.minimum(add, 2), 2, out=row, casting="unsafe")
    for (s, salt), count in held.items():
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array([s], pa.int32()),
            "one": pa.array([zlib.compress(np.packbits(count >= 1).tobytes(), 1)], pa.binary()),
            "two": pa.array([zlib.compress(np.packbits(count >= 2).tobytes(), 1)], pa.binary())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of a slice's salts added up."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for s, *raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            one, two = (np.frombuffer(zlib.decompress(x), np.uint8) for x in raw)
            if s in held:
                one, two = held[s][0] | one, held[s][1] | two | held[s][0] & one
            held[s] = one, two
    for s, (one, two) in held.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "one": pa.array([b""], pa.binary()),
                                          "two": pa.array([zlib.compress(two.tobytes(), 1)], pa.binary())})


class _Bits:
    """The slices' bits, compressed as they travel and opened once in a worker process."""

    def __init__(self, blobs: list[bytes]):
        self.blobs, self.open = blobs, None

    def array(self) -> np.ndarray:
        if self.open is None:
            raw = b"".join(zlib.decompress(b) if b else bytes(SLICE_BYTES) for b in self.blobs)
            self.open, self.blobs = np.frombuffer(raw, np.uint8), []
        return self.open


class Repeated:
    """The merged sketch, broadcast: ``maybe(hashes)`` tells which may occur more than once."""

    def __init__(self, parts: DataFrame, n_slices: int, fan: int = 1):
        planes = "slice int, one binary, two binary"
        merged = parts.repartition(n_slices * fan, "slice", "salt").mapInArrow(_count, planes)
        if fan > 1:
            merged = merged.repartition(n_slices, "slice").mapInArrow(_add, planes)
        # bounded: MAX_SLICES slices
        blobs = {row["slice"]: bytes(row["two"]) for row in merged.select("slice", "two").collect()}
        bits = _Bits([blobs.get(s, b"") for s in range(n_slices)])
        self.n_slices, self.held = n_slices, parts.sparkSession.sparkContext.broadcast(bits)

    def maybe(self, h: np.ndarray) -> np.ndarray:
        bits = self.held.value.array()
        base = _slice(h, self.n_slices).astype(np.int64) * SLICE_BYTES
        hit = np.ones(len(h), bool)
        for row, at in enumerate(_rows(h & np.uint64((1 << 24) - 1))):
            byte = bits[base + row * (SLICE_BYTES // 2) + (at >> np.uint32(3))]
            hit &= (byte >> (np.uint32(7) - (at & np.uint32(7))).astype(np.uint8)) & 1 == 1
        return hit


def repeated(df: DataFrame, hashes, units: int) -> Repeated:
    """Sketch of ``hashes(batches)``, a generator of hash arrays, over all of ``df``."""
    n, fan = slices_for(units), fan_for(units)
    parts = df.mapInArrow(lambda batches: sketch_parts(hashes(batches), n, fan), SCHEMA)
    return Repeated(parts, n, fan)
