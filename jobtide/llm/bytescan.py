"""Words and rolling hashes straight from Arrow string buffers, without Python strings.

A batch is cut into pieces of about ``PIECE`` bytes (a longer text is a piece of its own).  Words are
maximal runs of bytes that the separator table doesn't hold; no word crosses a text.  Word and window
hashes are polynomials modulo 2**64 over random byte values, taken as differences of prefix sums and
mixed; equal words get equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE, _STEP_A, _STEP_B = (np.uint64(x | 1) for x in _RNG.integers(1 << 62, 1 << 63, 3).tolist())


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            make = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))])
            up, down = make(self.base), make(self.inverse)
            if n > 4 * PIECE:       # a very long text: don't keep
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


_POW_BYTE, _POW_A, _POW_B = _Powers(_BASE), _Powers(_STEP_A), _Powers(_STEP_B)


class Piece:
    """Some texts of a batch: ``rows`` (slice of the batch), ``data`` (bytes), ``offsets`` of the texts."""

    def __init__(self, rows: slice, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def words(self) -> None:
        """Set starts and ends of the words, and first: index of each text's first word (one more at the end)."""
        n = len(self.data)
        sep = np.ones(n + 2, bool)
        sep[1:-1] = BLANK[self.data]
        cut = self.offsets[1:-1]
        begin, finish = ~sep[1:-1] & sep[:-2], ~sep[1:-1] & sep[2:]
        cut = cut[(cut > 0) & (cut < n)]
        begin[cut] |= ~sep[1:-1][cut]
        finish[cut - 1] |= ~sep[1:-1][cut - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        up, down = _POW_BYTE(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[self.data] * up[:len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts]
                   + (self.ends - self.starts).astype(np.uint64))

    def windows(self, hashes: np.ndarray, size: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words inside one text, and the windows' first words."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = (_POW_B if second else _POW_A)(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=total[1:])
        inside = np.ones(n - size + 1, bool)
        for k in range(1, size):     # no window may run over a text's end
            at = self.first[1:-1] - k
            inside[at[(at >= 0) & (at < len(inside))]] = False
        at = np.flatnonzero(inside)
        return mix((total[at + size] - total[at]) * down[at]), at


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[Piece]:
    texts = batch.column(column)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        yield Piece(slice(at, to), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to
