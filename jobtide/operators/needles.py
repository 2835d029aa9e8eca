"""Many fixed strings searched in many texts at once, on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

PIECE = 1 << 20         # bytes of text searched at a time
EXPAND = 1 << 22        # candidates compared at a time
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SIZES = (8, 4, 2, 1)


class _Keyed:
    """Needles by their first ``size`` bytes as a number, and a table that rules most other numbers out."""

    def __init__(self, size: int, needles: list[tuple[bytes, int]]):
        self.size = size
        needles = sorted(needles, key=lambda n: int.from_bytes(n[0][:size], "little"))
        key = np.array([int.from_bytes(n[:size], "little") for n, _ in needles], np.uint64)
        self.keys, self.start, self.count = np.unique(key, return_index=True, return_counts=True)
        self.value = np.array([v for _, v in needles], np.int64)
        self.length = np.array([len(n) for n, _ in needles], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(n for n, _ in needles), np.uint8)
        self.shift = np.uint64(64 - max(16, (16 * len(self.keys)).bit_length()))
        self.table = np.zeros(1 << int(64 - self.shift), bool)
        self.table[(self.keys * _ODD) >> self.shift] = True

    def find(self, buf: np.ndarray, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, value) of every occurrence; text k is buf[first[k]:first[k + 1]]."""
        place = np.flatnonzero(self.table[(words.astype(np.uint64) * _ODD) >> self.shift])
        at = np.minimum(np.searchsorted(self.keys, words[place].astype(np.uint64)), len(self.keys) - 1)
        same = self.keys[at] == words[place]
        place, at = place[same], at[same]
        upto = np.cumsum(self.count[at])
        low = 0
        while low < len(place):
            before = int(upto[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(upto, before + EXPAND, "right")))
            p, a = place[low:high], at[low:high]
            n = self.count[a]
            needle = np.repeat(self.start[a] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            p = np.repeat(p, n)
            low = high
            text = np.searchsorted(first, p, "right") - 1
            inside = p + self.length[needle] <= first[text + 1]
            p, needle, text = p[inside], needle[inside], text[inside]
            j = self.size
            while len(p):
                whole = self.length[needle] == j
                if whole.any():
                    yield text[whole], self.value[needle[whole]]
                    p, needle, text = p[~whole], needle[~whole], text[~whole]
                same = buf[p + j] == self.flat[self.offset[needle] + j]
                p, needle, text = p[same], needle[same], text[same]
                j += 1


class Needles:
    """needles[k]: strings any of which stands for number k."""

    def __init__(self, needles: Sequence[Sequence[str]]):
        self.n = len(needles)
        by_size: dict[int, list[tuple[bytes, int]]] = {}
        for k, mine in enumerate(needles):
            for raw in {s.encode() for s in mine}:
                by_size.setdefault(next(z for z in _SIZES if z <= len(raw)), []).append((raw, k))
        self.keyed = [_Keyed(size, mine) for size, mine in by_size.items()]

    def _piece(self, buf: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sorted text * n + number of the numbers found in each text."""
        words, w, reach = {}, np.concatenate([buf, np.zeros(8, np.uint8)]), 1
        while True:
            words[reach] = w[:len(buf)]
            if reach >= max((k.size for k in self.keyed), default=0):
                break
            wide = w.astype(f"u{2 * reach}")
            w = wide[:-reach] | (wide[reach:] << wide.dtype.type(8 * reach))
            reach *= 2
        found = [text * self.n + value for k in self.keyed for text, value in k.find(buf, words[k.size], first)]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, texts: pa.Array) -> pa.Array:
        """list<int32>: ascending numbers found in each text; none in a null."""
        texts = texts.cast(pa.large_string())
        first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] \
            if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        numbers, counts, low = [], [], 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(first, first[low] + PIECE, "right")) - 1)
            ends = first[low:high + 1]
            got = self._piece(buf[ends[0]:ends[-1]], ends - ends[0])
            text, number = np.divmod(got, max(1, self.n))
            numbers.append(number.astype(np.int32))
            counts.append(np.bincount(text, minlength=high - low))
            low = high
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                        pa.array(np.concatenate(numbers) if numbers else np.zeros(0, np.int32)))
