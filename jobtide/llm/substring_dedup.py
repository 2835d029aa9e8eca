"""Exact substring deduplication behind a count-min prefilter (operator 1).

Pass 1 sketches the hashes of all windows of ``WINDOW`` words; the merged sketch overestimates how
often a window occurs and never underestimates.  Pass 2 keeps the windows whose estimate is two or more
and groups them exactly by a 96-bit key: a window goes if a document with a smaller doc_id holds it.
Within a task every occurrence beyond the smallest document's is decided on the spot and sent as spans,
so a window that a third of all documents hold reaches its group once per task, not once per document.

The sketch's size follows the bytes of the texts up to a bound (see ``repeat_sketch``); beyond the bound
more windows reach the exact pass, with the same results.

Cases: a null or empty text has no words; windows repeated inside one document alone stay; rows with the
same doc_id are one document for the comparison (none of them removes from another) and each keeps its
own words (a 64-bit hash of the text tells them apart); a null doc_id counts as larger than every other; repeated rows get equal results; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.bytescan import pieces
from jobtide.llm.common import small
from jobtide.llm.repeat_sketch import Repeated, repeated

WINDOW = 13
FLUSH = 2 << 20        # candidate windows a task decides at a time
LAST_ID = (1 << 63) - 1
_LEN = 0xFFFF          # a place is first window << 16 | windows in a row
MAX_BROADCAST = 1 << 19


def _window_hashes(size: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for p in pieces(batch):
                p.words()
                yield p.windows(p.word_hashes(), size)[0]
    return hashes


def _decide(k1, k2, doc, place, th=None) -> Iterator[pa.RecordBatch]:
    """Local decisions as spans (k2 = -1), the smallest document's windows as they are, in text
    order, in which neighbours compress well."""
    th = np.zeros(len(doc), np.int64) if th is None else th
    order = np.lexsort((doc, k2, k1))
    a, b, d = k1[order], k2[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    gone = np.zeros(len(a), bool)
    gone[order] = d > d[new][np.cumsum(new) - 1]
    d, p, t = doc[gone], place[gone], th[gone]
    order = np.lexsort((p, t, d))
    d, p, t = d[order], p[order], t[order]
    other = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    keep = np.ones(len(p), bool)
    keep[1:] = other | (p[1:] != p[:-1])       # repeated rows give a place twice
    d, p, t = d[keep], p[keep], t[keep]
    start = np.ones(len(p), bool)
    start[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1] + (1 << 16))
    run = np.arange(len(p)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(p) else np.zeros(0, np.int64)
    start |= run % (_LEN - 1) == 0
    first = np.flatnonzero(start)
    spans = p[first] - 1 + np.diff(np.append(first, len(p)))
    rows = (np.concatenate([k1[~gone], spans ^ d[first] ^ t[first]]), np.concatenate([k2[~gone], np.full(len(first), -1, np.int32)]),
            np.concatenate([doc[~gone], d[first]]), np.concatenate([place[~gone], spans]), np.concatenate([th[~gone], t[first]]))
    for at in range(0, len(rows[0]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(r[at:at + (1 << 17)]) for r in rows], ["k1", "k2", "doc", "place", "th"])


def _candidates(size: int, sketch: Repeated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            docs, ths = batch.column("doc").to_numpy(), batch.column("th").to_numpy()
            for p in pieces(batch):
                p.words()
                words = p.word_hashes()
                h, at = p.windows(words, size)
                hit = sketch.maybe(h)
                if not hit.any():
                    continue
                second = p.windows(words, size, second=True)[0][hit]
                at = at[hit]
                row = np.searchsorted(p.first, at, side="right") - 1
                pos = at - p.first[row]
                row += p.rows.start
                held.append((h[hit].view(np.int64), (second >> np.uint64(33)).astype(np.int32), docs[row],
                             (pos << 16) | 1, ths[row]))
                n += len(at)
                if n >= FLUSH:
                    yield from _decide(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            yield from _decide(*map(np.concatenate, zip(*held)))
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc, th of the rows.  th, the text's hash, tells rows of one doc apart; it is 0 where a doc has one
    row, unless the docs of several rows are too many to broadcast."""
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"))
    many = rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("__many"))
    n = many.count()
    if n > MAX_BROADCAST:
        return rows.withColumn("th", F.xxhash64("text"))
    return rows.join(small(many, n, MAX_BROADCAST), F.col("doc") == F.col("__many"), "left") \
        .select("doc_id", "text", "doc", F.when(F.col("__many").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("th"))


def spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc, th, places: the removed windows of the documents that lose words."""
    return _spans(docs, _keyed(docs), size)


def _spans(docs: DataFrame, keyed: DataFrame, size: int) -> DataFrame:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = repeated(docs.select("text"), _window_hashes(size), total * 9 // 10)
    found = keyed.select("doc", "th", "text").mapInArrow(_candidates(size, sketch), "k1 long, k2 int, doc long, place long, th long")
    least = F.min("doc").over(Window.partitionBy("k1", "k2"))
    gone = found.withColumn("least", least).where((F.col("k2") == -1) | (F.col("doc") > F.col("least")))
    return gone.groupBy("doc", "th").agg(F.collect_list("place").alias("places"))


def removed_words(places: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Which words the windows at the places cover."""
    start, run = (places >> 16) & 0xFFFFFFFF, places & _LEN
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + run + size - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(size: int, whole_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            n_words, n_removed, out = [], [], []
            for i, text in enumerate(batch.column("text")):
                raw = text.as_py()
                words = raw.encode().split() if raw else []
                cut = places[i]
                if cut.is_valid:
                    gone = removed_words(np.array(cut.as_py(), np.int64), len(words), size)
                    kept = [words[j] for j in np.flatnonzero(~gone)]
                else:
                    kept = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                kept = b" ".join(kept)
                out.append(kept.decode() if whole_text else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(out, pa.string())})
    return run


def dedup(docs: DataFrame, size: int = WINDOW, whole_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words left joined by one space, or their SHA-256."""
    rows = _keyed(docs)
    cut = _spans(docs, rows, size).select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), "places")
    joined = rows.join(cut, (F.col("doc") == F.col("__doc")) & (F.col("th") == F.col("__th")), "left")
    return joined.select("doc_id", "text", "places").mapInArrow(
        _kept(size, whole_text), "doc_id long, n_words long, n_removed long, kept string")
