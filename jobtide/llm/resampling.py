"""Target-distribution importance resampling with hashed n-gram buckets (operator 12).

Features are runs of consecutive words; a feature's bucket is its bytes' CRC-32 modulo the number of buckets.  The bucket
counts of the corpus and of a target corpus give every bucket a gain (a scaled log ratio); a document's weight is the
floored mean of its features' gains.  A hash of doc_id adds Gumbel noise, so the documents of the highest scores are a
draw without replacement in which a document's odds follow its weight.

CRCs by length-bucketed matrices: the distinct features of about a megabyte of text are grouped by equal length; each group is a
two-dimensional uint8 array, whose rows' CRCs are updated together, column by column; the buckets are scattered back
to the features' places.

The corpus is read twice (counts, then weights).  What reaches the driver and goes back is one number per bucket.  The
documents are ordered by range partitions, so no task sorts them all.

Cases: a null text has no words; a document without features has weight 0; fewer words than a run needs give no
such run; a null doc_id is hashed as an empty one and loses ties; rows of one doc_id are rows of their own, ties between
them go by number of features and then to any; very long texts are read whole; extra columns are ignored; an empty
corpus gives an empty result; an empty target leaves t and T at 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.bytescan import Piece, pieces
from jobtide.operators.numbering import number_within

BUCKETS = 10_000

# Bytes that end a word: 00-2F, 3A-60 but for the upper-case letters, 7B-7F.
_WORD = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _WORD[_low:_high + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional uint8 array, all rows at once, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return ~crc


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one row of each distinct kind, and each row's kind."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    keys = wide.view(np.uint64)
    order = np.lexsort(keys.T) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    kind = np.empty(n, np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:start + size] for each pair."""
    out = np.zeros(len(starts), np.uint32)
    by_size = np.argsort(sizes, kind="stable")
    ends = np.flatnonzero(np.diff(sizes[by_size], append=-1)) + 1
    low = 0
    for high in ends.tolist():
        here = by_size[low:high]
        size, low = int(sizes[here[0]]), high
        rows = data[starts[here][:, None] + np.arange(size)]
        one, kind = _distinct(rows)
        out[here] = crc_rows(rows[one])[kind]
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _features(piece: Piece, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and text number (in the piece) of every feature, and each text's number of words."""
    inside = np.zeros(len(piece.data) + 2, bool)
    inside[1:-1] = _WORD[piece.data]
    begin, finish = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = piece.offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(piece.data))]          # a word ends with its text
    begin[cut] |= inside[1:-1][cut]
    finish[cut - 1] |= inside[1:-1][cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.searchsorted(starts, piece.offsets)
    words = np.diff(first)
    text = np.repeat(np.arange(len(words)), words)
    # Words one after another, a space between them: a run of words is a slice.
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    joined[_spread(at, sizes)] = _LOWER[piece.data[_spread(starts, sizes)]]
    codes, owners = [], []
    for k in range(1, runs + 1):
        head = np.flatnonzero(text[k - 1:] == text[:len(text) - k + 1]) if len(text) >= k else np.zeros(0, np.int64)
        tail = head + k - 1
        codes.append(crcs(joined, at[head], at[tail] + sizes[tail] - at[head]))
        owners.append(text[head])
    return np.concatenate(codes), np.concatenate(owners), words


def bucket_counts(texts: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of all texts' features in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                total += np.bincount(_features(piece, runs)[0] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed share in the target / smoothed share in the corpus)) of each bucket."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, runs: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                code, text, words = _features(piece, runs)
                n = np.bincount(text, minlength=len(words))
                total = np.zeros(len(words), np.int64)
                np.add.at(total, text, gain[code % len(gain)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(piece.rows.start, len(words)), pa.array(words.astype(np.int64)),
                     pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))],
                    ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text") \
        .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, runs: int = 1, buckets: int = BUCKETS, seed: int = 2024,
             least_words: int = 20) -> DataFrame:
    """Every document's n_features, weight, score, and its rank in the draw (null if not drawn).

    ``percent`` of the documents of at least ``least_words`` words are drawn.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weights(docs, gain, runs).withColumn("score", F.col("weight") + noise) \
        .withColumn("able", F.col("n_words") >= least_words)
    ordered = scored.select("*", (~F.col("able")).alias("o1"), (-F.col("score")).alias("o2"), F.col("doc_id").isNull().alias("o3"),
                            F.col("doc_id").alias("o4"), F.col("n_features").alias("o5"),
                            F.monotonically_increasing_id().alias("o6"))     # equal rows may be split over partitions
    numbered = number_within(ordered, [], ["o1", "o2", "o3", "o4", "o5", "o6"], out="place")
    drawn = percent * numbered.where("able").count() // 100
    return numbered.select("doc_id", "n_features", "weight", "score",
                           F.when(F.col("able") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
