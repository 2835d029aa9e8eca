"""Benchmark decontamination by winnowing (operator 8), native expressions only.

Of every window of ``WINDOW`` consecutive words the least hash of its ``GRAM``-word grams is kept as
the window's fingerprint.  A text's fingerprints change every few words only, and two texts that share
WINDOW words in a row must share that window's fingerprint, so no such span is missed.  Fingerprints of
documents are joined with those of the benchmark; each match is then extended to all the windows around
it, which are compared with the benchmark's windows by a 128-bit key.

An item of fewer than WINDOW words is one window of its own length; documents' windows of just those
lengths are compared directly, and only for the lengths that occur.

The benchmark's side is broadcast while its counted rows stay within MAX_BROADCAST, else shuffled.

Cases: null and empty texts have no words; an item without words is ignored; equal windows of several
items count for each item; rows equal in doc_id and text get equal results, rows of one doc_id with
different texts are judged apart; extra columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import ascii_lower, checkpointed, small

WINDOW = 10
GRAM = 5
MAX_BROADCAST = 1 << 18   # rows of the benchmark's side, under 100 bytes each
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD, -1), "")


def _steps(n: Column, span: int) -> Column:
    """Start positions of windows of ``span`` words, none where the text is shorter."""
    return F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))


def _key(wh: Column, i: Column, span: int) -> Column:
    """128-bit key of the ``span`` words at i."""
    return F.struct(F.xxhash64(*[F.get(wh, i + j) for j in range(span)]).alias("k1"),
                    F.xxhash64(F.lit(7), *[F.get(wh, i + j) for j in reversed(range(span))]).alias("k2"))


def _hashed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, wh (word hashes)."""
    return rows.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh"))


def _grams(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, wh, least: per window start the least gram hash of the window."""
    wh = F.col("wh")
    g = F.transform(_steps(F.size(wh), GRAM), lambda i: F.xxhash64(*[F.get(wh, i + j) for j in range(GRAM)]))
    rows = rows.select(*keep, "wh", g.alias("g"))
    least = F.transform(_steps(F.size("wh"), WINDOW),
                        lambda i: F.least(*[F.get(F.col("g"), i + j) for j in range(WINDOW - GRAM + 1)]))
    return rows.select(*keep, "wh", least.alias("least"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """k1, k2, len, least (null for short items), items: each distinct window once."""
    items = _grams(_hashed(benchmark.select("item_id", "text"), ["item_id"]), ["item_id"])
    wh, n = F.col("wh"), F.size("wh")
    key = _key(wh, F.col("at"), WINDOW)
    for span in range(1, WINDOW):
        key = F.when(n == span, _key(wh, F.lit(0), span)).otherwise(key)
    starts = F.when(n == 0, F.array().cast("array<int>")) \
        .when(n < WINDOW, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - WINDOW))
    long = items.select("item_id", "wh", "least", F.explode(starts).alias("at")) \
        .select("item_id", key.alias("k"), F.least(n, F.lit(WINDOW)).alias("len"),
                F.get("least", F.col("at")).alias("least"))
    return long.groupBy("k.k1", "k.k2", "len").agg(
        F.first("least").alias("least"), F.sort_array(F.collect_set("item_id")).alias("items"))


def _all_windows(span: int) -> Column:
    """pos and key of every window of ``span`` words."""
    return F.transform(_steps(F.size("wh"), span),
                       lambda i: F.struct(i.alias("pos"), _key(F.col("wh"), i, span).alias("k")))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, spans (sorted [pos, len] of hit windows), items (sorted item ids) of hit documents."""
    windows = checkpointed(benchmark_windows(benchmark))
    lens = {r["len"]: r["count"] for r in windows.groupBy("len").count().collect()}
    total = sum(lens.values())
    keyed = _hashed(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), ["doc_id", "th"])
    found = []
    if WINDOW in lens:
        prints = small(windows.where(F.col("len") == WINDOW).select(F.col("least").alias("p")).distinct(),
                       lens[WINDOW], MAX_BROADCAST)
        rows = _grams(keyed, ["doc_id", "th"])
        wh, least = F.col("wh"), F.col("least")
        # A run of windows with one fingerprint is one row that carries the words all of them cover.  One
        # gram lies in `same` windows; only words that recur at short distance make a longer run, whose
        # further windows get rows of their own.
        same = WINDOW - GRAM + 1
        starts = F.filter(_steps(F.size("wh"), WINDOW), lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1))
                          | (F.get(least, i) == F.get(least, i - same)))
        reach = 2 * WINDOW - GRAM
        runs = F.transform(starts, lambda i: F.struct(
            i.alias("at"), F.get(least, i).alias("p"), F.slice(wh, i + 1, reach).alias("near")))
        matched = rows.select("doc_id", "th", F.explode(runs).alias("r")).select("doc_id", "th", "r.*") \
            .join(prints, "p", "left_semi")
        near = F.col("near")
        around = F.transform(_steps(F.size(near), WINDOW), lambda j: F.struct(
            (F.col("at") + j).alias("pos"), _key(near, j, WINDOW).alias("k")))
        found.append(matched.select("doc_id", "th", F.explode(around).alias("w"), F.lit(WINDOW).alias("len")))
    for span in sorted(set(lens) - {WINDOW}):
        found.append(keyed.select("doc_id", "th", F.explode(_all_windows(span)).alias("w"), F.lit(span).alias("len")))
    if not found:
        found = [keyed.where(F.lit(False)).select(
            "doc_id", "th", F.struct(F.lit(0).alias("pos"), _key(F.col("wh"), F.lit(0), 1).alias("k")).alias("w"),
            F.lit(1).alias("len"))]
    spans = found[0]
    for f in found[1:]:
        spans = spans.unionByName(f)
    spans = spans.select("doc_id", "th", "len", F.col("w.pos").alias("pos"), F.col("w.k.k1").alias("k1"),
                         F.col("w.k.k2").alias("k2"))
    exact = spans.join(small(windows.select("k1", "k2", "len", "items"), total, MAX_BROADCAST), ["k1", "k2", "len"])
    return exact.groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def _covered(spans: Column) -> Column:
    """Number of positions that sorted [pos, len] spans cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["pos"] + s["len"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(acc["end"], s["pos"]))).alias("n")))["n"]


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every document."""
    found = hits(docs, benchmark).select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "spans", "items")
    every = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words(F.col("text"))).alias("n_words"))
    ids = F.array_sort(F.transform(F.coalesce(F.col("items"), F.array().cast("array<bigint>")),
                                   lambda x: x.cast("string")))
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long")
    return every.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left") \
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                F.size(ids).cast("long").alias("n_items"),
                F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                (n_hit > 0).alias("contaminated"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark window."""
    bad = checkpointed(hits(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    return docs.join(small(bad, bad.count(), 1 << 20), on, "left_anti")
