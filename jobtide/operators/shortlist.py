"""Table-driven shortlist (L1–L5) and history-aware joins.

Rules, weights and CV variants are small configuration tables; the offers and the
tracker history are the large sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tracker statuses meaning "already applied".
APPLIED_STATUSES = ["Wysłane", "Brak odpowiedzi", "Odpowiedź - kontakt", "Rozmowa zaplanowana", "Po rozmowie",
                    "Oferta!", "Odmowa", "Wycofałem się"]


def exclude(offers: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """L1: drop offers where any (column, pattern) rule matches (lower-cased text)."""
    pred = F.lit(False)
    for col, pat in rules:
        pred = pred | F.coalesce(F.lower(F.col(col)).rlike(pat), F.lit(False))
    return offers.where(~pred)


def exclude_applied(offers: DataFrame, tracker: DataFrame, key: str = "identity_key",
                    tracker_key: str = "url_key", statuses: Sequence[str] = APPLIED_STATUSES) -> DataFrame:
    """Anti-join against every applied row anywhere in the history."""
    applied = tracker.where(F.col("status").isin(list(statuses))).select(F.col(tracker_key).alias("_ak")).distinct()
    return offers.join(applied, offers[key] == applied["_ak"], "left_anti")


def score(offers: DataFrame, weights: Sequence[tuple[str, float]], text_cols: Sequence[str],
          out: str = "fit_score") -> DataFrame:
    """L3: sum of weight × (pattern matches the joined text).  ``weights`` is the profile's
    (pattern, weight) configuration; each rule becomes one native column expression, so
    scoring is a single projection over the offers (no join, no Python per row)."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols]))
    total = F.lit(0.0)
    for pattern, weight in weights:
        total = total + F.when(text.rlike(pattern), F.lit(float(weight))).otherwise(F.lit(0.0))
    return offers.withColumn(out, total)


def pick_variant(offers: DataFrame, variants: Sequence[tuple[str, Sequence[str]]], text_cols: Sequence[str]) -> DataFrame:
    """L4: per offer the CV variant with the highest keyword score; ties go to the
    alphabetically first name.  Variants are a handful of configuration entries, each
    scored as a native column (no cross join against the offers)."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols]))
    scored = []
    for name, keywords in sorted(variants):
        s = F.lit(0)
        for kw in keywords:
            s = s + F.when(text.contains(kw), F.lit(1)).otherwise(F.lit(0))
        scored.append(F.struct(s.alias("score"), F.lit(name).alias("name")))
    best = F.reduce(F.array(*scored), F.get(F.array(*scored), 0),
                    lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc))
    return offers.withColumn("_best", best).withColumn("cv_variant", F.col("_best.name")) \
        .withColumn("variant_score", F.col("_best.score").cast("bigint")).drop("_best")


def join_back(tracker: DataFrame, result: DataFrame, key: str = "url_key") -> DataFrame:
    """1:1 join of shortlist results to tracker rows; ``dup_left`` / ``dup_right``
    report keys that are not unique on a side (the join must not fan out silently).  Where a repeated key
    must fail the run, ``sinks.observed.unique_join`` joins in one pass."""
    lc = tracker.groupBy(key).agg(F.count(F.lit(1)).alias("_nl"))
    rc = result.groupBy(key).agg(F.count(F.lit(1)).alias("_nr"))
    j = tracker.join(result, key, "inner").join(lc, key).join(rc, key)
    return j.withColumn("dup_left", F.col("_nl") > 1).withColumn("dup_right", F.col("_nr") > 1).drop("_nl", "_nr")
