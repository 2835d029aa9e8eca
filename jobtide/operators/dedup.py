"""First-wins de-duplication.

"First" is the smallest ordering key (e.g. ``(source, position)``).  The winner is
picked with ``min_by(struct(row), struct(order))`` grouped by the key, which Spark
plans as partial + final aggregation: a hot key (say a third of all rows) is
collapsed map-side before the shuffle instead of landing whole in one window task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.urls import identity_key, url_key


def dedup_first(df: DataFrame, key: Column | str, order: Sequence[str], partition: Sequence[str] = (),
                keep_null_keys: bool = False, drop_empty_keys: bool = True) -> DataFrame:
    """Keep the first row per ``partition + key``.

    Rows whose key is null are kept (each on its own) when ``keep_null_keys``; rows
    with an empty-string key are dropped when ``drop_empty_keys``.
    """
    cols = df.columns
    k = F.col(key) if isinstance(key, str) else key
    keyed = df.withColumn("_dk", k)
    valid = keyed.where(F.col("_dk").isNotNull() & ((F.col("_dk") != "") if drop_empty_keys else F.lit(True)))
    winners = (valid.groupBy(*partition, "_dk")
               .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order])).alias("_w"))
               .select("_w.*"))
    if keep_null_keys:
        winners = winners.unionByName(keyed.where(F.col("_dk").isNull()).drop("_dk"))
    return winners


def source_dedup_key(source: str) -> Column:
    """Within-source dedup key per source (null = no key, row kept):
    olx id‖url‖title; indeed jk‖url‖title; nofluffjobs url else 'title|company';
    pracuj / theprotocol exact url; the API sources have none."""
    if source == "olx":
        return F.coalesce(F.nullif(F.col("id"), F.lit("")), F.nullif(F.col("url"), F.lit("")),
                          F.nullif(F.col("title"), F.lit("")))
    if source == "indeed":
        return F.coalesce(F.nullif(F.col("jk"), F.lit("")), F.nullif(F.col("url"), F.lit("")),
                          F.nullif(F.col("title"), F.lit("")))
    if source == "nofluffjobs":
        return F.coalesce(F.nullif(F.col("url"), F.lit("")),
                          F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit("|"),
                                   F.coalesce(F.col("company"), F.lit(""))))
    if source in ("pracuj", "theprotocol"):
        return F.nullif(F.col("url"), F.lit(""))
    return F.lit(None).cast("string")


def dedup_source(df: DataFrame, key: Column | str | None = None, keep_null: bool = True) -> DataFrame:
    """within-source dedup per ``(run_id, source)``, first position wins."""
    if key is None:
        return df
    return dedup_first(df, key, ["position"], ["run_id", "source"], keep_null_keys=keep_null)


def dedup_run(df: DataFrame, identity: str = "identity_key") -> DataFrame:
    """within-run dedup across sources on the identity key; rows with an empty key are
    dropped; first in ``(source, position)`` wins.  ``identity='url_key'`` reproduces the
    original key exactly (every Indeed offer collapses to one)."""
    if identity == "url_key":
        k = url_key("url")
    else:
        k = identity_key("url", F.coalesce(F.col("_src"), F.col("source")) if "_src" in df.columns else F.col("source"))
    return dedup_first(df, k, ["source", "position"], ["run_id"])
