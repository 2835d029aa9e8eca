"""Description cache: TTL prune (D9), upsert (D8), in-file map form."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.schema import CACHE_FILE_MAP

TTL_DAYS = 60  # fixed value: cache time-to-live in days


def cache_prune(cache: DataFrame, now, days: int = TTL_DAYS, ts: str = "fetched_at") -> DataFrame:
    """Drop entries with no timestamp or older than now − days (equal survives)."""
    now_c = F.lit(now).cast("timestamp_ntz") if isinstance(now, (dt.datetime, str)) else now
    cutoff = now_c - F.expr(f"INTERVAL {days} DAYS")
    return cache.where(F.col(ts).isNotNull() & (F.col(ts) >= cutoff))


def cache_upsert(cache: DataFrame, new: DataFrame, key: str = "url_key", ts: str = "fetched_at",
                 desc: str = "description", tie: str | None = None, prefer_new: bool = True) -> DataFrame:
    """This run's successes (non-empty description) replace older entries; failures
    never enter; an untouched entry keeps its timestamp.  The new side always wins a key
    (latest write first); among old entries the newest wins.  ``prefer_new=False`` orders
    purely by event time (out-of-order streams).  Grouped ``max_by`` → partial aggregation per key."""
    good = new.where(F.coalesce(F.length(F.col(desc)) > 0, F.lit(False)))
    cols = cache.columns
    order = [F.col("_side"), F.col(ts)] if prefer_new else [F.col(ts), F.col("_side")]
    both = (cache.withColumn("_side", F.lit(0))
                 .unionByName(good.select(*cols).withColumn("_side", F.lit(1))))
    return (both.groupBy(key)
                .agg(F.max_by(F.struct(*[F.col(c) for c in cols]),
                              F.struct(*order, *([F.col(tie)] if tie else [])))
                     .alias("_w"))
                .select("_w.*"))


def cache_from_map_json(df: DataFrame, col: str = "json") -> DataFrame:
    """{key: {t: epoch ms, f: {...}}} documents → one row per key; missing or
    malformed documents yield no rows."""
    m = F.from_json(F.col(col), CACHE_FILE_MAP)
    return (df.select(F.explode(m).alias("url_key", "e"))
              .select("url_key", F.when(F.col("e.t") > 0, F.timestamp_millis(F.col("e.t"))).alias("fetched_at"),
                      F.col("e.f").alias("f")))
