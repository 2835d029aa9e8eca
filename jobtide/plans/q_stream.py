"""Streaming queries (J1–J3): landed files derived from the driver tables are
processed with ``trigger(availableNow=True)`` and the sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide.plans import sqlx
from jobtide.plans.adapters import adapter
from jobtide.plans.q_core import RUN_DEDUP_SQL
from jobtide.plans.registry import query
from jobtide.schema import OFFER
from jobtide.session import scratch_path
from jobtide.streaming import pipeline as SP
from jobtide.streaming import ttl_cache as TC


def _collect_docs(spark, sf):
    """offers_ev as collect documents of at most 100 offers (bounded groups), with the position of their first one."""
    o = adapter(spark, sf, "offers_ev")
    offer = F.struct(*[(F.col(f.name) if f.name in o.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in OFFER.fields])
    return (o.groupBy("run_id", "source", F.floor(F.col("position") / 100).alias("chunk"))
             .agg(F.sort_array(F.collect_list(F.struct("position", offer.alias("o")))).alias("xs"))
             .select("run_id", "source", F.col("xs")[0]["position"].cast("bigint").alias("first"),
                     F.size("xs").cast("bigint").alias("count"), F.transform("xs", lambda x: x["o"]).alias("offers")))


@query("q_stream_collect", sql=f"""
SELECT run_id, source, {sqlx.url_key('url')} AS url_key, {sqlx.source_display('source')} AS source_name,
       {sqlx.salary_text('salary_from', 'salary_to', 'salary_currency')} AS salary,
       {sqlx.place_form('remote', 'city')} AS place_form
FROM {{{{offers_ev}}}}""")
def q_stream_collect(spark, sf):
    src, out, ck = (scratch_path(spark, n) for n in ("landing-collect", "stream-tracker", "ckpt-collect"))
    SP.land_json(_collect_docs(spark, sf), src)
    SP.stream_collect(spark, src, out, ck)
    return spark.read.parquet(out).select("run_id", "source", "url_key", "source_name", "salary", "place_form")


@query("q_stream_dedup", sql=f"""
SELECT DISTINCT run_id, {sqlx.url_key('url')} AS identity_key FROM {{{{offers_ev}}}} WHERE {sqlx.url_key('url')} <> ''""")
def q_stream_dedup(spark, sf):
    o = adapter(spark, sf, "offers_ev").select("run_id", "source", "position", "url",
                                              F.col("landed_at").cast("timestamp").alias("landed_at"))
    src, out, ck = (scratch_path(spark, n) for n in ("landing-offers", "stream-dedup", "ckpt-dedup"))
    SP.land_json(o, src)
    SP.stream_dedup(spark, src, o.schema, out, ck)
    return spark.read.parquet(out).select("run_id", "identity_key")


@query("q_stream_cache", sql="""
SELECT url_key, fetched_at, description FROM (
  SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY fetched_at DESC, event_id DESC) AS rn
  FROM {{cache_ev}} WHERE length(description) > 0) WHERE rn = 1""")
def q_stream_cache(spark, sf):
    c = adapter(spark, sf, "cache_ev").select("url_key", F.col("fetched_at").cast("timestamp").alias("fetched_at"),
                                              "event_id", "description")
    src, base, ck = (scratch_path(spark, n) for n in ("landing-cache", "stream-cache", "ckpt-cache"))
    SP.land_json(c, src)
    SP.stream_cache(spark, src, base, ck, ttl_days=60)
    cur = SP.latest_version(spark, base)
    return cur.select("url_key", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), "description")


@query("q_stream_tracker", sql=f"""
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY source, position) AS BIGINT) AS id,
       {sqlx.tracker_cols()}
FROM ({RUN_DEDUP_SQL})""")
def q_stream_tracker(spark, sf):
    """J1 with dedup and ids: the streamed tracker equals the batch tracker, ids included."""
    src, out, ck = (scratch_path(spark, n) for n in ("landing-tracked", "stream-ids", "ckpt-ids"))
    SP.land_json(_collect_docs(spark, sf), src)
    SP.stream_tracker(spark, src, out, ck)
    return SP.read_stream_tracker(spark, out)


TTL_DAYS = 1


@query("q_stream_ttl", sql=f"""
SELECT url_key, fetched_at, description FROM (
  SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY fetched_at DESC, event_id DESC) AS rn
  FROM {{{{cache_ev}}}} WHERE length(description) > 0)
WHERE rn = 1 AND fetched_at >= (SELECT max(fetched_at) FROM {{{{cache_ev}}}}) - INTERVAL {TTL_DAYS} DAY""")
def q_stream_ttl(spark, sf):
    """J3 as keyed state with timers, over several micro-batches, folded into a snapshot half way."""
    c = adapter(spark, sf, "cache_ev").select("url_key", F.col("fetched_at").cast("timestamp").alias("fetched_at"),
                                              "event_id", "description")
    src, base, ck = (scratch_path(spark, n) for n in ("landing-ttl", "stream-ttl", "ckpt-ttl"))
    for part in range(2):
        SP.land_json(c.where(F.col("event_id") % 2 == part), f"{src}/{part}")
        TC.stream_ttl_cache(spark, f"{src}/*", base, ck, TTL_DAYS, timestamp_format=SP.TS_FORMAT)
        if not part:
            TC.compact(spark, base)
    return TC.current(spark, base).select("url_key", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), "description")
