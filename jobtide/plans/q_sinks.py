"""Sinks and runs end to end: what they write is read back and compared (A14, B1, B4–B7, C11, G2,
and the list and writer runs)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobtide.functions.urls import url_key
from jobtide.operators.mapping import drop_temp
from jobtide.plans import sqlx
from jobtide.plans.adapters import adapter
from jobtide.plans.registry import query
from jobtide.plans.run import run_list, run_writer
from jobtide.schema import OFFER, TRACKER, TRACKER_COLUMNS
from jobtide.session import scratch_path
from jobtide.sinks import export as SK
from jobtide.sinks.versions import VersionConflict, Versions
from jobtide.sources.landing import quarantine_payloads, read_tracker


def _position():
    return F.col("position").cast("bigint").alias("position")


@query("q_write_offers", sql="""
SELECT run_id, source, CAST(position AS BIGINT) AS position, url, title FROM {{offers_ev}}""")
def q_write_offers(spark, sf):
    """B1 + C11: one source of a run is written twice; the table holds it once, the others untouched."""
    out = scratch_path(spark, "offers")
    d = adapter(spark, sf, "offers_ev").select("run_id", "source", "position", "url", "title", F.lit(1).alias("_tmp"))
    SK.write_offers(d, out)
    SK.write_offers(d.where("source = 'view'"), out)
    back = spark.read.parquet(out)
    assert "_tmp" not in back.columns
    return back.select("run_id", "source", _position(), "url", "title")


@query("q_drop_temp", sql="""
SELECT CAST(position AS BIGINT) AS position, source AS _src FROM {{offers_ev}}""")
def q_drop_temp(spark, sf):
    """C11: temporary columns go, the writer's _src stays."""
    d = adapter(spark, sf, "offers_ev").select(_position(), F.col("source").alias("_src"), F.col("url").alias("_url"))
    return drop_temp(d)


@query("q_append_tracker", sql="""
SELECT run_tab, CAST(id AS BIGINT) AS id, company, title, url FROM {{tracker_or}}""")
def q_append_tracker(spark, sf):
    """B4 + A14: the history is appended, one tab twice, and read back whole."""
    out = scratch_path(spark, "tracker")
    d = adapter(spark, sf, "tracker_or")
    have = [f.name for f in TRACKER.fields if f.name in d.columns]
    d = d.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRACKER.fields])
    assert set(TRACKER_COLUMNS) <= set(d.columns)
    SK.append_tracker(d, out)
    SK.append_tracker(d.where("run_tab = '01.02.1996 10-00'"), out)
    return read_tracker(spark, out).select("run_tab", "id", "company", "title", "url")


@query("q_cache_version", sql="""
SELECT 'v2' AS version, event_id, url_key, description FROM {{cache_ev}} WHERE length(description) > 0
UNION ALL SELECT 'v1', event_id, url_key, description FROM {{cache_ev}} WHERE length(description) > 0 AND event_id % 2 = 0""")
def q_cache_version(spark, sf):
    """Two versions side by side; the earlier one is still readable."""
    out = scratch_path(spark, "cache-versions")
    c = adapter(spark, sf, "cache_ev").where(F.length("description") > 0).select("event_id", "url_key", "description")
    one = SK.write_cache_version(c.where("event_id % 2 = 0"), out, "v1")
    two = SK.write_cache_version(c, out, "v2")
    read = lambda p, v: spark.read.parquet(p).select(F.lit(v).alias("version"), "event_id", "url_key", "description")
    return read(one, "v1").unionByName(read(two, "v2"))


@query("q_cache_commit", sql="""
SELECT 'newest' AS version, event_id, url_key, description FROM {{cache_ev}} WHERE length(description) > 0
UNION ALL SELECT 'first', event_id, url_key, description FROM {{cache_ev}} WHERE length(description) > 0 AND event_id % 2 = 0""")
def q_cache_commit(spark, sf):
    """B5 by commits: a writer that dies before its manifest and one that loses the number leave no trace."""
    v = Versions(spark, scratch_path(spark, "cache-commits"))
    c = adapter(spark, sf, "cache_ev").where(F.length("description") > 0).select("event_id", "url_key", "description")
    first = v.commit(c.where("event_id % 2 = 0"))
    v.stage(c.where("event_id % 3 = 0"), first + 1)                 # dies here
    late = v.stage(c.where("event_id % 5 = 0"), first + 1)
    newest = v.commit(c, based_on=first)
    try:
        v.publish(first + 1, late, c.schema)
        raise AssertionError("two writers of one version")
    except VersionConflict:
        pass
    read = lambda n, name: v.read(n).select(F.lit(name).alias("version"), "event_id", "url_key", "description")
    assert v.current() == newest
    return read(None, "newest").unionByName(read(first, "first"))


@query("q_status_log", sql="""
SELECT run_id, source, CAST(count(*) AS BIGINT) AS count FROM {{offers_ev}} GROUP BY run_id, source""")
def q_status_log(spark, sf):
    """B6 + B7: status rows are appended by one sink although another one fails."""
    out = scratch_path(spark, "status")
    st = adapter(spark, sf, "offers_ev").groupBy("run_id", "source").agg(F.count(F.lit(1)).cast("bigint").alias("count"))

    def broken(df):
        raise ValueError("sink down")

    result = SK.run_sinks(st, {"broken": broken, "status": lambda d: SK.write_status(d, out)})
    assert result == {"broken": "failed: ValueError", "status": "ok"}
    return spark.read.parquet(out).select("run_id", "source", "count")


@query("q_run_list", sql=f"""
WITH i AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS item_pos, title, company,
                  CASE WHEN nullif(slug, '') IS NOT NULL THEN 'https://justjoin.it/job-offer/' || slug END AS url
           FROM {{{{turns_cv}}}}),
     u AS (SELECT *, row_number() OVER (PARTITION BY {sqlx.url_key('url')} ORDER BY conv_id, item_pos) AS rn
           FROM i WHERE url IS NOT NULL)
SELECT 'R1' AS run_id, 'justjoin' AS source, CAST(conv_id AS BIGINT) * 4294967296 + item_pos AS position,
       nullif(title, '') AS title, nullif(company, '') AS company, url FROM u WHERE rn = 1""")
def q_run_list(spark, sf):
    """The shipped list run over landed pages (one conversation is a page); nothing is capped."""
    t = adapter(spark, sf, "turns_cv")
    item = F.struct("title", "slug", F.col("company").alias("companyName"))
    pages = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", item.alias("x")))).alias("xs"))
    landing = pages.select(F.lit("R1").alias("run_id"), F.col("conv_id").alias("page_no"), F.col("conv_id").alias("position"),
                           F.to_json(F.struct(F.transform("xs", lambda s: s["x"]).alias("data"))).alias("payload"))
    return run_list(landing, "justjoin").select("run_id", "source", _position(), "title", "company", "url")


@query("q_run_writer", sql=f"""
WITH d AS (SELECT DISTINCT {sqlx.url_key('url')} AS url_key FROM {{{{offers_ev}}}} WHERE {sqlx.url_key('url')} <> '')
SELECT '01.05.2024 10-00 (2)' AS run_tab, url_key FROM d UNION ALL SELECT '01.05.2024 10-00', url_key FROM d""")
def q_run_writer(spark, sf):
    """The shipped writer run twice in one minute, the second run written twice: two tabs, each once."""
    o = adapter(spark, sf, "offers_ev").where(url_key("url") != "")
    offer = F.struct(*[(F.col(f.name) if f.name in o.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in OFFER.fields])
    src, out = scratch_path(spark, "collect"), scratch_path(spark, "writer")
    docs = o.groupBy("source", F.floor(F.col("position") / 5000).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("position", offer.alias("o")))).alias("xs"))
    docs.select("source", F.size("xs").alias("count"), F.transform("xs", lambda x: x["o"]).alias("offers")) \
        .write.option("maxRecordsPerFile", 1).json(src)
    for second in (1, 9, 9):
        run_writer(spark, src, dt.datetime(2024, 5, 1, 8, 0, second), out=out)
    return read_tracker(spark, f"{out}/tracker").select("run_tab", url_key("url").alias("url_key"))


@query("q_quarantine", sql="""
SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'no postings' WHEN 2 THEN 'not json' WHEN 3 THEN 'no payload'
               ELSE 'no postings' END AS reason FROM {{text_doc}} WHERE doc_id % 5 <> 0""")
def q_quarantine(spark, sf):
    """A1–A3: landed payloads that give no postings, with the reason."""
    d, k = adapter(spark, sf, "text_doc"), F.col("doc_id") % 5
    payload = (F.when(k == 0, F.to_json(F.struct(F.array(F.struct("text")).alias("postings"))))
               .when(k == 1, F.to_json(F.struct(F.struct("text").alias("elsewhere"))))
               .when(k == 2, F.concat(F.lit("{"), "text")).when(k == 4, F.lit('{"postings": []}')))
    return quarantine_payloads(d.select("doc_id", payload.alias("payload")))
