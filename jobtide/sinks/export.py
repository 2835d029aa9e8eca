"""Sinks (B1–B7): partitioned offer writes, JSON export with manifest, latest view,
append-only tracker, cache versions, run status — each an independent action so a
failing sink never blocks another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.urls import url_key
from jobtide.operators.mapping import drop_temp
from jobtide.sinks.observed import run_metrics, write_observed


def write_offers(df: DataFrame, path: str) -> None:
    """B1: offers partitioned by (run_id, source); dynamic partition overwrite makes a
    re-run of one run idempotent without touching other runs."""
    drop_temp(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "source").parquet(path)


def export_records(df: DataFrame) -> DataFrame:
    """B2 records: one JSON line per offer with ``url_key``; the writer-internal ``_src``
    is not exported (it only decides the display name)."""
    rec = drop_temp(df.drop("_src")).withColumn("url_key", url_key("url"))
    cols = [c for c in rec.columns if c != "run_id"]
    return rec.select("run_id", F.to_json(F.struct(*cols)).alias("json"))


def export_full(df: DataFrame, path: str, run_tab: str, generated_at: str, seen: dict | None = None) -> DataFrame:
    """B2: JSON lines per run plus a manifest (run_tab, generated_at, count).
    The single-document envelope is never built: it would pass the whole run through
    one task.  The rows of one run are counted as they are written; ``seen`` gets these metrics (E2)."""
    # Records in (source, list position) order.  orderBy range-partitions the rows, so a
    # large run is sorted by many tasks, not gathered into one.
    order = [c for c in ("run_id", "source", "position") if c in df.columns]
    metrics = {**(run_metrics() if "description" in df.columns else {"offers": F.count(F.lit(1))}),
               "least": F.min("run_id"), "most": F.max("run_id")}
    # Observed behind the sort: the sort's sampling reads the rows before it, too.
    got = write_observed(df.orderBy(*order), lambda d: export_records(d).write.mode("overwrite").partitionBy("run_id")
                         .text(path + "/records"), metrics)
    if got["least"] == got["most"]:
        rows = [(got["most"], got["offers"])] if got["offers"] else []
        manifest = df.sparkSession.createDataFrame(rows, "run_id string, count bigint")
    else:
        manifest = df.groupBy("run_id").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    manifest = manifest.withColumn("run_tab", F.lit(run_tab)).withColumn("generated_at", F.lit(generated_at))
    manifest.write.mode("append").json(path + "/manifest")
    if seen is not None:
        seen.update(got)
    return manifest


def tab_time(tab) -> Column:
    """(time, run within the minute) of a tab name 'dd.MM.yyyy HH-mm' or '… (k)', which sort as time."""
    t = F.try_to_timestamp(F.substring(tab, 1, 16), F.lit("dd.MM.yyyy HH-mm"))
    k = F.coalesce(F.regexp_extract(tab, r" \((\d+)\)$", 1).try_cast("int"), F.lit(1))
    return F.struct(t.alias("t"), k.alias("k"))


def latest_rows(history: DataFrame, key: str = "run_tab") -> DataFrame:
    """Rows of the latest run by the time its tab names (not by the tab's text).  The
    maximum is a one-row global aggregate, joined back by equality (a one-row broadcast)."""
    named = history.where(tab_time(F.col(key))["t"].isNotNull())
    m = named.agg(F.max_by(F.col(key), tab_time(F.col(key))).alias("_latest"))
    return history.join(F.broadcast(m), history[key] == m["_latest"], "inner").drop("_latest")


def append_tracker(df: DataFrame, path: str) -> None:
    """This run's tracker rows under its own run_tab partition, in ID order.  Only that
    partition is replaced, so writing a run again does not double it; other runs stay."""
    out = df.orderBy("run_tab", "id") if "id" in df.columns else df
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_tab").parquet(path)


def write_cache_version(cache: DataFrame, base: str, version: str) -> str:
    """The merged cache goes to a new version folder; readers switch by pointer, so a
    path being read is never overwritten."""
    out = f"{base.rstrip('/')}/v={version}"
    cache.write.mode("errorifexists").parquet(out)
    return out


def write_status(status: DataFrame, path: str) -> None:
    """Append run status rows."""
    status.write.mode("append").partitionBy("run_id").parquet(path)


def run_sinks(df: DataFrame, sinks: dict) -> dict:
    """Fault isolation — every sink runs on the same persisted input; an exception in
    one is recorded and the others still run."""
    src = df.persist()
    result = {}
    try:
        for name, fn in sinks.items():
            try:
                fn(src)
                result[name] = "ok"
            except Exception as e:  # noqa: BLE001 - isolation is the point
                result[name] = f"failed: {type(e).__name__}"
    finally:
        src.unpersist()
    return result


def append_tracker_table(df: DataFrame, table: str, buckets: int = 256) -> None:
    """B4 for a catalog table: tracker rows appended per run_tab and bucketed (and sorted)
    by ``url_key``.  History only grows; bucketing lets the per-run anti-join against all
    applied history (D10) shuffle the new offers only, never the history."""
    out = df if "url_key" in df.columns else df.withColumn("url_key", url_key("url"))
    (out.write.mode("append").format("parquet").partitionBy("run_tab")
        .bucketBy(buckets, "url_key").sortBy("url_key").saveAsTable(table))
