"""Incremental (Structured Streaming) forms of the accumulation jobs.

* J1 ``stream_collect``: newly landed collect documents → offers → tracker columns,
  written per micro-batch with ``foreachBatch`` into ``batch_id=<n>`` partitions (a
  replayed batch overwrites its own partition: idempotent).  ``stream_tracker``: the same with
  within-run dedup and running ids: the 13-column tracker.
* J2 ``stream_dedup``: identity-key dedup, first arrival kept.  The kept keys lie in partitions by run and
  key bucket; a micro-batch reads those of its own keys.
* J3 ``stream_cache``: cache upsert and prune by key buckets; ``streaming.ttl_cache`` keeps the cache as
  keyed state with timers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions.tracker import place_form, source_display, to_tracker
from jobtide.functions.salary import salary_text
from jobtide.functions.urls import identity_key, url_key
from jobtide.operators.cache import cache_prune, cache_upsert
from jobtide.operators.dedup import dedup_first
from jobtide.operators.numbering import number_within
from jobtide.schema import COLLECT_FILE, TRACKER_COLUMNS
from jobtide.session import cut_lineage
from jobtide.sources.landing import explode_collect, read_or_empty


TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def land_json(df: DataFrame, path: str, files: int | None = None) -> str:
    """Write rows as JSON-lines files (a landing folder for a file stream); ``files`` deals them anew."""
    df = df.repartition(files) if files else df
    df.write.mode("overwrite").option("timestampFormat", TS_FORMAT).json(path)
    return path


def _run(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _stream(spark: SparkSession, schema: T.StructType, files_per_trigger: int | None):
    r = spark.readStream.schema(schema)
    return r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r


def stream_collect(spark: SparkSession, src: str, out: str, checkpoint: str, files_per_trigger: int | None = None) -> None:
    """Collect documents (JSON lines) → exploded offers → tracker columns."""
    schema = T.StructType(COLLECT_FILE.fields + [T.StructField("run_id", T.StringType())])
    docs = _stream(spark, schema, files_per_trigger).json(src)
    offers = explode_collect(docs)
    rows = offers.select(
        "run_id", "source", "position", url_key("url").alias("url_key"),
        source_display(F.coalesce(F.col("_src"), F.col("source"))).alias("source_name"),
        salary_text("salary_from", "salary_to", "salary_currency").alias("salary"),
        place_form("remote", "city").alias("place_form"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _run(rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())


KEY_BUCKETS = 16        # partitions of a run's kept keys


def _key_bucket() -> Column:
    return F.pmod(F.xxhash64("identity_key"), F.lit(KEY_BUCKETS)).cast("int")


def _unseen(rows: DataFrame, kept: DataFrame, batch_id: int) -> DataFrame:
    """The rows (run_id, identity_key, …) whose key no earlier batch kept.

    ``kept`` is partitioned by run and key bucket; the batch's runs and buckets are collected (a batch's runs are few,
    and there are KEY_BUCKETS buckets) and become partition filters, so the other partitions are not even listed
    in the scan.  The batch's own rows from an earlier, failed attempt don't count."""
    rows = rows.withColumn("bucket", _key_bucket())
    touched = rows.select("run_id", "bucket").distinct().collect()
    mine = (F.col("run_id").isin(sorted({r["run_id"] for r in touched}))
            & F.col("bucket").isin(sorted({r["bucket"] for r in touched})) & (F.col("batch_id") != batch_id))
    old = kept.where(mine).select("run_id", "identity_key")
    return rows.join(old, ["run_id", "identity_key"], "left_anti").withColumn("batch_id", F.lit(batch_id).cast("bigint"))


def _keep(rows: DataFrame, path: str) -> None:
    """Write a batch's rows; a replayed batch replaces its own."""
    rows.repartition("run_id", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("run_id", "bucket", "batch_id").parquet(path)


_PLACE = [T.StructField("run_id", T.StringType()), T.StructField("bucket", T.IntegerType()),
          T.StructField("batch_id", T.LongType())]


def stream_dedup(spark: SparkSession, src: str, schema: T.StructType, out: str, checkpoint: str,
                 files_per_trigger: int | None = None) -> None:
    """Streaming within-run dedup on the identity key, first arrival kept.

    A micro-batch drops its own duplicates, then the keys its runs already hold, and appends the rest.  No
    watermark, so a row that comes late by any time is still judged."""
    s = _stream(spark, schema, files_per_trigger).option("timestampFormat", TS_FORMAT).json(src) \
        .withColumn("identity_key", identity_key("url", "source")).where(F.col("identity_key") != "")
    kept = T.StructType([T.StructField("identity_key", T.StringType()), T.StructField("source", T.StringType()),
                         T.StructField("position", schema["position"].dataType), *_PLACE])

    def sink(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("run_id", "identity_key").agg(
            F.min_by(F.struct("source", "position"), F.struct("landed_at", "source", "position")).alias("w")) \
            .select("run_id", "identity_key", "w.source", "w.position")
        _keep(_unseen(new, read_or_empty(batch.sparkSession, out, kept), batch_id), out)

    _run(s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())


_TRACKED = ["company", "title", "url", "city", "salary_from", "salary_to", "salary_currency", "remote", "_src"]
TRACKED_ROW = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in TRACKER_COLUMNS[1:]],
                            T.StructField("identity_key", T.StringType()), *_PLACE])
OFFSET = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("last_id", T.LongType()),
                       T.StructField("batch_id", T.LongType())])


def stream_tracker(spark: SparkSession, src: str, out: str, checkpoint: str, files_per_trigger: int | None = None) -> None:
    """Collect documents (JSON lines, with their run and the list position of their first offer) → 13-column
    tracker rows with dedup and ids.

    A micro-batch keeps the first offer of each identity key in (source, position) order, drops the keys that earlier
    batches of the run hold, and numbers the rest from the run's last id on.  Last ids lie in an offsets table, one row
    per run and batch; a batch takes those of earlier batches only, so a replayed batch gives the same ids and replaces
    its own rows and offsets."""
    schema = T.StructType([*COLLECT_FILE.fields, T.StructField("run_id", T.StringType()), T.StructField("first", T.LongType())])
    offers = explode_collect(_stream(spark, schema, files_per_trigger).json(src))
    name = F.coalesce(F.col("_src"), F.col("source"))
    rows = offers.select("run_id", name.alias("source"), (F.coalesce("first", F.lit(0)) + F.col("position")).alias("position"),
                         *_TRACKED, identity_key("url", name).alias("identity_key")).where(F.col("identity_key") != "")

    def sink(batch: DataFrame, batch_id: int) -> None:
        sp = batch.sparkSession
        new = dedup_first(batch, "identity_key", ["source", "position"], ["run_id"])
        fresh = _unseen(new, read_or_empty(sp, f"{out}/rows", TRACKED_ROW), batch_id)
        numbered = number_within(fresh, ["run_id"], ["source", "position", "identity_key"], "n")
        last = read_or_empty(sp, f"{out}/offsets", OFFSET).where(F.col("batch_id") < batch_id) \
            .groupBy("run_id").agg(F.max("last_id").alias("last_id"))
        placed = numbered.join(last, "run_id", "left").withColumn("id", F.col("n") + F.coalesce("last_id", F.lit(0)))
        placed = cut_lineage(placed.drop("n", "last_id"))       # rows and offsets agree
        _keep(to_tracker(placed, keep=("identity_key", "bucket", "batch_id")), f"{out}/rows")
        placed.groupBy("run_id").agg(F.max("id").alias("last_id")).write.mode("overwrite") \
            .parquet(f"{out}/offsets/batch_id={batch_id}")

    _run(rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_stream_tracker(spark: SparkSession, out: str) -> DataFrame:
    """run_id and the 13 columns of what ``stream_tracker`` has written."""
    return read_or_empty(spark, f"{out}/rows", TRACKED_ROW).select("run_id", "id", *TRACKER_COLUMNS[1:])


CACHE_ROW = T.StructType([T.StructField("url_key", T.StringType()), T.StructField("fetched_at", T.TimestampType()),
                          T.StructField("event_id", T.LongType()), T.StructField("description", T.StringType())])


N_BUCKETS = 64


def _bucket(key: str = "url_key"):
    return F.pmod(F.xxhash64(key), F.lit(N_BUCKETS)).cast("int")


POINTER = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType()),
                        T.StructField("newest", T.TimestampType())])
BUCKETED = T.StructType([*CACHE_ROW.fields, T.StructField("version", T.LongType()),
                         T.StructField("bucket", T.IntegerType())])


def _pointer(spark: SparkSession, base: str, upto: int | None = None) -> DataFrame:
    """The newest version of each bucket (at most N_BUCKETS rows per version)."""
    p = read_or_empty(spark, f"{base}/pointer", T.StructType([*POINTER.fields, T.StructField("v", T.LongType())]))
    if upto is not None:
        p = p.where(F.col("v") < upto)
    return p.groupBy("bucket").agg(F.max_by("version", "v").alias("version"), F.max_by("newest", "v").alias("newest"))


def stream_cache(spark: SparkSession, src: str, base: str, checkpoint: str, ttl_days: int = 60,
                 files_per_trigger: int | None = None) -> None:
    """Streaming cache upsert + TTL prune.

    The cache lies in N_BUCKETS key buckets.  A micro-batch reads and rewrites only the buckets
    its keys fall in, as new files under its own version, and then writes the pointer rows of
    those buckets; files that may be read are never overwritten and a replayed batch writes the
    same version again.  The TTL clock is event time (the newest fetch seen so far)."""
    s = _stream(spark, CACHE_ROW, files_per_trigger).option("timestampFormat", TS_FORMAT).json(src)

    def sink(batch: DataFrame, batch_id: int) -> None:
        sp = batch.sparkSession
        batch = batch.select(*CACHE_ROW.fieldNames()).withColumn("bucket", _bucket())
        newest = batch.groupBy("bucket").agg(F.max("fetched_at").alias("newest")).collect()    # ≤ N_BUCKETS rows
        if not newest:
            return
        point = {r["bucket"]: r for r in _pointer(sp, base, batch_id).collect()}               # ≤ N_BUCKETS rows
        touched = [r["bucket"] for r in newest]
        reads = [(b, point[b]["version"]) for b in touched if b in point]
        data = read_or_empty(sp, f"{base}/data", BUCKETED)
        old = data.where(F.struct("bucket", "version").isin([F.struct(F.lit(b), F.lit(v).cast("bigint")) for b, v in reads])
                         if reads else F.lit(False))
        merged = cache_upsert(old.select(*CACHE_ROW.fieldNames()), batch.select(*CACHE_ROW.fieldNames()),
                              tie="event_id", prefer_new=False)
        seen = {b: r["newest"] for b, r in point.items()}
        for r in newest:
            seen[r["bucket"]] = max(x for x in (r["newest"], seen.get(r["bucket"]), dt.datetime.min) if x is not None)
        now = max(seen.values())
        pruned = cache_prune(merged, F.lit(now).cast("timestamp"), ttl_days)
        pruned.withColumn("version", F.lit(batch_id).cast("bigint")).withColumn("bucket", _bucket()) \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("version", "bucket").parquet(f"{base}/data")
        sp.createDataFrame([(b, batch_id, seen[b]) for b in touched], POINTER).coalesce(1) \
            .write.mode("overwrite").parquet(f"{base}/pointer/v={batch_id}")

    _run(s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())


def latest_version(spark: SparkSession, base: str, ttl_days: int = 60) -> DataFrame:
    """The cache as of now: each bucket's newest version, entries beyond the TTL left out."""
    point = _pointer(spark, base)
    now = point.agg(F.max("newest")).first()[0]
    data = read_or_empty(spark, f"{base}/data", BUCKETED)
    live = data.join(F.broadcast(point.select("bucket", "version")), ["bucket", "version"])     # ≤ N_BUCKETS rows
    return cache_prune(live, F.lit(now).cast("timestamp"), ttl_days).select(*CACHE_ROW.fieldNames())
