"""Description cache with a time-to-live, kept as keyed state with timers.

Every key's newest entry lies in the state store, with a timer at the time it stops being fresh.  The clock is event
time: an entry goes when a fetch has been seen that is more than the time-to-live later.  Only changes leave the
operator (a new entry, or that a key expired); a micro-batch appends them to the change log under its own number, so a
batch that is replayed replaces its own changes and a restart goes on from the checkpointed state.

Readers see the newest snapshot (``sinks.versions``) with the later changes applied.  ``compact`` folds the log into a
new snapshot and removes the changes and snapshots before it.

An entry older than the clock allows never enters.  A hot key's rows reach the processor as a stream, one at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from jobtide.sinks.versions import Versions
from jobtide.sources.landing import read_or_empty

ENTRY = T.StructType([T.StructField("url_key", T.StringType()), T.StructField("fetched_at", T.TimestampType()),
                      T.StructField("event_id", T.LongType()), T.StructField("description", T.StringType())])
CHANGE = T.StructType([*ENTRY.fields, T.StructField("expired", T.BooleanType()), T.StructField("batch_id", T.LongType())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "url_key string, at long, event_id long, description string, expired boolean"


def _processor() -> StatefulProcessor:
    """Defined here so that workers get it with the query and need no copy of the package."""
    from pyspark.sql import Row

    class NewestEntry(StatefulProcessor):
        """Newest entry of a key by (fetch time, event); a timer ends it."""

        def init(self, handle) -> None:
            self.handle = handle
            self.entry = handle.getValueState("entry", "at long, event_id long, description string")

        def handleInputRows(self, key, rows, timerValues):
            before = self.entry.get() if self.entry.exists() else None
            best = None if before is None else tuple(before)
            found = False
            for r in rows:
                if r.description and r.at is not None and (best is None or (r.at, r.event_id) > best[:2]):
                    best, found = (r.at, r.event_id, r.description), True
            if not found:
                return
            if before is not None:
                self.handle.deleteTimer(before[0] // 1000 + 1)
            self.entry.update(best)
            # The watermark lags by the time-to-live, so an entry is over when the watermark passes its fetch.
            self.handle.registerTimer(best[0] // 1000 + 1)
            yield Row(url_key=key[0], at=best[0], event_id=best[1], description=best[2], expired=False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.entry.clear()
            yield Row(url_key=key[0], at=None, event_id=None, description=None, expired=True)

        def close(self) -> None:
            pass

    return NewestEntry()


def changes(entries: DataFrame, ttl_days: int) -> DataFrame:
    """Stream of entries → stream of changes."""
    timed = entries.withWatermark("fetched_at", f"{ttl_days} days").select(
        "url_key", "fetched_at", F.unix_micros("fetched_at").alias("at"), "event_id", "description")
    out = timed.groupBy("url_key").transformWithState(_processor(), _OUT, "Update", "EventTime")
    return out.select("url_key", F.timestamp_micros("at").alias("fetched_at"), "event_id", "description", "expired")


def stream_ttl_cache(spark: SparkSession, src: str, base: str, checkpoint: str, ttl_days: int = 60,
                     files_per_trigger: int | None = None, timestamp_format: str | None = None) -> None:
    """Process what has landed under ``src`` (JSON lines) and append the changes to ``base``/changes."""
    reader = spark.readStream.schema(ENTRY)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/changes/batch_id={batch_id}")

    key = "spark.sql.streaming.stateStore.providerClass"        # states of many keys with timers need this store
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        q = changes(reader.json(src), ttl_days).writeStream.outputMode("update").foreachBatch(sink) \
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)


def _folded(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """Each key's last change; keys whose last change is an expiry are gone."""
    cols = [*ENTRY.fieldNames(), "expired"]
    every = snapshot.select("*", F.lit(False).alias("expired"), F.lit(-1).cast("bigint").alias("batch_id")).unionByName(log)
    # A batch may hold an expiry and a new entry of one key: timers run after the rows.
    last = every.groupBy(F.col("url_key").alias("_k")).agg(
        F.max_by(F.struct(*cols), F.struct("batch_id", "expired")).alias("x"))
    return last.select("x.*").where(~F.col("expired")).drop("expired")


def _log(spark: SparkSession, base: str, after: int) -> DataFrame:
    return read_or_empty(spark, f"{base}/changes", CHANGE).where(F.col("batch_id") > after)


def current(spark: SparkSession, base: str) -> DataFrame:
    """The cache as of the last micro-batch."""
    snapshots = Versions(spark, f"{base}/snapshots")
    return _folded(snapshots.read(schema=ENTRY), _log(spark, base, snapshots.note().get("batch_id", -1)))


def _batches(snapshots: Versions, base: str) -> dict[int, object]:
    """Folders of the change log whose batch was written whole, by number."""
    path = snapshots._path(f"{base}/changes")
    found = {}
    for s in snapshots._fs.listStatus(path) if snapshots._fs.exists(path) else ():
        name = s.getPath().getName()
        if name.startswith("batch_id=") and snapshots._fs.exists(snapshots._path(f"{base}/changes/{name}/_SUCCESS")):
            found[int(name.split("=")[1])] = s.getPath()
    return found


def compact(spark: SparkSession, base: str) -> int | None:
    """Fold the change log into a new snapshot, then remove what it covers.  A crash in between leaves changes that
    the snapshot covers; they are left out by number and removed next time."""
    snapshots = Versions(spark, f"{base}/snapshots")
    done, batches = snapshots.note().get("batch_id", -1), _batches(snapshots, base)
    upto = max(batches, default=-1)
    if upto > done:
        log = _log(spark, base, done).where(F.col("batch_id") <= upto)
        snapshots.commit(_folded(snapshots.read(schema=ENTRY), log), snapshots.current() or 0, {"batch_id": upto})
    snapshots.expire()
    for number, folder in batches.items():
        if number <= max(done, upto):
            snapshots._fs.delete(folder, True)
    return snapshots.current()
