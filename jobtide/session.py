"""Session construction and shared-storage helpers.

The engine never chooses machine-local scratch space on a cluster: lineage is cut
with reliable checkpoints in the folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (local tests) do we
pick a private folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Session defaults the engine relies on (ANSI semantics, UTC session clock, AQE).
DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Checkpoint files of numbering / attempts tables are removed once no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "jobtide", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Pin the runtime SQL settings the engine's semantics depend on."""
    for k in ("spark.sql.ansi.enabled", "spark.sql.session.timeZone"):
        spark.conf.set(k, DEFAULT_CONF[k])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a private one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the "
                           "driver and all executors share")
    local = tempfile.mkdtemp(prefix="jobtide-ckpt-", dir=os.environ.get("JOBTIDE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for derived tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/jobtide-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint for a table that a caller passes in, after a look at its row count; a
    larger one is joined by shuffle, with the same result."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, scan_partitions: int, min_partitions: int | None = None) -> DataFrame:
    """Spread CPU-heavy per-row work when the input scans yield fewer splits than the
    cluster has cores (small or single-row-group files).  On large inputs the scans already
    have many more splits than cores and this is a no-op, so no shuffle is added at scale.
    ``scan_partitions`` comes from the raw file scans (planning only, nothing runs)."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if scan_partitions >= want:
        return df
    return df.repartition(want)
