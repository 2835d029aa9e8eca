"""Metrics taken in the pass that writes (B6, E2), and keys that must be unique.

``Observation`` metrics travel with the rows of the write, so a run's summary needs no second scan; a row that breaks a
condition fails the write itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from jobtide.functions.common import js_trim


def run_metrics(description: str = "description") -> dict[str, Column]:
    """E2 as metrics: rows, and rows whose description is a non-blank string."""
    return {"offers": F.count(F.lit(1)),
            "with_description": F.count(F.when(F.length(js_trim(F.col(description))) > 0, F.lit(1)))}


def write_observed(rows: DataFrame, write: Callable[[DataFrame], object], metrics: dict[str, Column]) -> dict:
    """Run ``write`` on the rows and return the metrics of exactly the rows it wrote."""
    seen = Observation()
    write(rows.observe(seen, *[c.alias(name) for name, c in metrics.items()]))
    return seen.get


def unique_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables whose key must be unique on both sides; a matched key that is not fails the job.

    Each side is exchanged once, by the key.  The right side is reduced to one row per key with a count before the
    join and the joined rows to one per left key with a count after it, on the same partitioning, so a repeated key
    arrives combined and can't fan out."""
    mine, theirs = [c for c in left.columns if c != key], [c for c in right.columns if c != key]
    r = right.groupBy(key).agg(F.first(F.struct(*[F.col(c) for c in theirs])).alias("_r"), F.count(F.lit(1)).alias("_nr"))
    j = left.select(key, F.struct(*[F.col(c) for c in mine]).alias("_l")).join(r, key) \
        .groupBy(key).agg(F.first("_l").alias("_l"), F.first("_r").alias("_r"), F.max("_nr").alias("_nr"),
                          F.count(F.lit(1)).alias("_nl"))
    said = F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string"))
    checked = F.when((F.col("_nl") > 1) | (F.col("_nr") > 1), F.raise_error(said).cast(j.schema["_l"].dataType)).otherwise(F.col("_l"))
    return j.select(key, checked.alias("_l"), "_r").select(
        key, *[F.col("_l")[c].alias(c) for c in mine], *[F.col("_r")[c].alias(c) for c in theirs])
