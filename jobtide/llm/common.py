"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.session import ensure_checkpoint_dir, scratch_path

# ASCII white space of the word and line rules.
SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)) \
        .otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def two_hashes(*cols: Column) -> list[Column]:
    """A 128-bit key of the columns: two 64-bit hashes with different seeds."""
    return [F.xxhash64(F.lit(1), *cols).alias("k1"), F.xxhash64(F.lit(2), *cols).alias("k2")]


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names; rows are computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read them back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast hint for a table whose counted rows stay within the bound, else as it is."""
    return F.broadcast(df) if rows <= max_rows else df


_HELD: dict[str, dict] = {}     # a worker process serves many tasks


def held(owner: str, key: object, make: Callable[[], object]) -> object:
    """What tasks of one operator keep in their worker process; a worker that turns to another operator lets go of it
    first, so a worker holds one operator's memory at a time."""
    if owner not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
    mine = _HELD.setdefault(owner, {})
    if key not in mine:
        mine[key] = make()
    return mine[key]
