"""Scans of landed payloads.

Landed list pages live in ``landing_list(run_id, source, page_no, position, payload)``
and detail responses in ``landing_detail``; collect files are JSON documents
``{source, count, offers[]}``.  Everything is parsed with explicit schemas
(``from_json``) or as VARIANT for payloads whose array sits at an unknown path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions.classify import keep_labels
from jobtide.functions.variant_search import find_postings
from jobtide.schema import COLLECT_FILE, DESC_CACHE, TRACKER

S, D, B = T.StringType(), T.DoubleType(), T.BooleanType()

BOARD_ITEM = T.StructType([
    T.StructField("companyName", S), T.StructField("title", S), T.StructField("slug", S), T.StructField("city", S),
    T.StructField("multilocation", T.ArrayType(T.StructType([T.StructField("city", S)]))),
    T.StructField("employmentTypes", T.ArrayType(T.StructType([
        T.StructField("from", D), T.StructField("to", D), T.StructField("currency", S), T.StructField("type", S)]))),
    T.StructField("experienceLevel", S), T.StructField("publishedAt", S), T.StructField("workplaceType", S),
])
BOARD_ENVELOPE = T.StructType([T.StructField("data", T.ArrayType(BOARD_ITEM)),
                               T.StructField("meta", T.MapType(S, S))])

TALENTDAYS_ITEM = T.StructType([
    T.StructField("employer", T.StructType([T.StructField("name", S)])), T.StructField("position", S),
    T.StructField("slug", S), T.StructField("city", T.StructType([T.StructField("name", S)])),
    T.StructField("wages", T.StructType([T.StructField("min", D), T.StructField("max", D), T.StructField("currency", S)])),
    T.StructField("jobType", S), T.StructField("experience", S), T.StructField("workplace", T.ArrayType(S)),
])

CARD_SCHEMAS = {
    "olx": T.StructType([T.StructField(n, S) for n in ("id", "title", "url", "city", "dateText", "salaryRaw")]),
    "pracuj": T.StructType([T.StructField(n, S) for n in ("title", "company", "city", "url", "salaryText")]
                           + [T.StructField("labels", T.ArrayType(S)), T.StructField("published_at", S)]),
    "theprotocol": T.StructType([T.StructField(n, S) for n in (
        "href", "title", "company", "cityRaw", "salaryRaw", "levelRaw", "workModeRaw", "contractRaw", "dateRaw")]),
    "indeed": T.StructType([T.StructField(n, S) for n in (
        "title", "jk", "href", "company", "loc", "salaryText", "metaText", "publishedAt", "cardText")]),
}

# Candidate paths of item arrays in enveloped payloads (A4), searched in this order.
ITEM_PATHS = ["$.json.data", "$.json.items", "$.result.data", "$.data", "$.items"]


# ---------------------------------------------------------------- A1 collect files

def explode_collect(docs: DataFrame) -> DataFrame:
    """Flatten collect documents: skip documents without an ``offers`` array, keep list
    order as ``position`` and tag ``_src = offer.source ?? document.source``."""
    d = docs.where(F.col("offers").isNotNull())
    keep = [c for c in d.columns if c not in ("offers", "source", "count")]
    x = d.select(*keep, F.col("source").alias("_file_source"), F.posexplode("offers").alias("position", "o"))
    return x.select(*keep, "position", "o.*", F.coalesce(F.nullif(F.col("o.source"), F.lit("")),
                                                        F.col("_file_source")).alias("_src"))


def _documents(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Collect documents with their file and, for what is not JSON, the raw text in ``_raw``."""
    schema = T.StructType([*COLLECT_FILE.fields, T.StructField("_raw", S)])
    return (spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_raw").option("pathGlobFilter", "*.json").json(path)
            .withColumn("_file", F.col("_metadata.file_path")))


def read_collect(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A1: every ``*.json`` collect file under ``path``; what yields no offers is reported by
    ``quarantine_files``."""
    return explode_collect(_documents(spark, path, multi_line).drop("_raw"))


def quarantine_files(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """file, reason of the collect documents that give no offers: not JSON, or no offers array."""
    reason = F.when(F.col("_raw").isNotNull(), F.lit("not json")).when(F.col("offers").isNull(), F.lit("no offers array"))
    return _documents(spark, path, multi_line).select(F.col("_file").alias("file"), reason.alias("reason")) \
        .where(F.col("reason").isNotNull())


def quarantine_payloads(landing: DataFrame, payload: str = "payload") -> DataFrame:
    """The landed rows (without payload) that ``ingest_postings`` gets nothing from, with the
    reason: no payload, not JSON, or no posting array anywhere."""
    col = F.col(payload)
    found = F.coalesce(F.size(find_postings(col)) > 0, F.lit(False))
    reason = (F.when(F.coalesce(F.trim(payload), F.lit("")) == "", F.lit("no payload"))
              .when(F.try_parse_json(col).isNull(), F.lit("not json")).when(~found, F.lit("no postings")))
    return landing.select(*[c for c in landing.columns if c != payload], reason.alias("reason")) \
        .where(F.col("reason").isNotNull())


# ---------------------------------------------------------------- A2–A4 list payloads

def ingest_board_api(landing: DataFrame, payload: str = "payload") -> DataFrame:
    """A2: ``{data, meta}`` envelope or bare array → one row per item (``item`` struct)."""
    env = F.from_json(F.col(payload), BOARD_ENVELOPE)
    bare = F.from_json(F.col(payload), T.ArrayType(BOARD_ITEM))
    items = F.coalesce(env["data"], bare)
    keep = [c for c in landing.columns if c != payload]
    return landing.select(*keep, F.posexplode(items).alias("item_pos", "item"))


def ingest_postings(landing: DataFrame, payload: str = "payload") -> DataFrame:
    """A3: one row per posting of the array found by walking the payload in breadth."""
    keep = [c for c in landing.columns if c != payload]
    return landing.select(*keep, F.posexplode(find_postings(F.col(payload))).alias("item_pos", "item"))


def ingest_items(landing: DataFrame, paths: Sequence[str] = ITEM_PATHS, payload: str = "payload") -> DataFrame:
    """A4: one row per item of the first non-empty array at a candidate path of the envelope."""
    v = F.try_parse_json(F.col(payload))
    arrays = [F.try_variant_get(v, p, "array<variant>") for p in paths]
    first = F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])
    keep = [c for c in landing.columns if c != payload]
    return landing.select(*keep, F.posexplode(first).alias("item_pos", "item"))


def ingest_cards(landing: DataFrame, source: str, payload: str = "payload") -> DataFrame:
    """Card rows ({...} per line) with the source's row requirement."""
    if payload in landing.columns:
        c = F.from_json(F.col(payload), CARD_SCHEMAS[source])
        keep = [x for x in landing.columns if x != payload]
        rows = landing.select(*keep, c.alias("_c")).select(*keep, "_c.*")
    else:
        rows = landing
    if source == "olx":
        return rows.where(F.coalesce(F.length(F.trim("title")) > 0, F.lit(False)))
    if source == "pracuj":
        return rows.where(F.coalesce(F.length(F.col("title")) > 0, F.lit(False))) \
            .withColumn("labels", keep_labels(F.coalesce(F.col("labels"), F.array().cast("array<string>"))))
    if source == "theprotocol":
        return rows.where(F.coalesce(F.length(F.col("href")) > 0, F.lit(False)))
    if source == "indeed":
        from jobtide.functions.urls import query_id
        rows = rows.withColumn("jk", F.coalesce(F.nullif(F.col("jk"), F.lit("")), query_id(F.col("href"), "jk")))
        return rows.where(F.coalesce(F.length(F.col("title")) > 0, F.lit(False)) | F.col("jk").isNotNull())
    return rows


# ---------------------------------------------------------------- A13–A15 state tables

def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at the path, or an empty one only if the path does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; a missing table is an empty cache, any other failure is raised."""
    return read_or_empty(spark, path, DESC_CACHE)


def read_tracker(spark: SparkSession, path: str, run_tabs: Sequence[str] | None = None) -> DataFrame:
    """Tracker history; ``run_tabs`` prunes partitions."""
    t = read_or_empty(spark, path, TRACKER)
    return t.where(F.col("run_tab").isin(list(run_tabs))) if run_tabs else t


RUN_CONFIG = T.StructType([
    T.StructField("keyword", S), T.StructField("category", S), T.StructField("location", S),
    T.StructField("radius", T.LongType()), T.StructField("urls", T.MapType(S, S)),
    T.StructField("collectDir", S), T.StructField("descCache", S),
])


def read_run_config(spark: SparkSession, path: str) -> DataFrame:
    """One-row run configuration (JSON document)."""
    return spark.read.schema(RUN_CONFIG).option("multiLine", True).json(path)
