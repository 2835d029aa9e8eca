"""Keyed lookups and merges.

Joins are left un-hinted where both sides can grow (AQE turns a shuffle join into a
broadcast join only after measuring the materialised side); dimension tables of a
fixed, known size are broadcast explicitly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.urls import ad_id_from_url, slug_from_url, url_key
from jobtide.schema import DETAIL_FIELDS
from jobtide.session import broadcast_if_small


def with_url_key(df: DataFrame, url: str = "url", out: str = "url_key") -> DataFrame:
    return df.withColumn(out, url_key(url))


def valid_cache(cache: DataFrame) -> DataFrame:
    """Cache entries usable as hits: non-empty description."""
    return cache.where(F.coalesce(F.length(F.col("f.description")) > 0, F.lit(False)))


def cache_lookup(offers: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join on url_key; adds ``cache_hit`` and the struct ``hit_f``."""
    hits = valid_cache(cache).select("url_key", F.col("f").alias("hit_f"))
    keyed = offers.withColumn("_hk", spread_blank("url_key", offers.columns))
    return (keyed.join(hits.withColumnRenamed("url_key", "_hk"), "_hk", "left").drop("_hk")
                 .withColumn("cache_hit", F.col("hit_f").isNotNull()))


def spread_blank(key: str, columns: Sequence[str]) -> Column:
    """A join key in which blank and null keys, which match nothing, differ from row to row, so that they don't meet
    in one task."""
    k = F.col(key)
    return F.when(F.coalesce(k, F.lit("")) != "", k).otherwise(
        F.concat(F.lit("\x00"), F.xxhash64(*[F.col(c) for c in columns]).cast("string")))


def attach_responses(offers: DataFrame, details: DataFrame, source: str,
                     fields: Sequence[str] = ("status", "body", "error")) -> DataFrame:
    """D3 in a run: adds ``fields`` of the response that was landed for each offer; they are exchanged several times, so
    large ones are better joined afterwards by a number of the response.

    A response belongs to the offers whose detail id (of their url) is its own; of several, to each offer the one landed
    at the offer's position, else the first.  A response without an id of its own belongs to its position."""
    own = detail_id(source, "url")
    if source in ("justjoin", "rocketjobs"):        # the id is the address itself
        own = F.when(F.col("url").rlike("^https?://"), F.col("url"))
    got = F.struct(*fields)
    d = details.select("run_id", "source", "position", own.alias("_did"), got.alias("_got"))
    o = offers.withColumn("_did", F.nullif(own, F.lit("")))
    here = d.withColumnRenamed("_did", "_own").withColumnRenamed("_got", "_here") \
        .where(F.col("position").isNotNull())
    here = here.groupBy("run_id", "source", "position", "_own").agg(F.first("_here").alias("_here"))
    exact = here.groupBy("run_id", "source", "position").agg(F.collect_list(F.struct("_own", "_here")).alias("_at"))
    first = d.where(F.coalesce(F.col("_did"), F.lit("")) != "").groupBy("run_id", "source", "_did") \
        .agg(F.min_by("_got", F.struct(F.col("position").isNull(), "position")).alias("_first")).withColumnRenamed("_did", "_dk")
    o = o.join(exact, ["run_id", "source", "position"], "left").withColumn("_dk", spread_blank("_did", ["run_id", "source", "position"]))
    o = o.join(first, ["run_id", "source", "_dk"], "left")
    mine = F.get(F.filter("_at", lambda x: F.coalesce(x["_own"], F.lit("")) == F.coalesce(F.col("_did"), F.lit(""))), 0)["_here"]
    free = F.get(F.filter("_at", lambda x: F.coalesce(x["_own"], F.lit("")) == ""), 0)["_here"]
    return o.withColumn("_r", F.coalesce(mine, free, F.col("_first"))).withColumns(
        {c: F.col("_r")[c] for c in fields}).drop("_did", "_dk", "_at", "_first", "_r")


def needs_detail(offers: DataFrame, cache: DataFrame) -> DataFrame:
    """Offers with a url and no usable cache entry (the fetch work list)."""
    return (offers.where(F.coalesce(F.col("url_key") != "", F.lit(False)))
                  .join(valid_cache(cache).select("url_key"), "url_key", "left_anti"))


def detail_id(source: str, url) -> Column:
    """D3 id per source: url (API sources), '/job/<slug>' lower-cased (nofluffjobs),
    what follows '/praca-i-staz/' (talentdays), numeric ad id of ≥ 6 digits (olx)."""
    if source == "nofluffjobs":
        return F.nullif(slug_from_url(url, "/job/"), F.lit(""))
    if source == "olx":
        return ad_id_from_url(url, 6)
    if source == "talentdays":
        after = F.split_part(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), F.lit("/praca-i-staz/"), F.lit(2))
        return F.nullif(F.regexp_replace(after, "/+$", ""), F.lit(""))
    return F.col(url) if isinstance(url, str) else url


# detail_error texts for rows without a detail id.
NO_ID_ERROR = {"nofluffjobs": "no slug in url", "talentdays": "no slug", "olx": "no ad id on card"}


def attach_detail(offers: DataFrame, details: DataFrame, source: str, id_col: str = "detail_id") -> DataFrame:
    """D3: left equi-join of detail responses by the source's id; rows without an id get
    the source's ``detail_error``."""
    o = offers.withColumn(id_col, detail_id(source, "url"))
    d = details.withColumnRenamed("url", "_detail_url")
    out = o.join(d, id_col, "left")
    msg = NO_ID_ERROR.get(source)
    if msg:
        out = out.withColumn("detail_error", F.when(F.col(id_col).isNull(), F.lit(msg)).otherwise(
            F.col("detail_error") if "detail_error" in o.columns else F.lit(None).cast("string")))
    return out


def merge_override(df: DataFrame, right: str, fields: Sequence[str] = DETAIL_FIELDS, when: Column | None = None) -> DataFrame:
    """Fields present in the right struct replace the left ones (explicit nulls included)
    where ``when`` holds (default: right struct not null)."""
    cond = when if when is not None else F.col(right).isNotNull()
    names = set(df.schema[right].dataType.fieldNames())
    for f in fields:
        if f not in names:
            continue
        if f in df.columns:
            df = df.withColumn(f, F.when(cond, F.col(f"{right}.{f}")).otherwise(F.col(f)))
        else:
            df = df.withColumn(f, F.when(cond, F.col(f"{right}.{f}")))
    return df


def merge_fill(df: DataFrame, right: str, fields: Sequence[str], group: Sequence[str] = (),
               group_guard: str | None = None) -> DataFrame:
    """Right-side values only where the left is null; ``group`` fields only when
    ``group_guard`` (a left column) is null as well."""
    df = df.withColumn("_guard", F.col(group_guard).isNull() if group_guard else F.lit(True))
    for f in fields:
        df = df.withColumn(f, F.coalesce(F.col(f), F.col(f"{right}.{f}")))
    for f in group:     # each field on its own: only null ones, only from present values
        df = df.withColumn(f, F.when(F.col("_guard"), F.coalesce(F.col(f), F.col(f"{right}.{f}"))).otherwise(F.col(f)))
    return df.drop("_guard")


def param(arr, keys: Sequence[str], field: str = "label") -> Column:
    """The entry of the first key in ``keys`` that is present (the first occurrence of
    a key wins; no map, duplicate keys would raise), then its ``field``.  A present key
    with an empty field does not fall through to the next key."""
    a = F.col(arr) if isinstance(arr, str) else arr

    def first_with(k):
        return F.get(F.filter(a, lambda p: p["key"] == F.lit(k)), 0)

    entry = F.coalesce(*[first_with(k) for k in keys])
    return entry[field] if field else entry


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, out: str,
           default: Column | None = None) -> DataFrame:
    """Left join to a dimension (broadcast if it is small) + coalesce to a default."""
    d = broadcast_if_small(dim.select(F.col(dim_key).alias("_lk"), F.col(value).alias("_lv")))
    j = df.join(d, df[key] == d["_lk"], "left")
    return j.withColumn(out, F.coalesce(F.col("_lv"), default if default is not None else F.col(key))) \
        .drop("_lk", "_lv")
