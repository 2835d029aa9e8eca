"""Pasted filter URLs → predicate rows (C6) and applying them to offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.session import broadcast_if_small

# Query-string key aliases → filter field, in priority order per field.
KEY_ALIASES = {
    "employment_type": ["employment-types", "employment-type", "typ-umowy"],
    "experience": ["experience-level", "experience-levels", "doswiadczenie"],
}
ALIAS_RANK = {k: (field, i) for field, keys in KEY_ALIASES.items() for i, k in enumerate(keys)}


def query_pairs(df: DataFrame, url: str = "url") -> DataFrame:
    """Query-string pairs of the text between the first and second '?': split on '&', cut
    at the first '=' (pairs with '=' at index ≤ 0 dropped), percent-decode the value
    (malformed escapes → pair dropped).  '+' is kept literally."""
    q = F.split_part(F.coalesce(F.col(url), F.lit("")), F.lit("?"), F.lit(2))
    keep = [c for c in df.columns]
    p = df.select(*keep, F.posexplode(F.split(q, "&")).alias("pair_pos", "kv"))
    eq = F.instr(F.col("kv"), "=")
    p = p.where(eq > 1).select(*keep, "pair_pos", F.substring(F.col("kv"), 1, eq - 1).alias("key"),
                               F.try_url_decode(F.replace(F.col("kv").substr(eq + 1, F.lit(1 << 30)), F.lit("+"),
                                                          F.lit("%2B"))).alias("value"))
    return p.where(F.col("value").isNotNull())


def filters_from_url(cfg: DataFrame, id_cols=("source",), url: str = "url") -> DataFrame:
    """(id, field, value) rows.  Last duplicate key wins; among aliases of one field the
    highest-priority non-empty key wins; comma lists explode; the last path segment
    becomes a ``city`` row."""
    pairs = query_pairs(cfg.select(*id_cols, url), url)
    alias = F.create_map(*[x for k, (f, r) in ALIAS_RANK.items() for x in (F.lit(k), F.struct(F.lit(f), F.lit(r)))])
    a = F.try_element_at(alias, F.col("key"))
    pairs = pairs.withColumn("field", F.coalesce(a["col1"], F.col("key"))) \
                 .withColumn("rank", F.coalesce(a["col2"], F.lit(0)))
    last = pairs.groupBy(*id_cols, "field", "key", "rank").agg(F.max_by("value", "pair_pos").alias("value"))
    best = (last.where(F.col("value") != "").groupBy(*id_cols, "field")
            .agg(F.min_by("value", "rank").alias("value")))
    rows = best.select(*id_cols, "field", F.posexplode(F.split("value", ",")).alias("idx", "value"))
    path = F.regexp_replace(F.split_part(F.split_part(F.coalesce(F.col(url), F.lit("")), F.lit("?"), F.lit(1)),
                                         F.lit("#"), F.lit(1)), "/+$", "")
    seg = F.regexp_extract(path, r"^[a-zA-Z]+://[^/]+/(?:.*/)?([^/]+)$", 1)
    city = cfg.select(*id_cols, F.lit("city").alias("field"), F.lit(0).alias("idx"),
                      F.try_url_decode(seg).alias("value")).where(F.coalesce(F.col("value") != "", F.lit(False)))
    return rows.unionByName(city)


# Offer column each filter field constrains.
FIELD_COLUMN = {"city": "city", "employment_type": "contract_type", "experience": "experience_level"}


def _norm(field: str, c):
    # Cities are compared as slugs: a URL says 'wroclaw' where the offer says 'Wrocław'.
    from jobtide.functions.text import slug
    return slug(c, "dash") if field == "city" else F.lower(c)


def apply_filters(offers: DataFrame, filters: DataFrame, key: str = "source") -> DataFrame:
    """Per field, an offer passes when its source has no filter rows for the field or
    its value equals one of them (case-insensitive; cities as slugs).  The filter rows
    (configuration: a handful per source) are folded into one row per source holding a
    value set per field, broadcast if they are few, and checked with one join and native array tests."""
    sets = filters.groupBy(F.col(key).alias("_fk")).agg(*[
        F.collect_set(F.when(F.col("field") == field, _norm(field, F.col("value")))).alias(f"_f_{field}")
        for field in FIELD_COLUMN])
    j = offers.join(broadcast_if_small(sets), offers[key] == sets["_fk"], "left")
    ok = F.lit(True)
    for field, col in FIELD_COLUMN.items():
        allowed = F.col(f"_f_{field}")
        ok = ok & (F.coalesce(F.size(allowed) == 0, F.lit(True))
                   | F.coalesce(F.array_contains(allowed, _norm(field, F.col(col))), F.lit(False)))
    return j.where(ok).drop("_fk", *[f"_f_{field}" for field in FIELD_COLUMN])


# Sources whose list API takes employment-type and city filters by default.
DEFAULT_FILTER_SOURCES = ["justjoin", "rocketjobs"]
DEFAULT_CATEGORY = "internship"
DEFAULT_LOCATION = "Wrocław"


def config_filters(cfg: DataFrame, sources=DEFAULT_FILTER_SOURCES) -> DataFrame:
    """A15 + C6/C7 defaults: filter rows for a run.  Pasted URLs in ``urls`` (non-empty)
    give override rows; for the default sources every (source, field) without an override
    falls back to the configured category (else 'internship') and location (else
    'Wrocław').  The configuration is a one-row table, so everything here is tiny."""
    pasted = (cfg.select(F.explode("urls").alias("source", "url"))
              .where(F.length(F.trim(F.coalesce(F.col("url"), F.lit("")))) > 0))
    over = filters_from_url(pasted)
    cat = F.coalesce(F.nullif(F.trim(F.col("category")), F.lit("")), F.lit(DEFAULT_CATEGORY))
    loc = F.coalesce(F.nullif(F.trim(F.col("location")), F.lit("")), F.lit(DEFAULT_LOCATION))
    srcs = F.array(*[F.lit(s) for s in sources])
    defaults = cfg.select(F.explode(srcs).alias("source"), cat.alias("employment_type"), loc.alias("city")).select(
        "source", F.expr("stack(2, 'employment_type', employment_type, 'city', city) AS (field, value)"),
        F.lit(0).alias("idx"))
    missing = defaults.join(over.select("source", "field").distinct(), ["source", "field"], "left_anti")
    return over.unionByName(missing.select("source", "field", "idx", "value"))
