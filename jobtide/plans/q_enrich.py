"""Enrichment: cache TTL/upsert/lookup, detail attach, merges, params, dims,
and the positional detail-outcome rules (D1–D9, F4–F6, I16, E1)."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from jobtide.functions.classify import block_flag, block_mark
from jobtide.functions.urls import url_key
from jobtide.operators import cache as K
from jobtide.operators import enrich as EN
from jobtide.operators.outcomes import RULES, resolve_by_rules, resolve_outcomes, run_status
from jobtide.operators.positional import union_sources
from jobtide.plans import sqlx
from jobtide.plans.adapters import adapter
from jobtide.plans.registry import query
from jobtide.schema import SOURCE_NAMES, SOURCES

NOW = dt.datetime(2024, 1, 31)
TTL = 15


# ---------------------------------------------------------------- cache

@query("q_cache_ttl", sql=f"""
SELECT event_id, url_key, fetched_at FROM {{{{cache_ev}}}}
WHERE fetched_at IS NOT NULL AND fetched_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {TTL} DAY""")
def q_cache_ttl(spark, sf):
    c = adapter(spark, sf, "cache_ev")
    return K.cache_prune(c, NOW, TTL).select("event_id", "url_key", "fetched_at")


@query("q_cache_upsert", sql="""
SELECT url_key, event_id, fetched_at, description FROM (
  SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY side DESC, fetched_at DESC, event_id DESC) AS rn FROM (
    SELECT url_key, event_id, fetched_at, description, 0 AS side FROM {{cache_ev}} WHERE slice = 0
    UNION ALL
    SELECT url_key, event_id, fetched_at, description, 1 AS side FROM {{cache_ev}}
    WHERE slice = 1 AND length(description) > 0)) WHERE rn = 1""")
def q_cache_upsert(spark, sf):
    c = adapter(spark, sf, "cache_ev").select("url_key", "event_id", "fetched_at", "description", "slice")
    old = c.where("slice = 0").drop("slice")
    new = c.where("slice = 1").drop("slice")
    return K.cache_upsert(old, new, tie="event_id")


@query("q_cache_map_explode", sql="""
SELECT url_key || '#' || CAST(event_id AS VARCHAR) AS url_key,
       make_timestamp((epoch_us(fetched_at) // 1000) * 1000) AS fetched_at, description
FROM {{cache_ev}}""")
def q_cache_map_explode(spark, sf):
    c = adapter(spark, sf, "cache_ev")
    # Documents of at most 100 entries each, in the cache's JSON map form.
    entry = F.struct(F.unix_millis(F.col("fetched_at").cast("timestamp")).alias("t"),
                     F.struct(F.col("description").alias("description")).alias("f"))
    docs = (c.groupBy(F.floor(F.col("event_id") / 100).alias("doc"))
             .agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
                 F.concat(F.col("url_key"), F.lit("#"), F.col("event_id").cast("string")), entry)))).alias("json")))
    out = K.cache_from_map_json(docs)
    return out.select("url_key", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"),
                      F.col("f.description").alias("description"))


# ---------------------------------------------------------------- lookups and merges

def _doc_offers(spark, sf):
    d = adapter(spark, sf, "descr_doc").withColumn("url_key", url_key("url"))
    cache = (d.where("hit").select("url_key", F.lit(NOW).cast("timestamp").alias("fetched_at"), F.struct(
        F.when(F.col("quality") == 1, F.col("text")).otherwise(F.lit("")).alias("description"),
        F.when(F.col("toxic") == 0, F.lit("2024-12-31")).alias("valid_through")).alias("f")))
    return d, cache


_DOC_CACHE_SQL = f"""SELECT {sqlx.url_key('url')} AS url_key,
  CASE WHEN quality = 1 THEN text ELSE '' END AS description,
  CASE WHEN toxic = 0 THEN '2024-12-31' END AS valid_through FROM {{{{descr_doc}}}} WHERE hit"""


@query("q_cache_lookup", sql=f"""
SELECT CAST(d.position AS BIGINT) AS position, c.url_key IS NOT NULL AS cache_hit, c.description AS description
FROM {{{{descr_doc}}}} d LEFT JOIN ({_DOC_CACHE_SQL}) c
  ON {sqlx.url_key('d.url')} = c.url_key AND length(c.description) > 0""")
def q_cache_lookup(spark, sf):
    d, cache = _doc_offers(spark, sf)
    return EN.cache_lookup(d, cache).select(F.col("position").cast("bigint").alias("position"), "cache_hit",
                                            F.col("hit_f.description").alias("description"))


@query("q_needs_detail", sql=f"""
SELECT CAST(d.position AS BIGINT) AS position, {sqlx.url_key('d.url')} AS url_key FROM {{{{descr_doc}}}} d
WHERE {sqlx.url_key('d.url')} <> '' AND NOT EXISTS (
  SELECT 1 FROM ({_DOC_CACHE_SQL}) c WHERE c.url_key = {sqlx.url_key('d.url')} AND length(c.description) > 0)""")
def q_needs_detail(spark, sf):
    d, cache = _doc_offers(spark, sf)
    return EN.needs_detail(d, cache).select(F.col("position").cast("bigint").alias("position"), "url_key")


_NFJ_URL_SQL = ("CASE WHEN position % 5 = 0 THEN 'https://nofluffjobs.com/pl/' || lang "
                "ELSE 'https://nofluffjobs.com/pl/job/' || upper(source) || '-' || CAST(position AS VARCHAR) || '?x=1' END")


@query("q_attach_detail", sql=f"""
WITH o AS (SELECT position, {_NFJ_URL_SQL} AS url FROM {{{{descr_doc}}}}),
     k AS (SELECT position, url, nullif(lower(regexp_extract(url, '(?i)/job/([^/?#]+)', 1)), '') AS detail_id FROM o),
     d AS (SELECT lower(source) || '-' || CAST(position AS VARCHAR) AS detail_id, 200 AS status,
                  text AS body FROM {{{{descr_doc}}}} WHERE hit)
SELECT CAST(k.position AS BIGINT) AS position, k.detail_id, d.status, d.body,
       CASE WHEN k.detail_id IS NULL THEN 'no slug in url' END AS detail_error
FROM k LEFT JOIN d ON k.detail_id = d.detail_id""")
def q_attach_detail(spark, sf):
    base = adapter(spark, sf, "descr_doc")
    offers = base.select("position", F.when(F.col("position") % 5 == 0,
                                            F.concat(F.lit("https://nofluffjobs.com/pl/"), "lang"))
                         .otherwise(F.concat(F.lit("https://nofluffjobs.com/pl/job/"), F.upper("source"), F.lit("-"),
                                             F.col("position").cast("string"), F.lit("?x=1"))).alias("url"))
    details = base.where("hit").select(
        F.concat(F.lower("source"), F.lit("-"), F.col("position").cast("string")).alias("detail_id"),
        F.lit(200).alias("status"), F.col("text").alias("body"))
    out = EN.attach_detail(offers, details, "nofluffjobs")
    return out.select(F.col("position").cast("bigint").alias("position"), "detail_id", "status", "body", "detail_error")


@query("q_merge_override", sql="""
SELECT CAST(position AS BIGINT) AS position,
       CASE WHEN hit THEN CASE WHEN quality = 1 THEN text END ELSE lang END AS description,
       CASE WHEN hit THEN CASE WHEN toxic = 0 THEN '2024-12-31' END END AS valid_through
FROM {{descr_doc}}""")
def q_merge_override(spark, sf):
    d = adapter(spark, sf, "descr_doc").withColumn("description", F.col("lang"))
    d = d.withColumn("f", F.when(F.col("hit"), F.struct(
        F.when(F.col("quality") == 1, F.col("text")).alias("description"),
        F.when(F.col("toxic") == 0, F.lit("2024-12-31")).alias("valid_through"))))
    return EN.merge_override(d, "f").select(F.col("position").cast("bigint").alias("position"), "description",
                                            "valid_through")


@query("q_merge_fill", sql="""
WITH l AS (SELECT position, hit, source, lang,
             CASE WHEN position % 4 = 0 THEN NULL ELSE 'L' || source END AS company,
             CASE WHEN position % 3 = 0 THEN NULL ELSE CAST(position AS DOUBLE) END AS salary_from,
             CASE WHEN position % 3 = 1 THEN NULL ELSE CAST(position * 2 AS DOUBLE) END AS salary_to,
             CASE WHEN position % 2 = 0 THEN 'PLN' END AS salary_currency,
             CASE WHEN position % 6 = 0 THEN 'B2B' END AS contract_type,
             CAST(NULL AS VARCHAR) AS experience_level
           FROM {{descr_doc}})
SELECT CAST(position AS BIGINT) AS position,
       coalesce(company, CASE WHEN hit THEN 'Acme ' || source END) AS company,
       coalesce(contract_type, CASE WHEN hit THEN lang END) AS contract_type,
       coalesce(experience_level, CASE WHEN hit THEN 'junior' END) AS experience_level,
       CASE WHEN salary_from IS NULL THEN CASE WHEN hit THEN 5000.0 END ELSE salary_from END AS salary_from,
       CASE WHEN salary_from IS NULL AND salary_to IS NULL AND hit THEN 7000.0 ELSE salary_to END AS salary_to,
       CASE WHEN salary_from IS NULL AND salary_currency IS NULL AND hit THEN 'PLN' ELSE salary_currency END
         AS salary_currency
FROM l""")
def q_merge_fill(spark, sf):
    p = F.col("position")
    d = adapter(spark, sf, "descr_doc").select(
        "position", "hit", "source", "lang",
        F.when(p % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("L"), "source")).alias("company"),
        F.when(p % 3 == 0, F.lit(None)).otherwise(p.cast("double")).alias("salary_from"),
        F.when(p % 3 == 1, F.lit(None)).otherwise((p * 2).cast("double")).alias("salary_to"),
        F.when(p % 2 == 0, F.lit("PLN")).alias("salary_currency"),
        F.when(p % 6 == 0, F.lit("B2B")).alias("contract_type"),
        F.lit(None).cast("string").alias("experience_level"))
    d = d.withColumn("det", F.when(F.col("hit"), F.struct(
        F.concat(F.lit("Acme "), "source").alias("company"), F.col("lang").alias("contract_type"),
        F.lit("junior").alias("experience_level"), F.lit(5000.0).alias("salary_from"),
        F.lit(7000.0).alias("salary_to"), F.lit("PLN").alias("salary_currency"))))
    out = EN.merge_fill(d, "det", ["company", "contract_type", "experience_level"],
                        group=["salary_from", "salary_to", "salary_currency"], group_guard="salary_from")
    return out.select(F.col("position").cast("bigint").alias("position"), "company", "contract_type",
                      "experience_level", "salary_from", "salary_to", "salary_currency")


@query("q_param_first", sql="""
WITH p AS (SELECT doc_id, CASE doc_id % 3
    WHEN 0 THEN list_value(struct_pack(key := 'type', label := source), struct_pack(key := 'agreement', label := lang),
                           struct_pack(key := 'agreement', label := 'second'))
    WHEN 1 THEN list_value(struct_pack(key := 'type', label := source), struct_pack(key := 'size', label := lang))
    ELSE list_value(struct_pack(key := 'size', label := lang)) END AS params FROM {{text_doc}})
SELECT doc_id, coalesce((list_filter(params, lambda x: x.key = 'agreement'))[1],
                        (list_filter(params, lambda x: x.key = 'type'))[1]).label AS contract_type FROM p""")
def q_param_first(spark, sf):
    d = adapter(spark, sf, "text_doc")

    def kv(k, v):
        return F.struct(F.lit(k).alias("key"), (F.col(v) if v in ("source", "lang") else F.lit(v)).alias("label"))
    params = (F.when(F.col("doc_id") % 3 == 0, F.array(kv("type", "source"), kv("agreement", "lang"), kv("agreement", "second")))
              .when(F.col("doc_id") % 3 == 1, F.array(kv("type", "source"), kv("size", "lang")))
              .otherwise(F.array(kv("size", "lang"))))
    return d.select("doc_id", EN.param(params, ["agreement", "type"]).alias("contract_type"))


_DIM_KEY_SQL = ("CASE id % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCES))
                + " ELSE lower(name) END")


@query("q_dim_lookup", sql=f"""
SELECT id, {_DIM_KEY_SQL} AS source, {sqlx.source_display(_DIM_KEY_SQL)} AS source_name FROM {{{{place_na}}}}""")
def q_dim_lookup(spark, sf):
    expr = None
    for i, s in enumerate(SOURCES):
        expr = F.when(F.col("id") % 9 == i, F.lit(s)) if expr is None else expr.when(F.col("id") % 9 == i, F.lit(s))
    d = adapter(spark, sf, "place_na").withColumn("source", expr.otherwise(F.lower("name")))
    dim = spark.createDataFrame(list(SOURCE_NAMES.items()), "key string, name string")
    return EN.lookup(d, dim, "source", "key", "name", "source_name").select("id", "source", "source_name")


# ---------------------------------------------------------------- positional outcome rules

def _attempts(spark, sf):
    a = adapter(spark, sf, "attempts_ev")
    return a.select("run_id", "source", "position", "status", "cache_hit", "no_slug",
                    url_key("url").alias("url_key"),
                    block_flag("body", "status").alias("blocked"), block_mark("body").alias("block_mark"),
                    (F.col("position") % 11 != 0).alias("parsed"),
                    F.when((F.col("status") == 0) & (F.col("position") % 3 == 0),
                           F.concat(F.lit("net "), F.col("position").cast("string"))).alias("error"),
                    F.when(F.col("status") == 200, F.col("body")).alias("description"))


# The messages of each source, written out: no id, http, transport, no response, unparsed body, empty
# body, blocked by status, blocked by needle.
_ST = "CAST(coalesce(status, 0) AS VARCHAR)"
_HTTP, _NFJ = f"'http ' || {_ST}", f"'detail fetch failed (status ' || {_ST} || ')'"
_BLOCKED = f"'blocked (status ' || {_ST} || ')'"
_MESSAGES = {
    "justjoin": ("'no slug'", _HTTP, "error", "'no result'", "'ld+json not found'", "'empty description'", _HTTP,
                 "'block-signal: ' || mark"),
    "rocketjobs": ("'no slug'", _HTTP, "'fetch ' || error", "'empty result'", "'ld+json JobPosting not found'",
                   "'empty description'", _HTTP, "'block signal'"),
    "talentdays": ("'no slug'", _HTTP, "'fetch ' || error", "'no content'", f"'bad json (http ' || {_ST} || ')'",
                   "'no content'", _HTTP, "'block signal'"),
    "nofluffjobs": ("'no slug in url'", _NFJ, "'detail fetch failed (status 0)'", "'detail fetch failed (status 0)'", _NFJ,
                    "NULL", _BLOCKED, _BLOCKED),
    "olx": ("'no ad id on card'", f"'HTTP ' || {_ST}", "'HTTP 0 / ' || error", "'HTTP 0'", f"'HTTP ' || {_ST}", "NULL",
            "NULL", "NULL"),
}


def _outcome_sql(profile: str) -> str:
    """Oracle: the source's rules with plain window functions."""
    no_id, http, transport, silent, unparsed, empty_text, by_status, by_needle = _MESSAGES[profile]
    empty = "'fetched'" if profile in ("nofluffjobs", "olx") else "'error'"
    if profile == "nofluffjobs":
        consec = """, n AS (SELECT *, lag(status, 1) OVER w AS s1, lag(status, 2) OVER w AS s2 FROM c WHERE attempt
              WINDOW w AS (PARTITION BY run_id, source ORDER BY position)),
     cc AS (SELECT run_id, source, min(position) AS cut_c FROM n WHERE status = 0 AND s1 = 0 AND s2 = 0 GROUP BY 1, 2)"""
    else:
        consec = ", cc AS (SELECT run_id, source, CAST(NULL AS BIGINT) AS cut_c FROM c WHERE false)"
    any_status = f"WHEN NOT parsed THEN {unparsed}" if profile == "talentdays" else ""
    return f"""
WITH a0 AS (SELECT run_id, source, position, status, cache_hit, no_slug, {sqlx.url_key('url')} AS url_key,
                   (coalesce(status IN (403, 429), false) OR regexp_matches(lower(coalesce(body, '')),
                    'captcha|just a moment|cf-chl|datadome|access denied|attention required')) AS blocked,
                   CASE WHEN contains(lower(body), 'captcha') THEN 'captcha'
                        WHEN contains(lower(body), 'just a moment') THEN 'just a moment'
                        WHEN contains(lower(body), 'cf-chl') THEN 'cf-chl' WHEN contains(lower(body), 'datadome') THEN 'datadome'
                        WHEN contains(lower(body), 'access denied') THEN 'access denied'
                        WHEN contains(lower(body), 'attention required') THEN 'attention required' ELSE '' END AS mark,
                   position % 11 <> 0 AS parsed,
                   CASE WHEN status = 0 AND position % 3 = 0 THEN 'net ' || CAST(position AS VARCHAR) ELSE '' END AS error,
                   CASE WHEN status = 200 THEN body END AS description FROM {{{{attempts_ev}}}}),
     a AS (SELECT *, url_key <> '' AS has_url, coalesce(status BETWEEN 200 AND 299 AND NOT blocked, false) AS got,
                  coalesce(status BETWEEN 200 AND 299 AND NOT blocked, false) AND parsed AS ok,
                  coalesce(status BETWEEN 200 AND 299 AND NOT blocked, false) AND parsed
                    AND coalesce(length(description) > 0, false) AS success FROM a0),
     f AS (SELECT run_id, source, url_key, min(position) AS first_ok FROM a
           WHERE has_url AND NOT cache_hit AND NOT no_slug AND success GROUP BY 1, 2, 3),
     b AS (SELECT a.*, coalesce(a.position > f.first_ok AND NOT a.cache_hit, false) AS twin
           FROM a LEFT JOIN f USING (run_id, source, url_key)),
     c AS (SELECT *, has_url AND NOT cache_hit AND NOT twin AND NOT no_slug AS attempt FROM b),
     cb AS (SELECT run_id, source, min(position) AS cut_b FROM c WHERE attempt AND blocked GROUP BY 1, 2)
     {consec},
     cuts AS (SELECT coalesce(cb.run_id, cc.run_id) AS run_id, coalesce(cb.source, cc.source) AS source,
                     cb.cut_b, cc.cut_c FROM cb FULL OUTER JOIN cc ON cb.run_id = cc.run_id AND cb.source = cc.source),
     o AS (SELECT c.*, cuts.cut_b, cuts.cut_c, least(cuts.cut_b, cuts.cut_c) AS cut,
            CASE WHEN NOT has_url OR coalesce(position > least(cuts.cut_b, cuts.cut_c), false) THEN 'skipped'
                 WHEN cache_hit OR twin THEN 'cached' WHEN no_slug THEN 'error' WHEN blocked THEN 'blocked'
                 WHEN success THEN 'fetched' WHEN ok THEN {empty} ELSE 'error' END AS outcome
           FROM c LEFT JOIN cuts USING (run_id, source))
SELECT *, CASE WHEN outcome = 'blocked' THEN CASE WHEN status IN (403, 429) THEN {by_status} ELSE {by_needle} END
               WHEN outcome = 'error' THEN CASE WHEN no_slug THEN {no_id} WHEN ok THEN {empty_text} WHEN got THEN {unparsed}
                 WHEN coalesce(status, 0) = 0 AND error <> '' THEN {transport} WHEN coalesce(status, 0) = 0 THEN {silent}
                 {any_status} ELSE {http} END END AS detail_error FROM o"""


def _outcomes(spark, sf, profile):
    return resolve_outcomes(_attempts(spark, sf), RULES[profile])


@query("q_outcome", sql=" UNION ALL ".join(
    f"""SELECT '{p}' AS rules, run_id, source, CAST(position AS BIGINT) AS position, outcome, detail_error
FROM ({_outcome_sql(p)})""" for p in _MESSAGES))
def q_outcome(spark, sf):
    return resolve_by_rules(_attempts(spark, sf), RULES).select(
        "rules", "run_id", "source", F.col("position").cast("bigint").alias("position"), "outcome", "detail_error")


@query("q_twin_reuse", sql=f"""SELECT run_id, source, CAST(position AS BIGINT) AS position, twin, outcome
FROM ({_outcome_sql('olx')}) WHERE twin OR cache_hit""")
def q_twin_reuse(spark, sf):
    o = _outcomes(spark, sf, "olx")
    return o.where(F.col("twin") | F.col("cache_hit")).select(
        "run_id", "source", F.col("position").cast("bigint").alias("position"), "twin", "outcome")


@query("q_abort_cut", sql=f"""SELECT run_id, source, CAST(min(cut) AS BIGINT) AS cut, min(cut) IS NOT NULL AS aborted,
  CAST(count(*) FILTER (WHERE outcome = 'skipped') AS BIGINT) AS untouched
FROM ({_outcome_sql('talentdays')}) GROUP BY run_id, source""")
def q_abort_cut(spark, sf):
    o = _outcomes(spark, sf, "talentdays")
    return o.groupBy("run_id", "source").agg(F.min("cut").cast("bigint").alias("cut"),
                                             F.min("cut").isNotNull().alias("aborted"),
                                             F.count_if(F.col("outcome") == "skipped").cast("bigint").alias("untouched"))


@query("q_consec_fail", sql=f"""SELECT run_id, source, CAST(min(cut_c) AS BIGINT) AS cut_consecutive,
  CAST(min(cut_b) AS BIGINT) AS cut_blocked
FROM ({_outcome_sql('nofluffjobs')}) GROUP BY run_id, source""")
def q_consec_fail(spark, sf):
    o = _outcomes(spark, sf, "nofluffjobs")
    return o.groupBy("run_id", "source").agg(F.min("cut_consecutive").cast("bigint").alias("cut_consecutive"),
                                             F.min("cut_blocked").cast("bigint").alias("cut_blocked"))


@query("q_run_status", sql=f"""SELECT run_id, source, CAST(count(*) AS BIGINT) AS count,
  CAST(count(*) FILTER (WHERE outcome = 'fetched') AS BIGINT) AS details_fetched,
  CAST(count(*) FILTER (WHERE outcome = 'cached') AS BIGINT) AS details_cached,
  CAST(count(*) FILTER (WHERE outcome = 'error' OR outcome = 'blocked') AS BIGINT) AS detail_errors,
  bool_or(cut IS NOT NULL) AS detail_aborted
FROM ({_outcome_sql('nofluffjobs')}) GROUP BY run_id, source""")
def q_run_status(spark, sf):
    return run_status(_outcomes(spark, sf, "nofluffjobs"), RULES["nofluffjobs"])


# ---------------------------------------------------------------- end-to-end detail enrichment (Entry 2)

_DETAIL_CACHE_SQL = f"""SELECT {sqlx.url_key("'https://justjoin.it/job-offer/' || d.lang || '-' || CAST(d.doc_id % 300 AS VARCHAR)")} AS url_key,
  arg_max('cached ' || CAST(d.doc_id AS VARCHAR), d.doc_id) AS description
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 GROUP BY 1"""


@query("q_detail_pipeline", sql=f"""
WITH a0 AS (SELECT run_id, source, position, status, {sqlx.url_key('url')} AS url_key,
                   (coalesce(status IN (403, 429), false) OR regexp_matches(lower(coalesce(body, '')),
                    'captcha|just a moment|cf-chl|datadome|access denied|attention required')) AS blocked,
                   CASE WHEN status = 200 THEN {sqlx.html_text('body', 'olx')} END AS description
            FROM {{{{detail_doc}}}}),
     hc AS ({_DETAIL_CACHE_SQL}),
     a AS (SELECT a0.*, hc.description IS NOT NULL AS cache_hit, hc.description AS hit_description, false AS no_slug,
                  a0.url_key <> '' AS has_url, coalesce(status BETWEEN 200 AND 299 AND NOT blocked, false) AS ok,
                  coalesce(status BETWEEN 200 AND 299 AND NOT blocked, false) AND coalesce(length(a0.description) > 0, false)
                    AS success
           FROM a0 LEFT JOIN hc ON a0.url_key = hc.url_key AND length(hc.description) > 0),
     f AS (SELECT run_id, source, url_key, min(position) AS first_ok, arg_min(description, position) AS twin_description
           FROM a WHERE has_url AND NOT cache_hit AND success GROUP BY 1, 2, 3),
     c AS (SELECT a.*, coalesce(a.position > f.first_ok AND NOT a.cache_hit, false) AS twin, f.twin_description,
                  has_url AND NOT cache_hit AND NOT coalesce(a.position > f.first_ok AND NOT a.cache_hit, false) AS attempt
           FROM a LEFT JOIN f USING (run_id, source, url_key)),
     cb AS (SELECT run_id, source, min(position) AS cut FROM c WHERE attempt AND blocked GROUP BY 1, 2),
     o AS (SELECT c.*, cb.cut, CASE WHEN NOT has_url OR coalesce(position > cb.cut, false) THEN 'skipped'
                  WHEN cache_hit OR twin THEN 'cached' WHEN blocked THEN 'blocked' WHEN success THEN 'fetched'
                  ELSE 'error' END AS outcome FROM c LEFT JOIN cb USING (run_id, source))
SELECT source, CAST(position AS BIGINT) AS position, outcome,
       md5(CASE WHEN outcome = 'cached' AND cache_hit THEN hit_description WHEN outcome = 'cached' THEN twin_description
                WHEN outcome = 'fetched' THEN description END) AS description_md5,
       CASE WHEN outcome = 'blocked' AND status IN (403, 429) THEN 'http ' || CAST(status AS VARCHAR)
            WHEN outcome = 'blocked' THEN 'block-signal: captcha'
            WHEN outcome = 'error' AND ok THEN 'empty description'
            WHEN outcome = 'error' THEN 'http ' || CAST(coalesce(status, 0) AS VARCHAR) END AS detail_error
FROM o""")
def q_detail_pipeline(spark, sf):
    """Entry 2 end to end: cache lookup → attach landed responses → HTML to text → block
    flags → twins / abort cut / outcomes → override merge of cached, twin or fetched fields."""
    from jobtide.functions.html import html_to_text
    from jobtide.plans.adapters import table
    d = adapter(spark, sf, "detail_doc").withColumn("url_key", url_key("url"))
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    cache = (docs.join(labels.where("quality = 1"), "doc_id")
             .select(url_key(F.concat(F.lit("https://justjoin.it/job-offer/"), "lang", F.lit("-"),
                                      (F.col("doc_id") % 300).cast("string"))).alias("url_key"),
                     F.concat(F.lit("cached "), F.col("doc_id").cast("string")).alias("description"), "doc_id")
             .groupBy("url_key").agg(F.max_by("description", "doc_id").alias("description"))
             .select("url_key", F.struct("description").alias("f")))
    att = (EN.cache_lookup(d, cache)
           .withColumn("blocked", block_flag("body", "status")).withColumn("block_mark", block_mark("body"))
           .withColumn("description", F.when(F.col("status") == 200, html_to_text("body", "olx")))
           .withColumn("no_slug", F.lit(False)))
    out = resolve_outcomes(att, RULES["justjoin"], twin_fields=("description",), materialize=True)
    final = (F.when((F.col("outcome") == "cached") & F.col("cache_hit"), F.col("hit_f.description"))
             .when(F.col("outcome") == "cached", F.col("twin_description"))
             .when(F.col("outcome") == "fetched", F.col("description")))
    return out.select("source", F.col("position").cast("bigint").alias("position"), "outcome",
                      F.md5(final).alias("description_md5"), "detail_error")


# ---------------------------------------------------------------- the shipped detail run, per source, from bodies

# Offer url by source; its detail id is unique.
_RUN_URLS = {"justjoin": "https://justjoin.it/job-offer/d{}", "rocketjobs": "https://rocketjobs.pl/oferta-pracy/d{}",
             "nofluffjobs": "https://nofluffjobs.com/pl/job/d{}", "talentdays": "https://talentdays.pl/praca-i-staz/d{}",
             "olx": "https://www.olx.pl/oferta/praca/x-CID4-ID{}.html"}
_RUN_HTTP = {"justjoin": "http ", "rocketjobs": "http ", "talentdays": "bad json (http ",
             "nofluffjobs": "detail fetch failed (status ", "olx": "HTTP "}
_RUN_EMPTY = {"justjoin": "'empty description'", "rocketjobs": "'empty description'", "talentdays": "'no content'",
              "nofluffjobs": "NULL", "olx": "NULL"}
_RUN_BLOCK = {"justjoin": "'http 403'", "rocketjobs": "'http 403'", "talentdays": "'http 403'",
              "nofluffjobs": "'blocked (status 403)'", "olx": "NULL"}


def _run_body(source):
    """The document's text as the source's detail response carries it."""
    html = F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))
    page = lambda ld: F.concat(F.lit('<html><script type="application/ld+json">'),
                               F.replace(ld, F.lit("</"), F.lit("<\\/")), F.lit("</script></html>"))
    if source == "justjoin":
        return page(F.to_json(F.struct(html.alias("description"))))
    if source == "rocketjobs":
        return page(F.to_json(F.array(F.struct(F.lit("Organization").alias("@type"), F.lit(None).cast("string").alias("description")),
                                      F.struct(F.lit("JobPosting").alias("@type"), html.alias("description")))))
    if source == "nofluffjobs":
        return F.to_json(F.struct(F.struct(html.alias("description")).alias("details")))
    if source == "talentdays":
        return F.to_json(F.struct(F.struct(html.alias("content")).alias("json")))
    return F.to_json(F.struct(F.struct(html.alias("description")).alias("data")))


def _run_sql(source):
    t = sqlx.html_text("'<p>' || text || '</p>'", source)
    desc = f"CASE WHEN {t} IS NOT NULL THEN 'OPIS:' || chr(10) || {t} END" if source == "nofluffjobs" else t
    end = " || ')'" if "(" in _RUN_HTTP[source] else ""
    return f"""
SELECT '{source}' AS source, doc_id AS position,
       md5(CASE WHEN position_cut IS NULL OR doc_id < position_cut THEN CASE WHEN status = 200 THEN {desc} END END) AS description_md5,
       CASE WHEN doc_id > position_cut THEN NULL WHEN status = 403 THEN {_RUN_BLOCK[source]}
            WHEN status <> 200 THEN '{_RUN_HTTP[source]}' || CAST(status AS VARCHAR){end}
            WHEN {desc} IS NULL THEN {_RUN_EMPTY[source]} END AS detail_error
FROM (SELECT *, min(doc_id) FILTER (WHERE status = 403) OVER () AS position_cut FROM (
        SELECT doc_id, text, CASE WHEN doc_id % 977 = 976 THEN 403 WHEN doc_id % 13 = 5 THEN 500 ELSE 200 END AS status FROM {{{{text_doc}}}}))"""


@query("q_run_details", sql=" UNION ALL ".join(_run_sql(p) for p in _RUN_URLS))
def q_run_details(spark, sf):
    """The shipped detail run of each source, from landed response bodies.  Responses lie in another order than the offers
    and are attached by url, slug or ad id."""
    from jobtide.plans.run import run_details
    from jobtide.schema import DESC_CACHE
    docs, n, cache = adapter(spark, sf, "text_doc"), F.col("doc_id"), spark.createDataFrame([], DESC_CACHE)
    status = F.when(n % 977 == 976, 403).when(n % 13 == 5, 500).otherwise(200)

    def part(source):
        head, tail = _RUN_URLS[source].split("{}")
        number = (n + 100_000).cast("string") if source == "olx" else n.cast("string")
        base = docs.select(F.lit("R1").alias("run_id"), F.lit(source).alias("source"), n.alias("position"),
                           F.concat(F.lit(head), number, F.lit(tail)).alias("url"), status.alias("status"),
                           F.when(status == 200, _run_body(source)).alias("body"))
        offers = base.select("run_id", "source", "position", "url", F.lit(None).cast("string").alias("description"))
        details = base.withColumn("position", -F.col("position") - 1).withColumn("error", F.lit(None).cast("string"))
        out = run_details(offers, details, cache, source)["offers"]
        return out.select("source", "position", F.md5("description").alias("description_md5"), "detail_error")

    # The sources' runs don't wait for each other: the small steps of one fill the cores that another leaves.
    with ThreadPoolExecutor(len(_RUN_URLS)) as pool:
        return union_sources(*pool.map(part, _RUN_URLS))
