"""Mapping, filters, caps, source dedup, list-page status, tracker history and the
shortlist (C1–C3, C6–C7, F1, G1, H1, E3–E5, F7, B2–B3, D10–D11, L1–L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide.functions.urls import abs_url, identity_key, query_id, url_key
from jobtide.operators import rules as RU
from jobtide.operators import shortlist as SL
from jobtide.operators.dedup import dedup_run, dedup_source
from jobtide.operators.filters import apply_filters, filters_from_url
from jobtide.operators.mapping import require, to_common
from jobtide.operators.positional import budget_report, page_yield, run_names, union_sources
from jobtide.operators.status import blocked_sources, vocab_violations
from jobtide.plans import sqlx
from jobtide.plans.adapters import adapter
from jobtide.plans.registry import query
from jobtide.schema import SOURCES
from jobtide.session import read_table
from jobtide.sinks.export import export_records
from jobtide.sinks.observed import unique_join
from jobtide.sources.landing import ingest_cards


def _pos():
    return F.col("position").cast("bigint").alias("position")


# ---------------------------------------------------------------- C1 / A8 mapping of indeed cards

_IND = "coalesce(nullif(jk, ''), nullif(regexp_extract(coalesce(href, ''), '[?&]jk=([0-9a-fA-F]+)', 1), ''))"
_IND_F, _IND_T, _IND_C = sqlx.salary("salaryText", "indeed")


@query("q_to_common", sql=f"""
SELECT CAST(position AS BIGINT) AS position, 'indeed' AS source, nullif(company, '') AS company, nullif(title, '') AS title,
  CASE WHEN {_IND} IS NOT NULL THEN 'https://pl.indeed.com/viewjob?jk=' || {_IND}
       WHEN nullif(href, '') IS NOT NULL THEN CASE WHEN starts_with(href, 'http') THEN href
                                                   ELSE 'https://pl.indeed.com' || href END END AS url,
  nullif({sqlx.js_trim("regexp_replace(loc, '^\\d{2}-\\d{3}\\s*', '')")}, '') AS city,
  {_IND_F} AS salary_from, {_IND_T} AS salary_to, {_IND_C} AS salary_currency,
  {sqlx.classify("concat_ws(' ', coalesce(metaText, ''), coalesce(cardText, ''))", sqlx.CONTRACT)} AS contract_type,
  {sqlx.classify("concat_ws(' ', coalesce(title, ''), coalesce(cardText, ''))", sqlx.SENIORITY)} AS experience_level,
  nullif(publishedAt, '') AS published_at,
  regexp_matches(lower(concat_ws(' ', coalesce(loc, ''), coalesce(cardText, ''))), 'zdaln|praca zdalna|{sqlx.w('remote')}')
    AS remote,
  {_IND} AS jk
FROM {{{{cards_ev}}}} WHERE coalesce(length(title) > 0, false) OR {_IND} IS NOT NULL""")
def q_to_common(spark, sf):
    cards = ingest_cards(adapter(spark, sf, "cards_ev"), "indeed")
    c = to_common(cards, "indeed")
    return c.select(_pos(), "source", "company", "title", "url", "city", "salary_from", "salary_to", "salary_currency",
                    "contract_type", "experience_level", "published_at", "remote", "jk")


_REQ_SQL = """
SELECT CAST(position AS BIGINT) AS position, source FROM (
  SELECT position, CASE source WHEN 'click' THEN 'justjoin' WHEN 'view' THEN 'olx' WHEN 'purchase' THEN 'nofluffjobs'
                               ELSE 'pracuj' END AS source,
         CASE WHEN position % 7 = 0 THEN NULL ELSE url END AS url,
         CASE WHEN position % 5 = 0 THEN '' ELSE title END AS title FROM {{offers_ev}})
WHERE CASE WHEN source = 'olx' THEN coalesce(title <> '', false)
           WHEN source = 'nofluffjobs' THEN coalesce(title <> '', false) OR coalesce(url <> '', false)
           ELSE coalesce(url <> '', false) END"""


@query("q_require", sql=_REQ_SQL)
def q_require(spark, sf):
    src = {"click": "justjoin", "view": "olx", "purchase": "nofluffjobs"}
    m = F.create_map(*[x for k, v in src.items() for x in (F.lit(k), F.lit(v))])
    d = adapter(spark, sf, "offers_ev").select(
        "position", F.coalesce(F.try_element_at(m, F.col("source")), F.lit("pracuj")).alias("source"),
        F.when(F.col("position") % 7 == 0, F.lit(None)).otherwise(F.col("url")).alias("url"),
        F.when(F.col("position") % 5 == 0, F.lit("")).otherwise(F.col("title")).alias("title"))
    return require(d).select(_pos(), "source")


_HREF_SQL = ("CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^https?://[^/]+(/.*)$', 1) "
             "WHEN 1 THEN regexp_extract(url, '([^/?#]+)[^/]*$', 1) ELSE url END")


@query("q_abs_url", sql=f"""
SELECT page_id, href, CASE WHEN {sqlx.js_trim('href')} = '' OR href IS NULL THEN NULL
  WHEN regexp_matches({sqlx.js_trim('href')}, '(?i)^https?://') THEN {sqlx.js_trim('href')}
  WHEN starts_with({sqlx.js_trim('href')}, '/') THEN 'https://nofluffjobs.com' || {sqlx.js_trim('href')}
  ELSE 'https://nofluffjobs.com/pl/job/' || {sqlx.js_trim('href')} END AS url
FROM (SELECT page_id, {_HREF_SQL} AS href FROM {{{{html_pg}}}})""")
def q_abs_url(spark, sf):
    d = adapter(spark, sf, "html_pg")
    href = (F.when(F.col("page_id") % 3 == 0, F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1))
            .when(F.col("page_id") % 3 == 1, F.regexp_extract("url", r"([^/?#]+)[^/]*$", 1)).otherwise(F.col("url")))
    d = d.select("page_id", href.alias("href"))
    return d.select("page_id", "href", abs_url("href", "https://nofluffjobs.com", "https://nofluffjobs.com/pl/job/").alias("url"))


@query("q_query_id", sql="""
SELECT page_id, nullif(regexp_extract(coalesce(url, ''), '[?&]page=([0-9a-fA-F]+)', 1), '') AS page_param,
       nullif(regexp_extract(coalesce(url, ''), '[?&]jk=([0-9a-fA-F]+)', 1), '') AS jk FROM {{html_pg}}""")
def q_query_id(spark, sf):
    d = adapter(spark, sf, "html_pg")
    return d.select("page_id", query_id("url", "page").alias("page_param"), query_id("url", "jk").alias("jk"))


# ---------------------------------------------------------------- F1, H1, G1, E4

@query("q_dedup_source", sql=f"""
SELECT run_id, source, CAST(position AS BIGINT) AS position, {sqlx.url_key('url')} AS url_key FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, source, {sqlx.url_key('url')} ORDER BY position) AS rn
  FROM {{{{offers_ev}}}}) WHERE rn = 1""")
def q_dedup_source(spark, sf):
    d = adapter(spark, sf, "offers_ev")
    return dedup_source(d, url_key("url")).select("run_id", "source", _pos(), url_key("url").alias("url_key"))


@query("q_union_sources", sql="""
SELECT source, CAST(position AS BIGINT) AS position, url, company, city, remote FROM (
  SELECT source, position, url, company FROM {{offers_ev}} WHERE source IN ('click', 'purchase')
  UNION ALL BY NAME
  SELECT source, position, url, city, remote FROM {{offers_ev}} WHERE source NOT IN ('click', 'purchase'))""")
def q_union_sources(spark, sf):
    d = adapter(spark, sf, "offers_ev")
    a = d.where(F.col("source").isin("click", "purchase")).select("source", "position", "url", "company")
    b = d.where(~F.col("source").isin("click", "purchase")).select("source", "position", "url", "city", "remote")
    return union_sources(a, b).select("source", _pos(), "url", "company", "city", "remote")


CAPS_EV = {"click": 1000, "view": 300, "purchase": 1000}


@query("q_cap_per_source", sql="""
SELECT run_id, source, count(*) AS rows,
       CAST(CASE WHEN source IN ('click', 'purchase') THEN 1000 WHEN source = 'view' THEN 300 END AS BIGINT) AS budget,
       CAST(CASE WHEN source IN ('click', 'purchase') THEN greatest(count(*) - 1000, 0)
                 WHEN source = 'view' THEN greatest(count(*) - 300, 0) ELSE 0 END AS BIGINT) AS beyond
FROM {{offers_ev}} GROUP BY run_id, source""")
def q_cap_per_source(spark, sf):
    return budget_report(adapter(spark, sf, "offers_ev"), CAPS_EV)


@query("q_page_yield", sql=f"""
WITH x AS (SELECT run_id, source, CAST(floor(position / 250) AS INT) + 1 AS page_no, position,
                  {sqlx.url_key('url')} AS k FROM {{{{offers_ev}}}}),
     f AS (SELECT *, row_number() OVER (PARTITION BY run_id, source, k ORDER BY page_no, position) AS rn FROM x)
SELECT run_id, source, page_no, CAST(count(*) FILTER (WHERE rn = 1) AS BIGINT) AS new_rows,
       CAST(count(*) FILTER (WHERE rn > 1) AS BIGINT) AS seen_rows FROM f GROUP BY run_id, source, page_no""")
def q_page_yield(spark, sf):
    d = adapter(spark, sf, "offers_ev").withColumn("page_no", (F.floor(F.col("position") / 250) + 1).cast("int"))
    return page_yield(d, url_key("url"))


# ---------------------------------------------------------------- C6, C7

@query("q_filter_url", sql="""
WITH s AS (SELECT page_id, url, string_split(split_part(coalesce(url, ''), '?', 2), '&') AS kvs FROM {{html_pg}}),
     p AS (SELECT page_id, kv, pos FROM (SELECT page_id, unnest(kvs) AS kv, generate_subscripts(kvs, 1) AS pos FROM s)
           WHERE instr(kv, '=') > 1),
     d AS (SELECT page_id, pos, substr(kv, 1, instr(kv, '=') - 1) AS key, url_decode(substr(kv, instr(kv, '=') + 1)) AS value
           FROM p),
     l AS (SELECT page_id, key AS field, arg_max(value, pos) AS value FROM d GROUP BY page_id, key),
     e AS (SELECT page_id, field, unnest(string_split(value, ',')) AS value,
                  generate_subscripts(string_split(value, ','), 1) - 1 AS idx FROM l WHERE value <> ''),
     c AS (SELECT page_id, 'city' AS field, 0 AS idx,
                  url_decode(regexp_extract(regexp_replace(split_part(split_part(coalesce(url, ''), '?', 1), '#', 1), '/+$', ''),
                             '^[a-zA-Z]+://[^/]+/(?:.*/)?([^/]+)$', 1)) AS value FROM {{html_pg}})
SELECT page_id, field, CAST(idx AS BIGINT) AS idx, value FROM e
UNION ALL SELECT page_id, field, CAST(idx AS BIGINT) AS idx, value FROM c WHERE value <> ''""")
def q_filter_url(spark, sf):
    d = adapter(spark, sf, "html_pg")
    f = filters_from_url(d, ("page_id",), "url")
    return f.select("page_id", "field", F.col("idx").cast("bigint").alias("idx"), "value")


# Pasted filter URLs for the adapter's sources (configuration rows).
FILTER_CONFIG = [
    ("click", "https://justjoin.it/job-offers/wroclaw?employment-types=internship,b2b&x=1"),
    ("view", "https://rocketjobs.pl/oferty-pracy/wroclaw?experience-level=junior&experience-level=mid"),
    ("purchase", "https://talentdays.pl/oferty/opole?employment-type=b2b&employment-types=internship"),
]


@query("q_source_filters", sql=f"""
WITH o AS (SELECT *, CASE WHEN position % 2 = 0 THEN 'internship' ELSE 'b2b' END AS contract_type,
                     CASE position % 3 WHEN 0 THEN 'junior' WHEN 1 THEN 'mid' ELSE 'senior' END AS experience_level
           FROM {{{{offers_ev}}}})
SELECT CAST(position AS BIGINT) AS position, source FROM o
WHERE (source NOT IN ('click', 'purchase', 'view') OR (source IN ('click', 'view') AND {sqlx.slug('city', 'dash')} = 'wroclaw')
       OR (source = 'purchase' AND {sqlx.slug('city', 'dash')} = 'opole'))
  AND (source <> 'click' OR lower(contract_type) IN ('internship', 'b2b'))
  AND (source <> 'purchase' OR lower(contract_type) = 'internship')
  AND (source <> 'view' OR lower(experience_level) = 'mid')""")
def q_source_filters(spark, sf):
    o = adapter(spark, sf, "offers_ev").withColumn(
        "contract_type", F.when(F.col("position") % 2 == 0, F.lit("internship")).otherwise(F.lit("b2b"))).withColumn(
        "experience_level", F.when(F.col("position") % 3 == 0, F.lit("junior"))
        .when(F.col("position") % 3 == 1, F.lit("mid")).otherwise(F.lit("senior")))
    cfg = spark.createDataFrame(FILTER_CONFIG, "source string, url string")
    out = apply_filters(o, filters_from_url(cfg))
    return out.select(_pos(), "source")


# ---------------------------------------------------------------- E3, E5, F7, B3

@query("q_blocked_sources", sql=f"""
WITH p AS (SELECT * FROM {{{{pages_ev}}}}),
     sig AS (SELECT *, regexp_matches(lower(coalesce(text, '')),
                         'captcha|just a moment|cf-chl|datadome|access denied|attention required')
                       OR (source = 'indeed' AND regexp_matches(lower(coalesce(text, '')),
                           'cloudflare|verifying you are human|verify you are human|unusual traffic'))
                       OR status IN (403, 429) OR (source = 'indeed' AND status = 503) AS signal FROM p),
     a AS (SELECT run_id, source, bool_or(signal) AS sig, sum(n_offers) AS offers,
                  sum(CASE WHEN page_no = 1 THEN n_offers ELSE 0 END) AS first_offers,
                  bool_or(regexp_matches(lower(coalesce(text, '')), 'brak wyników|no results|nie znaleziono')) AS no_results,
                  bool_or(status = 200 AND NOT signal) AS valid, bool_or(status >= 500) AS load_failed
           FROM sig GROUP BY run_id, source),
     r AS (SELECT run_id, unnest({'[' + ', '.join(f"'{s}'" for s in SOURCES) + ']'}) AS source FROM (SELECT DISTINCT run_id FROM p))
SELECT r.run_id, r.source, CAST(coalesce(a.offers, 0) AS BIGINT) AS offers,
       coalesce(a.sig, false) OR CASE
         WHEN r.source = 'pracuj' THEN coalesce(a.first_offers, 0) = 0
         WHEN r.source = 'theprotocol' THEN coalesce(a.offers, 0) = 0
         WHEN r.source = 'indeed' THEN coalesce(a.offers, 0) = 0 AND (NOT coalesce(a.no_results, false)
                                                                    OR coalesce(a.load_failed, false))
         WHEN r.source = 'nofluffjobs' THEN coalesce(a.offers, 0) = 0 AND NOT coalesce(a.valid, false)
         ELSE false END AS blocked
FROM r LEFT JOIN a ON r.run_id = a.run_id AND r.source = a.source""")
def q_blocked_sources(spark, sf):
    p = adapter(spark, sf, "pages_ev")
    return blocked_sources(p, SOURCES).withColumn("offers", F.col("offers").cast("bigint"))


@query("q_vocab", sql="""
WITH l AS (SELECT 'place_form' AS "column", place_form AS value FROM {{tracker_or}}
           UNION ALL SELECT 'cv_sent', cv_sent FROM {{tracker_or}}
           UNION ALL SELECT 'status', status FROM {{tracker_or}}),
     v AS (SELECT * FROM (VALUES ('place_form', 'Zdalnie'), ('place_form', 'Hybrydowo'), ('place_form', 'Biuro - Wrocław'),
             ('place_form', 'Biuro - poza Wrocławiem'), ('place_form', 'Niejasne'), ('cv_sent', 'Techniczne'),
             ('cv_sent', 'Fizyczne/usługowe'), ('cv_sent', 'Marketingowe'), ('cv_sent', 'Nie wysłane'),
             ('status', 'Do wysłania'), ('status', 'Wysłane'), ('status', 'Brak odpowiedzi'), ('status', 'Odpowiedź - kontakt'),
             ('status', 'Rozmowa zaplanowana'), ('status', 'Po rozmowie'), ('status', 'Oferta!'), ('status', 'Odmowa'),
             ('status', 'Wycofałem się'), ('status', 'Przeterminowane')) t("column", value))
SELECT l."column" AS "column", CAST(count(*) AS BIGINT) AS violations, CAST(count(DISTINCT l.value) AS BIGINT) AS distinct_values
FROM l WHERE l.value IS NOT NULL AND l.value <> ''
  AND NOT EXISTS (SELECT 1 FROM v WHERE v."column" = l."column" AND v.value = l.value) GROUP BY l."column" """)
def q_vocab(spark, sf):
    return vocab_violations(adapter(spark, sf, "tracker_or"))


_WAW = "((started_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Warsaw')"


@query("q_run_names", sql=f"""
SELECT CAST(id AS BIGINT) AS run_id,
       CASE WHEN k > 1 THEN tab || ' (' || CAST(k AS VARCHAR) || ')' ELSE tab END AS run_tab,
       CASE WHEN k > 1 THEN stamp || '_' || CAST(k AS VARCHAR) ELSE stamp END AS export_stamp
FROM (SELECT id, strftime({_WAW}, '%d.%m.%Y %H-%M') AS tab, strftime({_WAW}, '%Y-%m-%d_%H-%M') AS stamp,
             row_number() OVER (PARTITION BY strftime({_WAW}, '%d.%m.%Y %H-%M') ORDER BY started_at, id) AS k
      FROM {{{{tracker_or}}}})""")
def q_run_names(spark, sf):
    runs = adapter(spark, sf, "tracker_or").select(F.col("id").cast("bigint").alias("run_id"),
                                                   F.col("started_at").cast("timestamp").alias("started_at"))
    return run_names(runs).select("run_id", "run_tab", "export_stamp")


@query("q_latest_run", sql="""
SELECT CAST(id AS BIGINT) AS id, run_tab FROM {{tracker_or}} 
WHERE run_tab = (SELECT arg_max(run_tab, strptime(run_tab, '%d.%m.%Y %H-%M')) FROM {{tracker_or}})""")
def q_latest_run(spark, sf):
    from jobtide.sinks.export import latest_rows
    return latest_rows(adapter(spark, sf, "tracker_or")).select(F.col("id").cast("bigint").alias("id"), "run_tab")


@query("q_export_json", sql=f"""
SELECT run_id, CAST(position AS BIGINT) AS position, {sqlx.url_key('url')} AS url_key, company,
       CAST(salary_from AS DOUBLE) AS salary_from, false AS has_src
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, {sqlx.url_key('url')} ORDER BY source, position) AS rn
      FROM {{{{offers_ev}}}} WHERE {sqlx.url_key('url')} <> '') WHERE rn = 1""")
def q_export_json(spark, sf):
    d = dedup_run(adapter(spark, sf, "offers_ev")).withColumn("_src", F.col("source"))
    rec = export_records(d)
    js = F.col("json")
    return rec.select("run_id", F.get_json_object(js, "$.position").cast("bigint").alias("position"),
                      F.get_json_object(js, "$.url_key").alias("url_key"),
                      F.get_json_object(js, "$.company").alias("company"),
                      F.get_json_object(js, "$.salary_from").cast("double").alias("salary_from"),
                      js.contains('"_src"').alias("has_src"))


# ---------------------------------------------------------------- D10, D11, L1, L3, L4

def _offers_keyed(spark, sf):
    d = dedup_run(adapter(spark, sf, "offers_ev"))
    return d.withColumn("identity_key", identity_key("url", "source"))


@query("q_exclude_applied", sql=f"""
SELECT CAST(position AS BIGINT) AS position, source FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, {sqlx.url_key('url')} ORDER BY source, position) AS rn
  FROM {{{{offers_ev}}}} WHERE {sqlx.url_key('url')} <> '') o
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM {{{{tracker_or}}}} t
  WHERE t.status IN ({", ".join("'" + s + "'" for s in SL.APPLIED_STATUSES)}) AND {sqlx.url_key('t.url')} = {sqlx.url_key('o.url')})""")
def q_exclude_applied(spark, sf):
    t = adapter(spark, sf, "tracker_or").withColumn("url_key", url_key("url"))
    return SL.exclude_applied(_offers_keyed(spark, sf), t).select(_pos(), "source")


@query("q_join_back", sql=f"""
WITH t AS (SELECT id, {sqlx.url_key('url')} AS url_key FROM {{{{tracker_or}}}}),
     r AS (SELECT {sqlx.url_key('url')} AS url_key, salary_from AS fit_score FROM (
             SELECT *, row_number() OVER (PARTITION BY run_id, {sqlx.url_key('url')} ORDER BY source, position) AS rn
             FROM {{{{offers_ev}}}} WHERE {sqlx.url_key('url')} <> '') WHERE rn = 1),
     lc AS (SELECT url_key, count(*) AS nl FROM t GROUP BY 1), rc AS (SELECT url_key, count(*) AS nr FROM r GROUP BY 1)
SELECT CAST(t.id AS BIGINT) AS id, t.url_key, r.fit_score, lc.nl > 1 AS dup_left, rc.nr > 1 AS dup_right
FROM t JOIN r USING (url_key) JOIN lc USING (url_key) JOIN rc USING (url_key)""")
def q_join_back(spark, sf):
    t = adapter(spark, sf, "tracker_or").select("id", url_key("url").alias("url_key"))
    r = dedup_run(adapter(spark, sf, "offers_ev")).select(url_key("url").alias("url_key"),
                                                         F.col("salary_from").alias("fit_score"))
    return SL.join_back(t, r).select(F.col("id").cast("bigint").alias("id"), "url_key", "fit_score", "dup_left",
                                     "dup_right")


@query("q_unique_join", sql=f"""
WITH r AS (SELECT {sqlx.url_key('url')} AS url_key, salary_from AS fit_score, title,
                  row_number() OVER (PARTITION BY run_id, {sqlx.url_key('url')} ORDER BY source, position) AS rn
           FROM {{{{offers_ev}}}} WHERE {sqlx.url_key('url')} <> '')
SELECT url_key, fit_score, title FROM r WHERE rn = 1""")
def q_unique_join(spark, sf):
    """D11 / L5 with the assertion in the join's own pass: a run's shortlist back to its deduplicated offers."""
    d = dedup_run(adapter(spark, sf, "offers_ev").drop("description")).withColumn("url_key", url_key("url"))
    return unique_join(d.select("url_key", "title"), d.select("url_key", F.col("salary_from").alias("fit_score")), "url_key") \
        .select("url_key", "fit_score", "title")


# Shortlist configuration (rules, weights, CV variants).
EXCLUDE_RULES = [("title", "senior|team lead"), ("text", "praca stacjonarna")]
WEIGHTS = [("staż|praktyk", 3.0), ("zdaln", 2.0), ("b2b", -1.0), ("junior|młodszy", 1.5)]
VARIANTS = [("Techniczne", ["b2b", "umowa"]), ("Marketingowe", ["zdalna", "senior"]),
            ("Fizyczne/usługowe", ["staż", "praktyk"])]


@query("q_hard_exclude", sql="""
SELECT doc_id FROM {{text_doc}} WHERE NOT (coalesce(regexp_matches(lower(title), 'senior|team lead'), false)
                                           OR coalesce(regexp_matches(lower(text), 'praca stacjonarna'), false))""")
def q_hard_exclude(spark, sf):
    return SL.exclude(adapter(spark, sf, "text_doc"), EXCLUDE_RULES).select("doc_id")


@query("q_fit_score", sql="SELECT doc_id, CAST(" + " + ".join(
    f"CASE WHEN regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '{p}') THEN {w} ELSE 0.0 END"
    for p, w in WEIGHTS) + " AS DOUBLE) AS fit_score FROM {{text_doc}}")
def q_fit_score(spark, sf):
    return SL.score(adapter(spark, sf, "text_doc"), WEIGHTS, ["title", "text"]).select("doc_id", "fit_score")


def _variant_sql():
    t = "lower(coalesce(title, '') || ' ' || coalesce(text, ''))"
    s = {n: " + ".join(f"CASE WHEN contains({t}, '{k}') THEN 1 ELSE 0 END" for k in kws) for n, kws in VARIANTS}
    f, m, te = s["Fizyczne/usługowe"], s["Marketingowe"], s["Techniczne"]
    return f"""SELECT doc_id,
  CASE WHEN ({f}) >= ({m}) AND ({f}) >= ({te}) THEN 'Fizyczne/usługowe' WHEN ({m}) >= ({te}) THEN 'Marketingowe'
       ELSE 'Techniczne' END AS cv_variant,
  CAST(greatest({f}, {m}, {te}) AS BIGINT) AS variant_score FROM {{{{text_doc}}}}"""


@query("q_pick_variant", sql=_variant_sql())
def q_pick_variant(spark, sf):
    return SL.pick_variant(adapter(spark, sf, "text_doc"), VARIANTS, ["title", "text"]).select(
        "doc_id", "cv_variant", "variant_score")


# Rules as a table: every longer plain word of the benchmark texts, weighted by its length.
_RULES_SQL = """
SELECT DISTINCT w AS rule_id, w AS pattern, CAST(length(w) % 7 - 3 AS DOUBLE) AS weight
FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 6"""


def _rule_table(spark, sf):
    w = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")
    return read_table(spark, sf, "benchmark").select(w).where(F.length("w") >= 6).distinct().select(
        F.col("w").alias("rule_id"), F.col("w").alias("pattern"), (F.length("w") % 7 - 3).cast("double").alias("weight"))


@query("q_rule_score", sql=f"""
WITH d AS (SELECT doc_id, lower(coalesce(title, '') || ' ' || coalesce(text, '')) AS t FROM {{{{text_doc}}}}),
     h AS (SELECT doc_id, sum(weight) AS s, count(*) AS n FROM d JOIN ({_RULES_SQL}) r ON contains(d.t, r.pattern) GROUP BY doc_id)
SELECT d.doc_id, coalesce(h.s, 0.0) AS fit_score, coalesce(h.n, 0) AS n_rules FROM d LEFT JOIN h USING (doc_id)""")
def q_rule_score(spark, sf):
    """L3 with a rule table: found by grams, tried exactly."""
    hits = RU.match(adapter(spark, sf, "text_doc"), _rule_table(spark, sf), ["title", "text"])
    total = F.aggregate("rule_hits", F.lit(0.0), lambda s, h: s + h["weight"])
    return hits.select("doc_id", total.alias("fit_score"), F.size("rule_hits").cast("bigint").alias("n_rules"))


@query("q_rule_exclude", sql=f"""
SELECT doc_id FROM {{{{text_doc}}}} d WHERE NOT EXISTS (
  SELECT 1 FROM ({_RULES_SQL}) r WHERE contains(lower(coalesce(d.title, '') || ' ' || coalesce(d.text, '')), r.pattern))""")
def q_rule_exclude(spark, sf):
    """L1 with a rule table."""
    return RU.exclude(adapter(spark, sf, "text_doc"), _rule_table(spark, sf), ["title", "text"]).select("doc_id")
