"""Column-adding text jobs (I2–I15, C4, C5, C8, C9, A6) over adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide.functions import classify as C
from jobtide.functions.dates import date_or_raw, epoch_to_iso
from jobtide.functions.html import html_to_text
from jobtide.functions.salary import parse_salary
from jobtide.functions.text import clean_city, slug, split_place_date, whole_text
from jobtide.plans import sqlx
from jobtide.plans.adapters import adapter, table
from jobtide.plans.registry import query

VARIANTS = ("spaces", "dash", "trim", "fold")


@query("q_slug", sql="SELECT doc_id, " + ", ".join(f"{sqlx.slug('text', v)} AS slug_{v}" for v in VARIANTS)
       + " FROM {{text_doc}}")
def q_slug(spark, sf):
    return adapter(spark, sf, "text_doc").select("doc_id", *[slug("text", v).alias(f"slug_{v}") for v in VARIANTS])


def _salary_query(dialect):
    f, t, c = sqlx.salary("text", dialect)

    @query(f"q_salary_{dialect}", sql=f"SELECT id, text, {f} AS salary_from, {t} AS salary_to, {c} AS salary_currency "
           "FROM {{salary_or}}")
    def q(spark, sf):
        return adapter(spark, sf, "salary_or").select("id", "text", parse_salary("text", dialect).alias("s")) \
            .select("id", "text", "s.*")
    return q


for _d in ("olx", "indeed", "pracuj", "theprotocol"):
    _salary_query(_d)


@query("q_contract_class", sql=f"SELECT doc_id, {sqlx.classify('text', sqlx.CONTRACT)} AS contract_type FROM {{{{text_doc}}}}")
def q_contract_class(spark, sf):
    return adapter(spark, sf, "text_doc").select("doc_id", C.contract_type("text").alias("contract_type"))


@query("q_seniority_class",
       sql=f"""SELECT doc_id, {sqlx.classify("concat_ws(' ', title, text)", sqlx.SENIORITY)} AS experience_level
FROM {{{{text_doc}}}}""")
def q_seniority_class(spark, sf):
    """I5 over the title and the card's whole text."""
    return adapter(spark, sf, "text_doc").select(
        "doc_id", C.seniority(F.concat_ws(" ", "title", "text")).alias("experience_level"))


@query("q_entry_level", sql=f"""
SELECT doc_id, regexp_matches(lower(coalesce(title, '')), '{sqlx.ENTRY}') AS by_title,
       upper(coalesce(lang, '')) = 'EN' AS by_experience
FROM {{{{text_doc}}}}""")
def q_entry_level(spark, sf):
    return adapter(spark, sf, "text_doc").select(
        "doc_id", C.entry_level("title").alias("by_title"),
        C.entry_level(None, "lang", exp_filter="en").alias("by_experience"))


_LABELS_SQL = "list_value(title, lang, source, text)"


@query("q_remote", sql=f"""
SELECT doc_id,
       regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(source, '')), 'zdaln|remote') AS remote_any,
       CASE WHEN regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(lang, '')), 'zdaln|remote') THEN true END
         AS remote_only_true,
       regexp_matches(lower(coalesce(lang, '') || ' ' || coalesce(title, '')), 'zdaln|praca zdalna|{sqlx.w('remote')}')
         AS remote_word,
       CASE WHEN regexp_matches(lower(array_to_string({_LABELS_SQL}, ' | ')), 'zdaln') THEN true
            WHEN regexp_matches(lower(array_to_string({_LABELS_SQL}, ' | ')), 'stacjonarn') THEN false END AS remote_labels
FROM {{{{text_doc}}}}""")
def q_remote(spark, sf):
    d = adapter(spark, sf, "text_doc")
    labels = F.array("title", "lang", "source", "text")
    return d.select("doc_id",
                    C.infer_remote("any", "title", "source").alias("remote_any"),
                    C.infer_remote("only_true", "title", "lang").alias("remote_only_true"),
                    C.infer_remote("word", "lang", "title").alias("remote_word"),
                    C.infer_remote("labels", labels).alias("remote_labels"))


@query("q_label_pick", sql=f"""
SELECT doc_id,
       (list_filter(list_filter({_LABELS_SQL}, lambda x: length(x) BETWEEN 1 AND 59),
                    lambda x: regexp_matches(lower(x), '{C.CONTRACT_LABEL_RE}')))[1] AS contract_type,
       (list_filter(list_filter({_LABELS_SQL}, lambda x: length(x) BETWEEN 1 AND 59),
                    lambda x: regexp_matches(lower(x), '{C.EXPERIENCE_LABEL_RE}')))[1] AS experience_level,
       CAST(len(list_filter({_LABELS_SQL}, lambda x: length(x) BETWEEN 1 AND 59)) AS INTEGER) AS n_labels
FROM {{{{text_doc}}}}""")
def q_label_pick(spark, sf):
    d = adapter(spark, sf, "text_doc").withColumn(
        "labels", C.keep_labels(F.array("title", "lang", "source", "text")))
    return d.select("doc_id", C.pick_label("labels", C.CONTRACT_LABEL_RE).alias("contract_type"),
                    C.pick_label("labels", C.EXPERIENCE_LABEL_RE).alias("experience_level"),
                    F.size("labels").alias("n_labels"))


@query("q_city_clean", sql=f"""
SELECT id,
       nullif({sqlx.js_trim("regexp_replace(loc, '^\\d{2}-\\d{3}\\s*', '')")}, '') AS city_postal,
       nullif({sqlx.js_trim("split_part(place_date, ' - ', 1)")}, '') AS city_before_dash,
       CASE WHEN {sqlx.js_trim("string_split_regex(city_raw, '[,\\n]')[1]")} <> ''
            THEN {sqlx.js_trim("string_split_regex(city_raw, '[,\\n]')[1]")}
            ELSE nullif({sqlx.js_trim('city_raw')}, '') END AS city_first_part
FROM {{{{place_na}}}}""")
def q_city_clean(spark, sf):
    return adapter(spark, sf, "place_na").select(
        "id", clean_city("loc", "postal").alias("city_postal"),
        clean_city("place_date", "before_dash").alias("city_before_dash"),
        clean_city("city_raw", "first_part").alias("city_first_part"))


@query("q_place_date", sql=f"""
SELECT id, CASE WHEN position(' - ' IN place_date) > 0
                THEN {sqlx.js_trim("substr(place_date, position(' - ' IN place_date) + 3)")} END AS date_text
FROM {{{{place_na}}}}""")
def q_place_date(spark, sf):
    return adapter(spark, sf, "place_na").select("id", split_place_date("place_date").alias("date_text"))


def _epoch_inputs_spark(spark, sf):
    o = table(spark, sf, "orders")
    ms = F.unix_millis((F.col("o_orderdate") + F.expr("INTERVAL 30 YEARS")).cast("timestamp"))
    v = (F.when(F.col("o_orderkey") % 4 == 0, ms.cast("string"))
         .when(F.col("o_orderkey") % 4 == 1, F.floor(ms / 1000).cast("string"))
         .when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
         .otherwise(F.lit("x")))
    return o.select(F.col("o_orderkey").alias("id"), v.alias("v"))


_EPOCH_INPUTS_SQL = """SELECT o_orderkey AS id,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(epoch_ms(o_orderdate + INTERVAL 30 YEAR) AS VARCHAR)
                      WHEN 1 THEN CAST(epoch_ms(o_orderdate + INTERVAL 30 YEAR) // 1000 AS VARCHAR)
                      WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'x' END AS v FROM orders"""


@query("q_epoch_iso", sql=f"""
SELECT id, v, strftime(CASE WHEN regexp_matches(v, '^\\s*-?\\d+(\\.\\d+)?\\s*$')
                            THEN make_timestamp(CAST(floor(CASE WHEN CAST(v AS DOUBLE) < 1e12 THEN CAST(v AS DOUBLE) * 1000
                                                            ELSE CAST(v AS DOUBLE) END) AS BIGINT) * 1000)
                            ELSE try_strptime(v, '%Y-%m-%d') END, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso
FROM ({_EPOCH_INPUTS_SQL})""")
def q_epoch_iso(spark, sf):
    return _epoch_inputs_spark(spark, sf).select("id", "v", epoch_to_iso("v").alias("iso"))


def _date_inputs_spark(spark, sf):
    o = table(spark, sf, "orders")
    v = (F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
         .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
         .otherwise(F.concat(F.lit("dodane "), F.col("o_orderpriority"))))
    return o.select(F.col("o_orderkey").alias("id"), v.alias("v"))


_DATE_INPUTS_SQL = """SELECT o_orderkey AS id,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                      WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                      ELSE 'dodane ' || o_orderpriority END AS v FROM orders"""


@query("q_date_or_raw", sql=f"""
SELECT id, v, coalesce(strftime(coalesce(try_strptime(v, '%Y-%m-%d %H:%M:%S'), try_strptime(v, '%Y-%m-%d')),
                                '%Y-%m-%dT%H:%M:%S.%gZ'), v) AS published_at
FROM ({_DATE_INPUTS_SQL})""")
def q_date_or_raw(spark, sf):
    return _date_inputs_spark(spark, sf).select("id", "v", date_or_raw("v").alias("published_at"))


_PROFILES = ("justjoin", "rocketjobs", "nofluffjobs", "talentdays", "olx")


@query("q_html_text", sql="SELECT page_id, " + ", ".join(f"{sqlx.html_text('html', p)} AS text_{p}" for p in _PROFILES)
       + " FROM {{html_pg}}")
def q_html_text(spark, sf):
    return adapter(spark, sf, "html_pg").select("page_id", *[html_to_text("html", p).alias(f"text_{p}") for p in _PROFILES])


_CAP_SQL = f"CASE WHEN length({sqlx.js_trim('text')}) > 0 THEN text END"


@query("q_truncate", sql=f"""
SELECT position, CAST(length({_CAP_SQL}) AS INTEGER) AS desc_len, md5({_CAP_SQL}) AS desc_md5
FROM {{{{descr_doc}}}}""")
def q_truncate(spark, sf):
    d = adapter(spark, sf, "descr_doc").withColumn("d", whole_text("text"))
    return d.select("position", F.length("d").alias("desc_len"), F.md5("d").alias("desc_md5"))


_NEEDLES = ["captcha", "just a moment", "cf-chl", "datadome", "access denied", "attention required"]
_MORE_NEEDLES = [*_NEEDLES, "cloudflare", "verifying you are human", "verify you are human", "unusual traffic"]


@query("q_block_flag", sql=f"""SELECT doc_id, {sqlx.block('body', 'status', _NEEDLES)} AS blocked_detail,
  {sqlx.block('body', 'status', _MORE_NEEDLES)} AS blocked_list_page FROM {{{{body_doc}}}}""")
def q_block_flag(spark, sf):
    d = adapter(spark, sf, "body_doc")
    return d.select("doc_id", C.block_flag("body", "status").alias("blocked_detail"),
                    C.block_flag("body", "status", C.BLOCK_NEEDLES_EXTENDED).alias("blocked_list_page"))
