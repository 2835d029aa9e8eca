"""Minimum slice: landed offers → url key → run dedup → numbered tracker rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide.functions.urls import url_key
from jobtide.operators.dedup import dedup_run
from jobtide.operators.numbering import number_within
from jobtide.functions.tracker import to_tracker
from jobtide.plans import sqlx
from jobtide.plans.adapters import adapter
from jobtide.plans.registry import query

RUN_DEDUP_SQL = f"""
SELECT * FROM (
  SELECT a.*, row_number() OVER (PARTITION BY run_id, {sqlx.url_key('url')} ORDER BY source, position) AS _rn
  FROM {{{{offers_ev}}}} a WHERE {sqlx.url_key('url')} <> '') WHERE _rn = 1
"""


@query("q_url_key", sql=f"SELECT page_id, url, {sqlx.url_key('url')} AS url_key FROM {{{{html_pg}}}}")
def q_url_key(spark, sf):
    return adapter(spark, sf, "html_pg").select("page_id", "url", url_key("url").alias("url_key"))


@query("q_dedup_run", sql=f"""
SELECT run_id, source, CAST(position AS BIGINT) AS position, {sqlx.url_key('url')} AS url_key
FROM ({RUN_DEDUP_SQL})
""")
def q_dedup_run(spark, sf):
    d = dedup_run(adapter(spark, sf, "offers_ev"))
    return d.select("run_id", "source", F.col("position").cast("bigint").alias("position"), url_key("url").alias("url_key"))


def tracker_rows(spark, sf):
    # The tracker has no description, so the wide column enters neither the dedup exchange nor the numbering checkpoint.
    d = dedup_run(adapter(spark, sf, "offers_ev").drop("description"))
    return to_tracker(number_within(d, ["run_id"], ["source", "position"], out="id"))


@query("q_tracker", sql=f"""
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY source, position) AS BIGINT) AS id,
       {sqlx.tracker_cols()}
FROM ({RUN_DEDUP_SQL})
""")
def q_tracker(spark, sf):
    return tracker_rows(spark, sf)


@query("q_tracker_id", sql=f"""
SELECT run_id, source, CAST(position AS BIGINT) AS position,
       CAST(row_number() OVER (PARTITION BY run_id ORDER BY source, position) AS BIGINT) AS id
FROM ({RUN_DEDUP_SQL})
""")
def q_tracker_id(spark, sf):
    d = dedup_run(adapter(spark, sf, "offers_ev").select("run_id", "source", "position", "url"))
    return number_within(d, ["run_id"], ["source", "position"], out="id") \
        .select("run_id", "source", F.col("position").cast("bigint").alias("position"), "id")


@query("q_place_form", sql=f"""
SELECT CAST(position AS BIGINT) AS position, source, {sqlx.place_form('remote', 'city')} AS place_form
FROM {{{{offers_ev}}}}
""")
def q_place_form(spark, sf):
    from jobtide.functions.tracker import place_form
    return adapter(spark, sf, "offers_ev").select(F.col("position").cast("bigint").alias("position"), "source",
                                                  place_form("remote", "city").alias("place_form"))


@query("q_salary_text", sql=f"""
SELECT CAST(position AS BIGINT) AS position,
       {sqlx.salary_text('salary_from', 'salary_to', 'salary_currency')} AS salary
FROM {{{{offers_ev}}}}
""")
def q_salary_text(spark, sf):
    from jobtide.functions.salary import salary_text
    return adapter(spark, sf, "offers_ev").select(
        F.col("position").cast("bigint").alias("position"),
        salary_text("salary_from", "salary_to", "salary_currency").alias("salary"))


@query("q_with_description", sql=f"""
SELECT run_id, CAST(count(*) AS BIGINT) AS offers,
       CAST(count(*) FILTER (WHERE length({sqlx.js_trim('description')}) > 0) AS BIGINT) AS with_description
FROM ({RUN_DEDUP_SQL}) GROUP BY run_id
""")
def q_with_description(spark, sf):
    from jobtide.operators.status import with_description
    return with_description(dedup_run(adapter(spark, sf, "offers_ev")))
