"""Detail responses attached by the source's id in the shipped run; content decided by what parses."""

import json

import pytest
from pyspark.sql import functions as F

from jobtide.operators.enrich import attach_responses, detail_id
from jobtide.plans.run import run_details
from jobtide.schema import DESC_CACHE

OFFER = "run_id string, source string, position long, url string, description string"
DETAIL = "run_id string, source string, position long, url string, status int, body string, error string"


@pytest.mark.parametrize("source,url,want", [
    ("talentdays", "https://talentdays.pl/praca-i-staz/dev-1/", "dev-1"), ("talentdays", "https://talentdays.pl/x", None),
    ("nofluffjobs", "https://nofluffjobs.com/pl/job/Dev-A?x=1", "dev-a"), ("olx", "https://www.olx.pl/x-ID1234567.html", "1234567"),
    ("olx", "https://www.olx.pl/x", None), ("justjoin", "https://justjoin.it/a", "https://justjoin.it/a"), ("olx", None, None)])
def test_detail_ids(spark, source, url, want):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(detail_id(source, "url").alias("x")).first()["x"] == want


def test_responses_by_id(spark):
    u = "https://nofluffjobs.com/pl/job/{}".format
    offers = spark.createDataFrame([("R", "nofluffjobs", i, x, None) for i, x in enumerate(
        [u("a"), u("b"), u("A?y=1"), u("c"), u("d"), "https://nofluffjobs.com/pl/", None])], OFFER)
    details = spark.createDataFrame([
        ("R", "nofluffjobs", 50, u("b"), 200, "for b", None), ("R", "nofluffjobs", 0, u("a"), 500, "first a", None),
        ("R", "nofluffjobs", 2, u("a"), 200, "second a", None), ("R", "nofluffjobs", 3, u("z"), 200, "another offer", None),
        ("R", "nofluffjobs", 4, None, 200, "by place", None), ("R", "nofluffjobs", 60, u("b"), 200, "a later one", None),
        ("S", "nofluffjobs", 3, u("c"), 200, "another run", None)], DETAIL)
    got = {r.position: r.body for r in attach_responses(offers, details, "nofluffjobs").collect()}
    assert got == {0: "first a", 1: "for b", 2: "second a", 3: None, 4: "by place", 5: None, 6: None}


def run(spark, source, bodies, url="https://{}.it/x/{}"):
    offers = spark.createDataFrame([("R", source, i, url.format(source, i), None) for i in range(len(bodies))], OFFER)
    details = spark.createDataFrame([("R", source, i, url.format(source, i), 200, b, None) for i, b in enumerate(bodies)], DETAIL)
    out = run_details(offers, details, spark.createDataFrame([], DESC_CACHE), source)
    return {r.position: (r.description, r.detail_error) for r in out["offers"].collect()}


def ld(x):
    return f'<script type="application/ld+json">{x}</script>'


def test_rocketjobs_needs_a_parsed_job_posting(spark):
    good = ld(json.dumps({"@type": "JobPosting", "description": "<p>A</p>"}))
    deep = ld(json.dumps({"@graph": [{"@type": "JobPosting", "description": "no"}]}))
    arr = ld("[1, " + json.dumps({"@type": "JobPosting", "description": "B"}) + "]")
    got = run(spark, "rocketjobs", [good, deep, arr, ld('{"@type": "Organization", "x": "JobPosting"}'), ld("{broken"),
                                    ld('{"@type": "Thing", "also": "JobPosting"}') + "please solve the captcha", good])
    missing = (None, "ld+json JobPosting not found")
    assert got == {0: ("A", None), 1: missing, 2: ("B", None), 3: missing, 4: missing, 5: (None, "block signal"), 6: (None, None)}


def test_justjoin_tells_broken_content_from_none(spark):
    got = run(spark, "justjoin", [ld('{"description": "A"}'), ld("{broken captcha"), "<p>nothing</p>", ld('{"title": "x"}'), "Just a moment", ld('{"description": "B"}')])
    assert got == {0: ("A", None), 1: (None, "ld+json parse: invalid JSON"), 2: (None, "ld+json not found"),
                   3: (None, "empty description"), 4: (None, "block-signal: just a moment"), 5: (None, None)}


def test_blank_keys_spread_over_tasks(spark):
    from jobtide.operators.enrich import cache_lookup
    rows = spark.range(400).select(F.lit("").alias("url_key"), "id").union(spark.createDataFrame([("k", 1000)], "url_key string, id long"))
    cache = spark.createDataFrame([("k", None, ("text", *[None] * 11))], DESC_CACHE)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = cache_lookup(rows, cache)
        assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 300
        assert out.where("cache_hit").count() == 1 and out.count() == 401
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_texts_are_not_exchanged_with_flags(spark, monkeypatch):
    from jobtide.operators import enrich as EN
    plain, seen = EN.attach_responses, []

    def spy(offers, details, *rest):
        out = plain(offers, details, *rest)
        seen.append(set(out.columns))
        return out
    monkeypatch.setattr(EN, "attach_responses", spy)
    u = "https://justjoin.it/x/{}".format
    body = [ld(json.dumps({"description": d})) for d in ("A", "B")]
    offers = spark.createDataFrame([("R", "justjoin", i, u(k), d) for i, (k, d) in enumerate(
        [("a", None), ("b", None), ("b/", None), ("c", "own"), ("d", None)])] + [("R", "justjoin", 9, None, "kept")], OFFER)
    same = [("R", "justjoin", 0, u("a"), 200, body[0], None)] * 3
    details = spark.createDataFrame(same + [("R", "justjoin", 1, u("b"), 200, body[1], None), ("R", "justjoin", 3, u("c"), 500, body[0], None)], DETAIL)
    out = run_details(offers, details, spark.createDataFrame([], DESC_CACHE), "justjoin")
    assert seen and not seen[0] & {"body", "_det"}
    assert sorted((r.position, r.description, r.detail_error) for r in out["offers"].collect()) == [
        (0, "A", None), (1, "B", None), (2, "B", None), (3, "own", "http 500"), (4, None, "no result"), (9, "kept", None)]
    assert sorted(r.f.description for r in out["cache"].collect()) == ["A", "B"]
    assert out["status"].first().asDict()["details_fetched"] == 2
