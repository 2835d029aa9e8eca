"""The stage that reads detail responses: each content parsed once, flags written beside the texts, few passes over a text."""

import json

import pytest
from pyspark.sql import functions as F

from jobtide.functions.common import js_trim
from jobtide.functions.detail import content_stages, with_detail_fields
from jobtide.functions.html import PROFILES, decode_entities, html_to_text
from jobtide.operators import enrich as EN
from jobtide.plans.run import run_details
from jobtide.schema import DESC_CACHE

DETAIL = "run_id string, source string, position long, url string, status int, body string, error string"


def one(spark, c, x):
    return spark.createDataFrame([(x,)], "x string").select(c.alias("y")).first()["y"]


def test_flags_are_read_without_the_texts(spark, monkeypatch):
    plain, seen = EN.attach_responses, []

    def spy(offers, details, *rest):
        seen.append(details.select("run_id", "nonempty")._jdf.queryExecution().executedPlan().toString())
        return plain(offers, details, *rest)
    monkeypatch.setattr(EN, "attach_responses", spy)
    u = "https://x-ID{}.html".format
    bodies = [json.dumps({"data": {"description": d}}) for d in ("<p>A</p>", "<p> </p>")] + ["captcha"]
    details = spark.createDataFrame([("R", "olx", i, u(100_000 + i), 200, b, None) for i, b in enumerate(bodies)], DETAIL)
    offers = details.select("run_id", "source", "position", "url", F.lit(None).cast("string").alias("description"))
    out = run_details(offers, details, spark.createDataFrame([], DESC_CACHE), "olx")["offers"]
    assert seen and "ReadSchema" in seen[0] and "_det" not in seen[0]
    assert {r.position: r.description for r in out.collect()} == {0: "A", 1: None, 2: None}


@pytest.mark.parametrize("source", PROFILES)
def test_a_content_is_parsed_once(spark, source):
    d = spark.createDataFrame([("x",)], "body string")
    for stage in content_stages("body", source):
        d = d.withColumns(stage)
    d = with_detail_fields(d, "body", source, "f", content="_dv").select("f", F.col("_dv").isNotNull().alias("parsed"))
    plan = d._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1


@pytest.mark.parametrize("text,want", [
    (" \t a b﻿\n", "a b"), ("a  ", "a  "), ("a \u0085", "a \u0085"), (" \n ", ""), (None, None)])
def test_trim_looks_at_the_ends(spark, text, want):
    assert one(spark, js_trim("x"), text) == want


@pytest.mark.parametrize("text,want", [
    ("a &lt;b&gt; &amp;lt; AT&T && &", "a <b> &lt; AT&T && &"), ("&CounterClockwiseContourIntegral;&copyx&bogus;&#380;&#x142;", "∳©x&bogus;żł"),
    ("&NotGreaterEqual;", "≱")])
def test_entities(spark, text, want):
    assert one(spark, decode_entities("x"), text) == want


@pytest.mark.parametrize("text,olx,rocketjobs", [
    ("1 < 2 <b>x</b><BR/>y</P>z<li class='q'>k", "1 < 2 x\ny\nz- k", "1 < 2 x\ny\nz\n- k"),
    ("<<br>p>q", "<\np>q", "<\np>q"),                                   # no tag comes of what a tag leaves
    ("a<i b<br>c</p>d", "a<i b\nc\nd", "a<i b\nc\nd"),                  # a '<' inside what may be a tag
    ("a<script>x<br>y</SCRIPT>b<!-- <p> -->c", "abc", "abc"),
    ("<h2>Opis: </h2>a  b</p> \n \n\n\nc", "Opis:\na  b\n\nc", "OPIS:\na b\n\nc"),
    ("a</p >b</p", "ab</p", "ab</p")])
def test_tags_in_one_pass(spark, text, olx, rocketjobs):
    assert [one(spark, html_to_text("x", p), text) for p in ("olx", "rocketjobs")] == [olx, rocketjobs]
