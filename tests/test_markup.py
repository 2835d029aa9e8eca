"""HTML as a parser reads it (A9, A11) and the search for postings in unknown payloads (A3)."""

import json

import pytest
from pyspark.sql import functions as F

from jobtide.functions.markup import attribute, links, raw_content, raw_elements, tokens
from jobtide.functions.variant_search import find_postings
from jobtide.sources.landing import ingest_items, ingest_postings, quarantine_payloads
from jobtide.sources.pages import harvest_links, harvest_offers, ingest_embedded


def one(spark, html, expr):
    return spark.createDataFrame([(html,)], "html string").select(expr.alias("x")).first()["x"]


PAGE = """<!DOCTYPE html><html><head><title>a <a href="/job/title">no</a></title>
<script>var x = '<a href="/job/script">no</a>';</script><style>a > b { }</style></head><body>
<!-- <a href="/job/comment">no</a> -- > still --><!--><a href="/job/first">One</a>
<a class=x href='/job/single'>Two</a><A data-href="/job/data" HREF=/job/bare>Th<b>re</b>e</A>
<a data-href="/job/only">no href</a><a href="/job/q" title="a > b">Four &amp; more</a>
<a href="/job/h"><span>Acme</span><h3 class="t">Tester <i>QA</i></h3> 5 000 zł</a>
<a href="/job/cy"><div data-cy="job title here"> Junior </div>x</a>
<a href="/job/open">Five<a href="/job/next">Six</a> tail
<a href="/job/first" href="/job/second">again</a><a href = "/job/a&amp;b" >Seven</a><a href>Eight</a>
<textarea><a href="/job/area">no</a></textarea><template><a href="/job/tpl">no</a></template>
1 < 2 <a href="/job/it's">Nine</a><a href=/job/x'y>Ten</a><a href="/job/broken" """

LINKS = [("/job/first", "One", None), ("/job/single", "Two", None), ("/job/bare", "Three", None), ("/job/q", "Four & more", None),
         ("/job/h", "AcmeTester QA 5 000 zł", "Tester QA"), ("/job/cy", "Junior x", "Junior"), ("/job/open", "Five", None),
         ("/job/next", "Six", None), ("/job/first", "again", None), ("/job/a&b", "Seven", None), ("", "Eight", None),
         ("/job/it's", "Nine", None), ("/job/x'y", "Ten", None)]


def test_links_as_a_parser_sees_them(spark):
    got = one(spark, PAGE, links("html", ("h3",), ("data-cy", "title")))
    assert [(x.href, x.text, x.heading) for x in got] == LINKS


def test_tokens_are_the_whole_text(spark):
    for html in (PAGE, "", "<", "a<b", "<!-- open", "<script>x", "</", "<a href='x", "<?php x ?>", "<a\x01b>c\x02</a>", "a" * 100_000,
                 "<p " + "x=1 " * 900 + ">t"):
        assert "".join(one(spark, html, tokens("html"))) == html
    assert one(spark, None, tokens("html")) is None and one(spark, None, links("html")) is None


@pytest.mark.parametrize("tag,value", [
    ('<a href="x">', "x"), ("<a href='x y'>", "x y"), ("<a href=x>", "x"), ("<a href = x >", "x"), ("<a HREF=x/y>", "x/y"),
    ("<a data-href=z href=x>", "x"), ("<a href=x href=y>", "x"), ("<a/href=x>", "x"), ("<a href>", ""), ("<a href= >", ""),
    ('<a title="href=no">', None), ('<a href="a&quot;b">', 'a"b'), ('<a x="1>2" href=y>', "y"), ("<a>", None), ("text", None)])
def test_attributes(spark, tag, value):
    assert one(spark, tag, attribute(F.col("html"), "href")) == value


def test_offers_by_source_rules(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<a href='/x,oferta,1'><h2>Dev</h2>Acme</a><a href=/x,oferta,2>QA</a>"), (3, None)],
                                  "page_id long, html string")
    got = harvest_offers(pages, "nofluffjobs").where("page_id = 1").orderBy("link_pos").collect()
    want = {}
    for href, text, heading in LINKS:
        if "/job/" in href:
            want.setdefault(href, heading or text)
    assert [(r.href, r.text) for r in got] == list(want.items())
    assert [(r.page_id, r.href, r.text) for r in harvest_offers(pages, "pracuj").orderBy("href").collect()] == [
        (2, "/x,oferta,1", "Dev"), (2, "/x,oferta,2", "QA")]
    assert harvest_links(pages, "/x,").select("text").first()["text"] == "DevAcme"


BLOB = '{"deep": {"list": [{"title": "A", "url": "/a"}, {"title": "B", "name": null}]}}'


def test_embedded_blobs(spark):
    cases = {1: f"<script type=application/json>{BLOB}</script>", 2: f'<!-- <script type="application/json">{BLOB}</script> -->',
             3: f"<SCRIPT async TYPE='Application/LD+JSON' id=x>\n {BLOB} </SCRIPT>", 4: f'<script type="text/x">{BLOB}</script>',
             5: f'<script type="application/json">{{"postings": [], "a": 1234567890}}</script><script type="application/json">{BLOB}</script>',
             6: f'<script data-type="application/json">{BLOB}</script>', 7: '<script type="application/json">[{"a":1}]</script>'}
    pages = spark.createDataFrame(list(cases.items()), "page_id long, html string")
    got = ingest_embedded(pages).select("page_id", "item_pos", F.try_variant_get("item", "$.title", "string").alias("t")).collect()
    assert sorted(tuple(r) for r in got) == [(p, i, t) for p in (1, 3, 5) for i, t in ((0, "A"), (1, "B"))]
    raw = one(spark, cases[3], F.transform(raw_elements("html", "script"), raw_content))
    assert [x.strip() for x in raw] == [BLOB]


def breadth_first(root):
    """The walk over parsed JSON; members by name, as VARIANT keeps them."""
    queue = [root]
    while queue:
        cur = queue.pop(0)
        if isinstance(cur, list):
            if cur and all(isinstance(x, dict) and "title" in x and ("name" in x or "url" in x) for x in cur):
                return cur
            queue += cur
        elif isinstance(cur, dict):
            if isinstance(cur.get("postings"), list):
                return cur["postings"]
            queue += [cur[k] for k in sorted(cur)]
    return None


T = [{"title": "t", "url": "u"}]
PAYLOADS = [
    {"postings": [{"id": 1}]}, {"postings": []}, {"data": [{"id": 1}, {"id": 2}], "list": T}, {"a": {"b": {"c": [{"x": T}]}}},
    {"a": [T, [T + T]]}, [T], T, {"x": {"postings": [1, 2]}, "y": T}, {"y": [{"title": "t"}], "z": [{"title": None, "name": None}]},
    {"a": [{"title": "t", "url": "u"}, 5], "b": [[], {}, "postings", None, True, 1.5]}, {"postings": "no", "more": {"postings": {"k": T}}},
    {"a": {"postings": T + T}, "b": T}, [], {}, 7, "text", None, {"a": "[{\"title\":1,\"url\":2}]"}, {"": T}, {"a.b": {"$[0]": T}},
    json.loads('{"l":' * 60 + json.dumps(T) + "}" * 60)]


def test_postings_anywhere(spark):
    rows = [(i, json.dumps(p)) for i, p in enumerate(PAYLOADS)] + [(100, "{broken"), (101, ""), (102, None)]
    df = spark.createDataFrame(rows, "k long, payload string")
    got = {r.k: r.x for r in df.select("k", F.to_json(find_postings(F.col("payload"))).alias("x")).collect()}
    for i, p in enumerate(PAYLOADS):
        want = breadth_first(p)
        assert (None if got[i] is None else json.loads(got[i])) == want, p
    assert got[100] is got[101] is got[102] is None
    n = {r.k: r["count"] for r in ingest_postings(df).groupBy("k").count().collect()}
    assert n == {i: len(breadth_first(p)) for i, p in enumerate(PAYLOADS) if breadth_first(p)}
    bad = {r.k: r.reason for r in quarantine_payloads(df).collect()}
    assert bad[100] == "not json" and bad[101] == bad[102] == "no payload" and bad[1] == "no postings" and not set(n) & set(bad)


def test_items_at_the_paths_of_an_envelope(spark):
    df = spark.createDataFrame([(1, '{"json": {"data": [1, 2]}}'), (2, '{"result": {"data": []}, "items": [3]}'), (3, "{}")],
                               "k long, payload string")
    assert sorted((r.k, r.item_pos) for r in ingest_items(df).collect()) == [(1, 0), (1, 1), (2, 0)]
