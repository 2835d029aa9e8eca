"""Hand-derived fixture values (FIXTURES.md §2) for the column functions."""

import pytest
from pyspark.sql import functions as F

from jobtide.functions import classify as C
from jobtide.functions.dates import date_or_raw, epoch_to_iso, run_file_stamp, run_tab_stamp
from jobtide.functions.html import html_to_text
from jobtide.functions.salary import parse_salary, salary_text
from jobtide.functions.text import clean_city, compose_sections, format_skills, slug, split_place_date
from jobtide.functions.tracker import place_form, source_display
from jobtide.functions.urls import identity_key, url_key

NB = "\u00a0"


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("url,key", [
    ("https://X.pl/A//?q=1", "https://x.pl/a"),
    ("https://x.pl/a#top", "https://x.pl/a#top"),
    ("https://x.pl/a/#top", "https://x.pl/a/#top"),
    ("https://pl.indeed.com/viewjob?jk=ab1", "https://pl.indeed.com/viewjob"),
    (None, ""),
])
def test_url_key(spark, url, key):
    assert one(spark, url_key("x"), url) == key


def test_identity_key_indeed(spark):
    df = spark.createDataFrame([("indeed", "https://pl.indeed.com/viewjob?jk=ab1"),
                                ("olx", "https://pl.indeed.com/viewjob?jk=ab1")], "s string, u string")
    got = [r[0] for r in df.select(identity_key("u", "s")).collect()]
    assert got == ["https://pl.indeed.com/viewjob?jk=ab1", "https://pl.indeed.com/viewjob"]


@pytest.mark.parametrize("dialect,text,expected", [
    ("olx", f"4{NB}000 - 5{NB}000 zł / mies.", (4000.0, 5000.0, "PLN")),
    ("olx", "4.500 zł", (4.5, None, "PLN")),
    ("olx", "15,50 zł/godz.", (15.5, None, "PLN")),
    ("olx", "3 000 4 000 zł", (30004000.0, None, "PLN")),
    ("olx", "Do negocjacji", (None, None, None)),
    ("indeed", f"5{NB}000 zł – 7{NB}000 zł", (5000.0, 7000.0, "PLN")),
    ("indeed", "od 6000 zł", (6000.0, None, "PLN")),
    ("indeed", "do 8 000 PLN", (None, 8000.0, "PLN")),
    ("indeed", "30 zł za godzinę", (None, None, None)),
    ("indeed", "40 godz.", (None, None, None)),
    ("indeed", "1.500,50 zł", (1500.0, None, "PLN")),
    ("pracuj", "5 000–7 000 zł / mies.", (5000.0, 7000.0, "PLN")),
    ("pracuj", "30,50–45 zł/godz.", (30.0, 50.0, "PLN")),
    ("pracuj", "wynagrodzenie w zł", (None, None, "PLN")),
    ("theprotocol", "160 - 200 zł/h", (160.0, 200.0, "PLN")),
    ("theprotocol", "12,5 k zł", (12.0, 5.0, "PLN")),
    ("theprotocol", f"20{NB}000 USD", (20000.0, None, "USD")),
])
def test_salary_dialects(spark, dialect, text, expected):
    r = one(spark, parse_salary("x", dialect), text)
    assert (r["salary_from"], r["salary_to"], r["salary_currency"]) == expected


@pytest.mark.parametrize("text,contract,sen,entry", [
    ("Umowa o pracę, B2B", "umowa o pracę", None, False),
    ("Junior Data Analyst (staż)", "staż", "junior", True),
    ("Stażysta", "staż", "intern", True),
    ("Team Lead, Senior", None, "senior", False),
    ("STAŻ w dziale IT", "staż", "intern", True),
])
def test_classifiers(spark, text, contract, sen, entry):
    df = spark.createDataFrame([(text,)], "x string")
    r = df.select(C.contract_type("x").alias("c"), C.seniority("x").alias("s"), C.entry_level("x").alias("e")).first()
    assert (r["c"], r["s"], r["e"]) == (contract, sen, entry)


def test_slug_city_place(spark):
    assert one(spark, slug("x", "dash"), "Łódź Górna!") == "lodz-gorna"
    assert one(spark, slug("x", "spaces"), "Nowy Sącz") == "nowy-sacz"
    assert one(spark, slug("x", "trim"), " Nowy Sącz ") == "nowy sacz"
    assert one(spark, slug("x", "fold"), "Nowy Sącz") == "nowy sacz"
    assert one(spark, clean_city("x", "postal"), "52-407 Wrocław") == "Wrocław"
    assert one(spark, clean_city("x", "first_part"), "Kraków, Warszawa") == "Kraków"
    assert one(spark, clean_city("x", "before_dash"), "Wrocław - Krzyki - dzisiaj") == "Wrocław"
    assert one(spark, split_place_date("x"), "Wrocław - Krzyki - dzisiaj") == "Krzyki - dzisiaj"


def test_label_pick_and_remote(spark):
    df = spark.createDataFrame([(["Pełny etat", "umowa o pracę", "kontrakt B2B"],), (["praca zdalna"],),
                                (["praca stacjonarna"],), (["hybrydowa"],)], "l array<string>")
    got = df.select(C.pick_label("l", C.CONTRACT_LABEL_RE).alias("c"), C.infer_remote("labels", F.col("l")).alias("r")).collect()
    assert got[0]["c"] == "umowa o pracę"
    assert [g["r"] for g in got[1:]] == [True, False, None]


def test_dates(spark):
    df = spark.createDataFrame([("1714557600000",), ("1714557600",), ("x",)], "x string")
    assert [r[0] for r in df.select(epoch_to_iso("x")).collect()] == [
        "2024-05-01T10:00:00.000Z", "2024-05-01T10:00:00.000Z", None]
    assert one(spark, date_or_raw("x"), "2024-03-05") == "2024-03-05T00:00:00.000Z"
    assert one(spark, date_or_raw("x"), "wczoraj") == "wczoraj"
    ts = spark.createDataFrame([("2024-07-01 08:05:00",)], "x string").select(F.col("x").cast("timestamp").alias("t"))
    r = ts.select(run_tab_stamp("t").alias("a"), run_file_stamp("t").alias("b")).first()
    assert (r["a"], r["b"]) == ("01.07.2024 10-05", "2024-07-01_10-05")


def test_html_profiles(spark):
    assert one(spark, html_to_text("x", "rocketjobs"), "<h2>Opis: </h2><p>A&amp;B</p><ul><li>x</li></ul>") == "OPIS:\nA&B\n\n- x"
    assert one(spark, html_to_text("x", "olx"), "a<br>b<ul><li>c</li><li>d</li></ul>") == "a\nb- c\n- d"
    assert one(spark, html_to_text("x", "justjoin"), "<p>x &#380;&#x142;</p><script>var a=1</script>") == "x żł"
    assert one(spark, html_to_text("x", "nofluffjobs"), "  plain text  ") == "plain text"


def test_sections_and_skills(spark):
    df = spark.createDataFrame([("D", ["SQL"], [], [], [], [], ["Kawa"])],
                               "d string, m array<string>, l array<string>, n array<string>, t array<string>, "
                               "r array<string>, b array<string>")
    got = df.select(compose_sections("d", "m", "l", "n", "t", "r", "b")).first()[0]
    assert got == "OPIS:\nD\n\nWYMAGANIA:\n- SQL\n\nBENEFITY:\n- Kawa"
    sk = spark.createDataFrame([([("SQL", 3), ("Git", None)],)], "s array<struct<name:string,level:bigint>>")
    assert sk.select(format_skills("s")).first()[0] == ["SQL (level 3)", "Git"]


def test_salary_text_place_form_display(spark):
    df = spark.createDataFrame([(4500.0, 6000.0, "PLN", True, "Opole", "olx"),
                                (None, 7000.0, None, False, "Wrocław", "nope"),
                                (None, None, None, None, "Opole", None),
                                (None, None, None, None, None, "indeed")],
                               "f double, t double, c string, r boolean, city string, s string")
    got = df.select(salary_text("f", "t", "c").alias("s"), place_form("r", "city").alias("p"),
                    source_display("s").alias("d")).collect()
    assert [g["s"] for g in got] == ["4500–6000 PLN", "7000", "", ""]
    assert [g["p"] for g in got] == ["Zdalnie", "Biuro - Wrocław", "Biuro - poza Wrocławiem", "Niejasne"]
    assert [g["d"] for g in got] == ["OLX", "nope", "", "Indeed"]


def test_block_flag_searches_the_whole_body(spark):
    body = "x" * 7000 + " captcha"
    df = spark.createDataFrame([(body, 200), ("ok", 429), ("fine", 200)], "b string, s int")
    got = df.select(C.block_flag("b", "s").alias("f"), C.block_mark("b").alias("m")).collect()
    assert [tuple(g) for g in got] == [(True, "captcha"), (True, None), (False, None)]


def test_block_needles_skipped_when_content_present(spark):
    page = '<script type="application/ld+json">{"@type": "JobPosting"}</script><script>captcha()</script>'
    df = spark.createDataFrame([(page, 200), ("<html>captcha</html>", 200)], "b string, s int")
    got = df.select(C.block_flag("b", "s", has_content=C.detail_has_content(F.col("b"), "justjoin"))).collect()
    assert [g[0] for g in got] == [False, True]
    js = spark.createDataFrame([('{"data": {"description": "captcha"}}', 200), ("captcha", 200)], "b string, s int")
    got = js.select(C.block_flag("b", "s", has_content=C.detail_has_content(F.col("b"), "olx"))).collect()
    assert [g[0] for g in got] == [False, True]


def test_tags_and_entities_as_a_parser_reads_them(spark):
    from jobtide.functions.html import decode_entities, dom_text, jsonld_blocks
    cases = {"wiek <3 lata, staż > 1 rok": "wiek <3 lata, staż > 1 rok", "a<b>c</b> < d <!-- x -->e": "ac < d e",
             "Kr&oacute;l &Oacute; &Lstrok;&lstrok;": "Król Ó Łł", "&amp;lt; &copy 2024 &ampx &#150;&#x41;&#65 &nope;":
             "&lt; © 2024 &x –AA &nope;", "&#0; &#xD800; &": "&#0; &#xD800; &"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.t for r in df.select("h", dom_text("h").alias("t")).collect()} == cases
    assert df.where("h like 'Kr%'").select(decode_entities("h")).first()[0] == "Król Ó Łł"
    page = """<script type='application/ld+json'>{"a": 1}</script>"""
    assert spark.createDataFrame([(page,)], "h string").select(jsonld_blocks("h")).first()[0] == ['{"a": 1}']


def test_long_texts_stay_whole(spark):
    from jobtide.functions.html import PROFILES, html_to_text
    from jobtide.functions.text import whole_text
    df = spark.createDataFrame([("<p>" + "słowo " * 5000 + "koniec</p>",)], "h string")
    got = df.select(F.length(whole_text("h")).alias("w"), *[html_to_text("h", p).alias(p) for p in PROFILES]).first()
    assert got["w"] == 30_013 and all(got[p].endswith("koniec") and len(got[p]) == 30_006 for p in PROFILES)
