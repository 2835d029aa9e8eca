"""End-to-end runs on small landed fixtures."""

import datetime as dt
import json
import os

from jobtide.plans.run import run_details, run_list, run_writer
from jobtide.schema import DESC_CACHE


def test_run_writer(spark, tmp):
    d = os.path.join(tmp, "collect")
    os.makedirs(d)
    files = {
        "indeed.json": {"source": "indeed", "count": 2, "offers": [
            {"source": "indeed", "title": "A", "url": "https://pl.indeed.com/viewjob?jk=a1", "salary_from": 4500.0},
            {"source": "indeed", "title": "B", "url": "https://pl.indeed.com/viewjob?jk=b2", "remote": True}]},
        "olx.json": {"source": "olx", "count": 2, "offers": [
            {"title": "C", "url": "https://www.olx.pl/oferta/c-ID123456.html?x=1", "city": "Wrocław"},
            {"title": "D", "url": "https://www.olx.pl/oferta/c-ID123456.html", "description": "opis"}]},
    }
    for n, doc in files.items():
        with open(os.path.join(d, n), "w") as f:
            json.dump(doc, f)
    out = os.path.join(tmp, "out")
    r = run_writer(spark, d, dt.datetime(2024, 5, 1, 8, 0), out=out)
    rows = sorted((x["id"], x["title"], x["source_name"], x["salary"], x["place_form"]) for x in r["tracker"].collect())
    assert rows == [(1, "A", "Indeed", "4500", "Niejasne"), (2, "B", "Indeed", "", "Zdalnie"),
                    (3, "C", "OLX", "", "Biuro - Wrocław")]
    assert spark.read.parquet(os.path.join(out, "tracker")).count() == 3
    assert r["summary"].first()["offers"] == 3
    assert r["file_stamp"].first()["stamp"] == "2024-05-01_10-00"


def test_run_list_indeed_cards(spark):
    cards = [json.dumps(c) for c in [
        {"title": "Junior Analyst", "href": "/rc/clk?jk=abc123&from=x", "loc": "52-407 Wrocław", "salaryText": "od 6000 zł",
         "metaText": "Umowa o pracę", "cardText": "praca zdalna"},
        {"title": "Junior Analyst", "jk": "abc123"},
        {"title": "", "jk": ""},
    ]]
    landing = spark.createDataFrame([("R1", 1, i, c) for i, c in enumerate(cards)],
                                    "run_id string, page_no int, position long, payload string")
    got = run_list(landing, "indeed").collect()
    assert len(got) == 1
    g = got[0]
    assert (g["url"], g["city"], g["salary_from"], g["contract_type"], g["experience_level"], g["remote"]) == (
        "https://pl.indeed.com/viewjob?jk=abc123", "Wrocław", 6000.0, "umowa o pracę", "junior", True)


def test_run_details(spark):
    offers = spark.createDataFrame([("R1", "justjoin", i, f"https://justjoin.it/job-offer/{k}", None)
                                    for i, k in enumerate(["a", "b", "a", "c", "d"], start=1)],
                                   "run_id string, source string, position long, url string, description string")
    def page(desc):
        ld = json.dumps({"@type": "JobPosting", "description": desc})
        return ('<html><script type="application/ld+json">' + ld + '</script>'
                '<script>self.__next_f.push([1,"{\\"requiredSkills\\":[{\\"name\\":\\"SQL\\",\\"level\\":3}]}"])</script></html>')
    details = spark.createDataFrame([
        ("R1", "justjoin", 1, "u", 200, page("<p>Opis A</p>"), None),
        ("R1", "justjoin", 2, "u", 200, page("<p>cached?</p>"), None),
        ("R1", "justjoin", 4, "u", 403, "denied", None),
        ("R1", "justjoin", 5, "u", 200, page("<p>never</p>"), None)],
        "run_id string, source string, position long, url string, status int, body string, error string")
    cache = spark.createDataFrame([("https://justjoin.it/job-offer/b", dt.datetime(2024, 1, 1),
                                    ("z cache", *[None] * 11))], DESC_CACHE)
    r = run_details(offers, details, cache, "justjoin", now=dt.datetime(2024, 2, 1))
    rows = r["offers"].collect()
    got = {x["position"]: (x["description"], x["detail_error"]) for x in rows}
    assert got == {1: ("Opis A", None), 2: ("z cache", None), 3: ("Opis A", None),
                   4: (None, "http 403"), 5: (None, None)}
    skills = {x["position"]: x["skills_required"] for x in rows}
    assert skills[1] == ["SQL (level 3)"] and skills[3] == ["SQL (level 3)"] and skills[2] is None
    st = r["status"].first()
    assert (st["details_fetched"], st["details_cached"], st["detail_errors"], st["detail_aborted"]) == (1, 2, 1, True)
    keys = sorted(x["url_key"] for x in r["cache"].collect())
    assert keys == ["https://justjoin.it/job-offer/a", "https://justjoin.it/job-offer/b"]


def test_two_runs_in_one_minute_keep_apart_and_repeat(spark, tmp):
    d, out = os.path.join(tmp, "collect"), os.path.join(tmp, "out")
    os.makedirs(d)
    for n in ("a", "b"):      # two files of one source: equal (source, position)
        with open(os.path.join(d, f"{n}.json"), "w") as f:
            json.dump({"source": "olx", "count": 1, "offers": [{"title": n, "url": f"https://x.pl/{n}"}]}, f)
    first, second = dt.datetime(2024, 1, 31, 8, 0, 1), dt.datetime(2024, 1, 31, 8, 0, 9)
    for start in (first, second, second, first):
        run_writer(spark, d, start, out=out)
    rows = spark.read.parquet(f"{out}/tracker")
    assert {r["run_tab"]: r["count"] for r in rows.groupBy("run_tab").count().collect()} == {
        "31.01.2024 09-00": 2, "31.01.2024 09-00 (2)": 2}
    assert sorted(os.listdir(f"{out}/full")) == ["2024-01-31_09-00", "2024-01-31_09-00_2"]
    assert sorted(r.id for r in rows.where("run_tab = '31.01.2024 09-00'").collect()) == [1, 2]


def test_latest_run_by_time_across_a_month_end(spark):
    from jobtide.sinks.export import latest_rows
    h = spark.createDataFrame([("31.01.2024 10-00",), ("01.02.2024 09-00",), ("01.02.2024 09-00 (2)",), ("12.11.2023 08-00",)],
                              "run_tab string")
    assert [r.run_tab for r in latest_rows(h).collect()] == ["01.02.2024 09-00 (2)"]


def test_run_list_keeps_every_landed_offer(spark):
    pages = [("R", p, p, json.dumps({"data": [{"title": f"t{p}-{i}", "slug": f"s{p}-{i}", "companyName": "c"}
                                              for i in range(500)]})) for p in range(1, 11)]
    landing = spark.createDataFrame(pages, "run_id string, page_no int, position long, payload string")
    got = run_list(landing, "justjoin")
    assert got.count() == 5000 and got.select("position").distinct().count() == 5000


def test_cached_offer_returns_all_fields_and_ids_are_checked(spark):
    offers = spark.createDataFrame([("R", "olx", 1, "https://www.olx.pl/oferta/praca/a-CID4-ID123456.html", None, 8000.0),
                                    ("R", "olx", 2, "https://www.olx.pl/oferta/praca/none.html", None, None)],
                                   "run_id string, source string, position long, url string, salary_from double, salary_to double")
    details = spark.createDataFrame([], "run_id string, source string, position long, url string, status int, "
                                        "body string, error string")
    key = "https://www.olx.pl/oferta/praca/a-cid4-id123456.html"
    f = ("opis", None, None, None, None, None, "Firma", "umowa o pracę", "junior", 5000.0, 9000.0, "PLN")
    cache = spark.createDataFrame([(key, dt.datetime(2024, 1, 1), f)], DESC_CACHE)
    rows = {r.position: r for r in run_details(offers, details, cache, "olx")["offers"].collect()}
    assert (rows[1].company, rows[1].contract_type, rows[1].experience_level) == ("Firma", "umowa o pracę", "junior")
    assert (rows[1].salary_from, rows[1].salary_to, rows[1].salary_currency) == (5000.0, 8000.0, "PLN")
    assert rows[2].detail_error == "no ad id on card"


def test_corrupt_files_are_reported(spark, tmp):
    for name, text in (("good", '{"source": "olx", "offers": [{"title": "a", "url": "https://x.pl/a"}]}'),
                       ("bad", "{not json"), ("none", '{"source": "olx"}')):
        with open(os.path.join(tmp, f"{name}.json"), "w") as f:
            f.write(text)
    r = run_writer(spark, tmp, dt.datetime(2024, 5, 1, 8, 0))
    assert r["offers"].count() == 1
    assert {os.path.basename(x.file): x.reason for x in r["quarantine"].collect()} == {
        "bad.json": "not json", "none.json": "no offers array"}
