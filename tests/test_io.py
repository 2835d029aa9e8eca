"""Sources, sinks, filters and the driver contract."""

import json
import os

from pyspark.sql import functions as F

from jobtide.operators.filters import filters_from_url
from jobtide.sinks.export import append_tracker, run_sinks, write_offers
from jobtide.sources.landing import read_collect


def test_read_collect_cases(spark, tmp):
    d = os.path.join(tmp, "collect")
    os.makedirs(d)
    docs = {
        "justjoin.json": {"source": "justjoin", "count": 2, "offers": [{"title": "A", "url": "u1"},
                                                                         {"source": "x", "title": "B", "url": "u2"}]},
        "olx.json": {"source": "olx", "count": 0, "offers": []},
        "pracuj.json": {"source": "pracuj", "count": 0},
    }
    for name, doc in docs.items():
        with open(os.path.join(d, name), "w") as f:
            json.dump(doc, f, indent=1)
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write("{bad")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        json.dump({"source": "indeed", "offers": [{"title": "C"}]}, f)
    rows = read_collect(spark, d).select("title", "_src", "position").orderBy("title").collect()
    assert [(r["title"], r["_src"], r["position"]) for r in rows] == [("A", "justjoin", 0), ("B", "x", 1)]


def test_filters_from_url(spark):
    cfg = spark.createDataFrame([("jj", "https://justjoin.it/job-offers/wroclaw?employment-types=internship,b2b"
                                        "&experience-level=junior&experience-level=mid&bad=%E0%A4%A&x")],
                                "source string, url string")
    got = sorted((r["field"], r["idx"], r["value"]) for r in filters_from_url(cfg).collect())
    assert got == [("city", 0, "wroclaw"), ("employment_type", 0, "internship"), ("employment_type", 1, "b2b"),
                   ("experience", 0, "mid")]


def test_write_offers_idempotent(spark, tmp):
    path = os.path.join(tmp, "offers")
    df = spark.createDataFrame([("R1", "olx", 1, "t"), ("R1", "indeed", 1, "u")], "run_id string, source string, position long, title string")
    write_offers(df, path)
    write_offers(df.where("source = 'olx'"), path)  # re-run of one source replaces only its partition
    assert spark.read.parquet(path).count() == 2


def test_tracker_append_and_sink_isolation(spark, tmp):
    path = os.path.join(tmp, "tracker")
    t = spark.createDataFrame([("01.05.2024 10-00", 1, "Acme")], "run_tab string, id long, company string")
    res = run_sinks(t, {"tracker": lambda d: append_tracker(d, path),
                        "broken": lambda d: (_ for _ in ()).throw(RuntimeError("x"))})
    assert res["tracker"] == "ok" and res["broken"].startswith("failed")
    append_tracker(t.withColumn("run_tab", F.lit("01.05.2024 10-00 (2)")), path)
    assert spark.read.parquet(path).select("run_tab").distinct().count() == 2


def test_entry_and_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert {q for q in E.queries() if q.startswith("q_")} == {q for q in E.oracle_sql() if q.startswith("q_")}


def test_config_filters_defaults_and_overrides(spark, tmp):
    from jobtide.operators.filters import config_filters
    from jobtide.sources.landing import read_run_config
    p = os.path.join(tmp, "cfg.json")
    with open(p, "w") as f:
        json.dump({"keyword": "staż", "category": "", "location": "Opole", "radius": 30,
                   "urls": {"justjoin": "https://justjoin.it/job-offers/wroclaw?employment-types=internship",
                            "rocketjobs": "", "olx": ""}}, f)
    got = sorted((r["source"], r["field"], r["value"]) for r in config_filters(read_run_config(spark, p)).collect())
    assert got == [("justjoin", "city", "wroclaw"), ("justjoin", "employment_type", "internship"),
                   ("rocketjobs", "city", "Opole"), ("rocketjobs", "employment_type", "internship")]
