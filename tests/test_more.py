"""Remaining fixture-only operators (A11, A14, A15, B5, B6, I12) and invariants."""

import json
import os

from pyspark.sql import functions as F

from jobtide.functions.text import compose_sections
from jobtide.operators.mapping import to_common
from jobtide.sinks.export import latest_rows, write_cache_version, write_status
from jobtide.sources.landing import read_run_config, read_tracker, read_cache
from jobtide.sources.pages import ingest_embedded


def test_ingest_embedded_first_blob_with_postings(spark):
    html = ('<script type="application/json">{"x": 1, "pad": "................"}</script>'
            '<script type="application/json">{"postings": [{"title": "A", "url": "/pl/job/a"}, '
            '{"title": "B", "name": "Acme", "slug": "b"}]}</script>'
            '<script type="application/ld+json">{"postings": [{"title": "C", "url": "c"}]}</script>')
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id long, html string")
    items = ingest_embedded(pages).withColumnRenamed("item_pos", "position")
    got = to_common(items, "nofluffjobs", keep=("page_id", "position")).orderBy("position").collect()
    assert [(r["title"], r["url"], r["company"]) for r in got] == [
        ("A", "https://nofluffjobs.com/pl/job/a", None), ("B", "https://nofluffjobs.com/pl/job/b", "Acme")]


def test_tasks_fallback_daily_tasks_first(spark):
    df = spark.createDataFrame([(["t1"], ["r1"]), ([], ["r1"])], "d array<string>, r array<string>")
    e = F.array().cast("array<string>")
    got = [x[0] for x in df.select(compose_sections(F.lit(None).cast("string"), e, e, e, "d", "r", e)).collect()]
    assert got == ["OBOWIĄZKI:\n- t1", "OBOWIĄZKI:\n- r1"]


def test_state_tables_missing_are_empty(spark, tmp):
    assert read_cache(spark, os.path.join(tmp, "nope")).count() == 0
    assert read_tracker(spark, os.path.join(tmp, "nope")).count() == 0


def test_run_config(spark, tmp):
    p = os.path.join(tmp, "cfg.json")
    with open(p, "w") as f:
        json.dump({"keyword": "staż", "category": "internship", "location": "Wrocław", "radius": 30,
                   "urls": {"justjoin": "https://justjoin.it/job-offers/wroclaw?employment-types=internship", "olx": ""},
                   "collectDir": "/x", "descCache": "/y"}, f, indent=1)
    r = read_run_config(spark, p).first()
    assert r["location"] == "Wrocław" and r["urls"]["olx"] == "" and r["radius"] == 30


def test_cache_versions_and_status(spark, tmp):
    c = spark.createDataFrame([("k", "d")], "url_key string, description string")
    v1 = write_cache_version(c, os.path.join(tmp, "cache"), "1")
    try:
        write_cache_version(c, os.path.join(tmp, "cache"), "1")
        raise AssertionError("a version must never be overwritten")
    except Exception as e:  # noqa: BLE001
        assert "already exists" in str(e).lower() or "path" in str(e).lower()
    assert spark.read.parquet(v1).count() == 1
    st = spark.createDataFrame([("R1", "olx", 3)], "run_id string, source string, count long")
    write_status(st, os.path.join(tmp, "status"))
    write_status(st.withColumn("run_id", F.lit("R2")), os.path.join(tmp, "status"))
    assert spark.read.parquet(os.path.join(tmp, "status")).count() == 2


def test_latest_rows(spark):
    h = spark.createDataFrame([("31.01.2024 10-00", 1), ("01.02.2024 09-00", 2), ("01.02.2024 09-00", 3)],
                              "run_tab string, id long")
    assert sorted(r["id"] for r in latest_rows(h).collect()) == [2, 3]


def test_partition_count_does_not_change_results(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    q = E.queries()
    names = ["q_dedup_run", "q_tracker", "q_run_status", "q_cache_upsert", "q_page_yield"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    res = {}
    for n_parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n_parts)
        res[n_parts] = {n: sorted(map(tuple, q[n](spark, sf).collect()), key=repr) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert res["1"] == res["13"]


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    q = E.queries()
    s = q["q_stream_collect"](spark, sf)
    b = q["q_salary_text"](spark, sf)
    assert s.count() == b.count()
    assert sorted(r[0] for r in s.select("salary").collect()) == sorted(r[0] for r in b.select("salary").collect())


def test_queries_are_repeatable_in_one_session(spark):
    import __spark_entry__ as E
    q = E.queries()
    for name in ("q_stream_collect", "q_tracker", "q_consec_fail"):
        a = q[name](spark, "/root/testdata/sf0.001").count()
        b = q[name](spark, "/root/testdata/sf0.001").count()
        assert a == b > 0


def test_status_counters_bounded_and_keys_unique(spark):
    import __spark_entry__ as E
    q = E.queries()
    st = q["q_run_status"](spark, "/root/testdata/sf0.001")
    assert st.where("details_fetched + details_cached + detail_errors > count").count() == 0
    d = q["q_dedup_run"](spark, "/root/testdata/sf0.001")
    assert d.count() == d.select("run_id", "url_key").distinct().count()


def test_prune_and_upsert_commute_on_disjoint_keys(spark):
    import datetime as dt
    from jobtide.operators.cache import cache_prune, cache_upsert
    now = dt.datetime(2024, 3, 1)
    old = spark.createDataFrame([("a", dt.datetime(2023, 1, 1), "x"), ("b", dt.datetime(2024, 2, 20), "y")],
                                "url_key string, fetched_at timestamp_ntz, description string")
    new = spark.createDataFrame([("c", dt.datetime(2024, 2, 28), "z")],
                                "url_key string, fetched_at timestamp_ntz, description string")
    one = cache_upsert(cache_prune(old, now, 60), new)
    two = cache_prune(cache_upsert(old, new), now, 60)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_adapters_are_not_vacuous(spark):
    """Filters drop some rows and keep others; merges change some rows; cuts hit some sources."""
    import __spark_entry__ as E
    q, sf = E.queries(), "/root/testdata/sf0.01"
    n_events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert 0 < q["q_require"](spark, sf).count() < n_events
    assert q["q_cap_per_source"](spark, sf).where("beyond > 0").count() > 0
    assert 0 < q["q_source_filters"](spark, sf).count() < n_events
    cut = q["q_abort_cut"](spark, sf)
    assert 0 < cut.where("aborted").count() < cut.count() or cut.where("aborted").count() > 0
    fill = q["q_merge_fill"](spark, sf)
    assert fill.where("salary_from = 5000.0").count() > 0 and fill.where("salary_from <> 5000.0").count() > 0
    cons = q["q_consec_fail"](spark, sf)
    assert 0 < cons.where("cut_consecutive IS NOT NULL").count() < cons.count()


def test_late_and_replayed_rows_lose_nothing(spark, tmp):
    """J2 and J3 over several batches: a row that comes months late is judged like any other."""
    import datetime as dt
    from pyspark.sql import functions as F
    from jobtide.streaming import pipeline as SP
    rows = [("R", "olx", i, f"https://x.pl/{i % 40}", dt.datetime(2024, 6, 1) - dt.timedelta(days=3 * i)) for i in range(120)]
    o = spark.createDataFrame(rows, "run_id string, source string, position long, url string, landed_at timestamp")
    for k in range(4):
        SP.land_json(o.where(F.col("position") % 4 == k), f"{tmp}/in/{k}", files=1)
    SP.stream_dedup(spark, f"{tmp}/in/*", o.schema, f"{tmp}/out", f"{tmp}/ck", files_per_trigger=1)
    got = spark.read.parquet(f"{tmp}/out")
    assert got.count() == got.select("identity_key").distinct().count() == 40
    c = o.select(F.col("url").alias("url_key"), F.col("landed_at").alias("fetched_at"), F.col("position").alias("event_id"),
                 F.concat(F.lit("d"), F.col("position").cast("string")).alias("description"))
    for k in range(4):
        SP.land_json(c.where(F.col("event_id") % 4 == k), f"{tmp}/cin/{k}", files=1)
    SP.stream_cache(spark, f"{tmp}/cin/*", f"{tmp}/cache", f"{tmp}/cck", ttl_days=60, files_per_trigger=1)
    live = {r.url_key: r.description for r in SP.latest_version(spark, f"{tmp}/cache", 60).collect()}
    assert live == {f"https://x.pl/{i}": f"d{i}" for i in range(21)}


def test_only_a_missing_table_is_empty(spark, tmp):
    import pytest
    from jobtide.sources.landing import read_cache
    assert read_cache(spark, f"{tmp}/none").count() == 0
    (__import__("pathlib").Path(tmp) / "bad").mkdir()
    (__import__("pathlib").Path(tmp) / "bad" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        read_cache(spark, f"{tmp}/bad").count()


def test_a_cluster_without_checkpoint_folder_is_refused():
    import pytest
    from jobtide.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
