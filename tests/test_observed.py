"""Metrics in the pass that writes, keys that must be unique, and rows without descriptions in exchanges."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from jobtide.plans.run import run_writer
from jobtide.sinks.export import export_full
from jobtide.sinks.observed import run_metrics, unique_join, write_observed


def test_metrics_of_what_was_written(spark, tmp):
    rows = spark.createDataFrame([("a", "x"), ("b", " \n"), ("c", None), ("d", "y")], "k string, description string")
    got = write_observed(rows.where("k <> 'd'"), lambda d: d.write.parquet(f"{tmp}/t"), run_metrics())
    assert got == {"offers": 3, "with_description": 1} and spark.read.parquet(f"{tmp}/t").count() == 3
    assert write_observed(rows.where("false"), lambda d: d.write.parquet(f"{tmp}/e"), run_metrics()) == {"offers": 0, "with_description": 0}


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_export_counts_what_it_writes(spark, tmp, n):
    df = spark.range(n).select(F.lit("R").alias("run_id"), F.lit("olx").alias("source"), F.col("id").alias("position"),
                               F.lit("https://x.pl/1").alias("url"), F.when(F.col("id") % 2 == 0, "d").alias("description"))
    seen = {}
    manifest = export_full(df, f"{tmp}/x", "tab", "now", seen)
    assert [r["count"] for r in manifest.collect()] == ([n] if n else [])
    assert seen["offers"] == n and seen["with_description"] == (n + 1) // 2
    two = df.unionByName(df.withColumn("run_id", F.lit("S")))
    assert sorted((r.run_id, r["count"]) for r in export_full(two, f"{tmp}/y", "tab", "now").collect()) == (
        [("R", n), ("S", n)] if n else [])


def test_unique_join(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("x", 8), ("x", 9), (None, 0)], "k string, l long")
    right = spark.createDataFrame([("a", "A"), ("b", "B"), ("z", "Z"), ("z", "Z2"), (None, "N")], "k string, r string")
    good = unique_join(left, right, "k")      # x and z repeat, but match nothing
    assert sorted(tuple(r) for r in good.collect()) == [("a", 1, "A"), ("b", 2, "B")]
    for bad in (unique_join(left, right.union(right.where("k = 'a'")), "k"), unique_join(left.union(left.where("k = 'b'")), right, "k")):
        with pytest.raises(Exception, match="k is not unique: [ab]"):
            bad.collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = good.select("*")._jdf.queryExecution().executedPlan().toString()
        initial = plan.split("Initial Plan")[-1] if "Initial Plan" in plan else plan
        assert unique_join(left, right, "k")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2, initial
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tracker_query_keeps_descriptions_out_of_exchanges(spark):
    from jobtide.plans.adapters import adapter
    from jobtide.operators.dedup import dedup_run
    d = dedup_run(adapter(spark, "/root/testdata/sf0.001", "offers_ev").drop("description"))
    assert "props" not in d._jdf.queryExecution().executedPlan().toString()


def test_writer_summary_and_whole_rows(spark, tmp):
    import os
    os.makedirs(f"{tmp}/in")
    docs = {"a.json": {"source": "olx", "offers": [{"title": "A", "url": "https://x.pl/a", "description": "long"},
                                                  {"title": "A2", "url": "https://x.pl/a?u=1", "description": "twin"}]},
            "b.json": {"source": "olx", "offers": [{"title": "B", "url": "https://x.pl/b", "description": " "}]}}
    for name, doc in docs.items():
        json.dump(doc, open(f"{tmp}/in/{name}", "w"))
    out = run_writer(spark, f"{tmp}/in", dt.datetime(2024, 5, 1, 8, 0), out=f"{tmp}/out")
    assert [(r.offers, r.with_description) for r in out["summary"].collect()] == [(2, 1)]
    assert sorted((r.title, r.description) for r in out["offers"].collect()) == [("A", "long"), ("B", " ")]
    records = [json.loads(r.value) for r in spark.read.text(f"{tmp}/out/full/*/records").collect()]
    assert sorted((r["title"], r["description"]) for r in records) == [("A", "long"), ("B", " ")]
