"""Plan-shape checks for the scale guarantees, and a hot-key input."""

from pyspark.sql import functions as F

from jobtide.operators.dedup import dedup_run
from jobtide.operators.numbering import number_within


def _plan(df):
    return df._jdf.queryExecution().executedPlan().treeString()


def test_dedup_is_a_partial_aggregate_not_a_window(spark):
    df = spark.range(0, 3000).select(F.lit("R").alias("run_id"), (F.col("id") % 3).cast("string").alias("source"),
                                     F.col("id").alias("position"),
                                     F.when(F.col("id") < 1000, F.lit("https://hot.pl/x")).otherwise(
                                         F.concat(F.lit("https://x.pl/"), F.col("id").cast("string"))).alias("url"))
    out = dedup_run(df)
    plan = _plan(out)
    assert "Window" not in plan
    assert "Partial" in plan or "partial_" in plan
    # A third of the rows share one key: exactly one survivor, the first in (source, position).
    hot = out.where(F.col("url") == "https://hot.pl/x").collect()
    assert len(hot) == 1 and (hot[0]["source"], hot[0]["position"]) == ("0", 0)
    assert out.count() == 1 + 2000


def test_numbering_hot_group_spans_partitions(spark):
    df = spark.range(0, 6000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id").alias("o"))
    out = number_within(df, ["g"], ["o"], "rn", partitions=6)
    stats = out.groupBy("g").agg(F.min("rn").alias("lo"), F.max("rn").alias("hi"), F.count("*").alias("n")).collect()
    assert sorted((r["g"], r["lo"], r["hi"], r["n"]) for r in stats) == [(0, 1, 4000, 4000), (1, 1, 2000, 2000)]


def test_bucketed_history_is_not_shuffled_for_the_anti_join(spark):
    from jobtide.operators.shortlist import exclude_applied
    from jobtide.sinks.export import append_tracker_table
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hist = spark.range(0, 2000).select(F.lit("T1").alias("run_tab"), F.col("id").alias("id"),
                                           F.concat(F.lit("https://x.pl/"), (F.col("id") % 500).cast("string")).alias("url"),
                                           F.when(F.col("id") % 2 == 0, "Wysłane").otherwise("Do wysłania").alias("status"))
        append_tracker_table(hist, "tracker_hist_test", buckets=8)
        t = spark.table("tracker_hist_test")
        offers = spark.range(0, 1000).select(F.concat(F.lit("https://x.pl/"), F.col("id").cast("string")).alias("identity_key"))
        out = exclude_applied(offers, t)
        plan = out._jdf.queryExecution().executedPlan().treeString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert out.count() == 1000 - 250
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_is_a_no_op_when_scans_have_enough_splits(spark):
    from jobtide.session import spread
    df = spark.range(0, 1000, numPartitions=16)
    assert "Exchange" not in spread(df, scan_partitions=16)._jdf.queryExecution().executedPlan().treeString()
    assert "RoundRobinPartitioning" in spread(df, scan_partitions=1)._jdf.queryExecution().executedPlan().treeString()
