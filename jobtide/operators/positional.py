"""Crawl-budget report, run naming and per-page yield (G1, F7, E4), plus unions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.dates import run_file_stamp, run_tab_stamp
from jobtide.operators.numbering import number_within

# List rows a crawl asks each source for (pages × rows per page).  Landed rows are
# fetched already, so nothing is dropped by them; ``budget_report`` counts the rows beyond.
BUDGETS = {"justjoin": 1000, "rocketjobs": 1000, "nofluffjobs": 1000, "talentdays": 300}


def budget_report(df: DataFrame, budgets: Mapping[str, int], key: str = "source", by=("run_id",)) -> DataFrame:
    """G1: rows per (run, source) and how many lie beyond the source's crawl budget (null
    budget: no limit).  A grouped count; every landed row stays in the data."""
    pairs = [x for k, v in budgets.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]
    budget = F.try_element_at(F.create_map(*pairs), F.col(key))
    return (df.groupBy(*by, key).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
              .withColumn("budget", budget)
              .withColumn("beyond", F.greatest(F.col("rows") - F.coalesce(F.col("budget"), F.col("rows")),
                                               F.lit(0)).cast("bigint")))


def run_names(runs: DataFrame, ts: str = "started_at", run_key: str = "run_id") -> DataFrame:
    """F7 + I19: tab 'dd.MM.yyyy HH-mm' (local time); the k-th run in the same minute gets
    ' (k)' and its export stamp '_k'.  Numbered with the range-partitioned numbering
    (a minute holding many runs is not sent to one task)."""
    r = runs.withColumn("_tab", run_tab_stamp(F.col(ts))).withColumn("_file", run_file_stamp(F.col(ts)))
    r = number_within(r, ["_tab"], [ts, run_key], "_k")
    k = F.col("_k")
    return (r.withColumn("run_tab", F.when(k > 1, F.concat(F.col("_tab"), F.lit(" ("), k.cast("string"), F.lit(")")))
                         .otherwise(F.col("_tab")))
             .withColumn("export_stamp", F.when(k > 1, F.concat(F.col("_file"), F.lit("_"), k.cast("string")))
                         .otherwise(F.col("_file")))
             .drop("_tab", "_file", "_k"))


def page_yield(df: DataFrame, key: Column | str, by=("run_id", "source"), page: str = "page_no",
               order: str = "position") -> DataFrame:
    """Per landed page, rows that are new (first sighting of their key in the run and
    source) vs already seen on an earlier row."""
    k = F.col(key) if isinstance(key, str) else key
    x = df.withColumn("_k", k)
    first = x.groupBy(*by, "_k").agg(F.min(F.struct(F.col(page), F.col(order))).alias("_first"))
    j = x.join(first, [*by, "_k"], "left")
    is_new = F.col("_k").isNull() | ((F.col("_first")[page] == F.col(page)) & (F.col("_first")[order] == F.col(order)))
    return j.groupBy(*by, page).agg(F.count_if(is_new).cast("bigint").alias("new_rows"),
                                    F.count_if(~is_new).cast("bigint").alias("seen_rows"))


def union_sources(*dfs: DataFrame) -> DataFrame:
    """H1: UNION ALL of sources with differing column sets."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def concat_lists(*cols) -> Column:
    """H2: concatenation of array columns, null arrays treated as empty."""
    return F.concat(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")) for c in cols])


def first_nonempty(by, *tagged: DataFrame) -> DataFrame:
    """Fallback chain.  Each input is tagged with its priority (``_prio`` column,
    lower first); per group, only rows of the best priority that has rows are kept.
    The per-group minimum is a grouped aggregate joined back."""
    allr = union_sources(*tagged)
    best = allr.groupBy(*by).agg(F.min("_prio").alias("_best"))
    return allr.join(best, list(by)).where(F.col("_prio") == F.col("_best")).drop("_best")
