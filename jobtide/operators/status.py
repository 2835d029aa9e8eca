"""Run status and data-quality aggregates (grouped, map-side combined)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.common import js_trim


def with_description(offers: DataFrame, by=("run_id",)) -> DataFrame:
    """Run total and rows whose description is a non-blank string."""
    return offers.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("offers"),
        F.count_if(F.length(js_trim(F.col("description"))) > 0).cast("bigint").alias("with_description"))


def vocab_violations(tracker: DataFrame, vocab: dict | None = None) -> DataFrame:
    """E5: per vocabulary column, how many tracker values are outside the allowed list
    (unpivot → anti-join to the fixed vocabulary → count)."""
    from jobtide.schema import VOCAB
    vocab = vocab or VOCAB
    spark = tracker.sparkSession
    dim = F.broadcast(spark.createDataFrame([(c, v) for c, vs in vocab.items() for v in vs], "column string, value string"))
    cols = list(vocab)
    long = tracker.select(F.expr(
        f"stack({len(cols)}, " + ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols) + ") AS (column, value)"))
    bad = long.where(F.col("value").isNotNull() & (F.col("value") != "")).join(dim, ["column", "value"], "left_anti")
    return bad.groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("violations"),
                                     F.count_distinct("value").cast("bigint").alias("distinct_values"))


# Per-source rule for "zero offers means blocked".
EMPTY_IS_BLOCKED = {"pracuj": "first_page_empty", "theprotocol": "empty", "indeed": "empty_without_no_results",
                    "nofluffjobs": "empty_and_no_valid_response"}
NO_RESULTS_RE = "brak wyników|no results|nie znaleziono"


# Needles each source's list page is searched for in body text and title, patterns
# its final address is searched for, and the response header that marks a challenge.
_COMMON = ["captcha", "just a moment", "cf-chl", "datadome", "access denied", "attention required"]
LIST_NEEDLES = {
    "justjoin": _COMMON, "rocketjobs": _COMMON, "talentdays": _COMMON, "olx": _COMMON, "pracuj": _COMMON,
    "theprotocol": _COMMON, "nofluffjobs": _COMMON,
    "indeed": [*_COMMON, "cloudflare", "verifying you are human", "verify you are human", "unusual traffic"],
}
URL_SIGNALS = {"olx": "|".join(_COMMON), "theprotocol": "challenge",
               "pracuj": "challenge|cf-chl|captcha|__cf|datadome",
               "indeed": "challenge|cf-chl|captcha|geo-blocked|blocked"}
HEADER_SIGNALS = {"theprotocol": "challenge"}
TITLE_SOURCES = ["indeed"]


def block_signal(columns: list[str]) -> Column:
    """A landed list page shows a block: its source's needles in text or title, its address, the
    mitigation header, 403/429, or 503 for indeed.  title, final_url and cf_mitigated are optional."""
    have = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c in columns else F.lit("")
    source = F.col("source")
    title = F.when(source.isin(TITLE_SOURCES), have("title")).otherwise(F.lit(""))
    text = F.concat_ws("\n", title, have("text"))
    needle, address = F.lit(False), F.lit(False)
    for s, words in LIST_NEEDLES.items():
        needle = needle | ((source == s) & text.rlike("|".join(words)))
    for s, pattern in URL_SIGNALS.items():
        address = address | ((source == s) & have("final_url").rlike(pattern))
    for s, word in HEADER_SIGNALS.items():
        address = address | ((source == s) & have("cf_mitigated").contains(word))
    return (needle | address
            | F.coalesce(F.col("status").isin(403, 429), F.lit(False))
            | ((source == "indeed") & F.coalesce(F.col("status") == 503, F.lit(False))))


def blocked_sources(pages: DataFrame, sources: list[str]) -> DataFrame:
    """Per (run, source) blocked flag from landed list pages: any block signal, or zero
    offers where the source's rule treats empty as blocked.  Every configured source gets a
    row per run (sources exploded from a fixed list, no join needed to create them)."""
    text, signal = F.lower(F.coalesce(F.col("text"), F.lit(""))), block_signal(pages.columns)
    agg = pages.groupBy("run_id", "source").agg(
        F.max(signal).alias("_signal"),
        F.sum("n_offers").cast("bigint").alias("_offers"),
        F.sum(F.when(F.col("page_no") == 1, F.col("n_offers")).otherwise(0)).cast("bigint").alias("_first"),
        F.max(text.rlike(NO_RESULTS_RE)).alias("_no_results"),
        F.max((F.col("status") == 200) & ~signal).alias("_valid"),
        F.max(F.col("status") >= 500).alias("_load_failed"))
    runs = pages.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    j = runs.join(agg, ["run_id", "source"], "left")
    empty = F.coalesce(F.col("_offers"), F.lit(0)) == 0
    s = F.col("source")
    rule = (F.when(s == "pracuj", F.coalesce(F.col("_first"), F.lit(0)) == 0)
            .when(s == "theprotocol", empty)
            .when(s == "indeed", empty & (~F.coalesce(F.col("_no_results"), F.lit(False))
                                          | F.coalesce(F.col("_load_failed"), F.lit(False))))
            .when(s == "nofluffjobs", empty & ~F.coalesce(F.col("_valid"), F.lit(False)))
            .otherwise(F.lit(False)))
    return j.select("run_id", "source", F.coalesce(F.col("_offers"), F.lit(0)).alias("offers"),
                    (F.coalesce(F.col("_signal"), F.lit(False)) | rule).alias("blocked"))
