"""Detail-phase outcomes as set operations instead of a sequential loop.

The reference walks a source's offers in list order: cache hits are reused, other
offers are fetched, a blocked response (or three transport failures in a row for
some sources) stops the phase, and a later offer with the key of an earlier success
is served from the freshly written cache.  The same result is reached with:

* F6 twin reuse: ``min(position)`` of successful attempts per (run, source, key),
  joined back — a grouped aggregate, so a hot key is combined map-side;
* F4 abort cut: ``min(position)`` of blocked attempts per (run, source);
* F5 consecutive-failure cut: attempts are numbered densely per (run, source) with a
  range-partitioned numbering (no one-task-per-source window), and runs of consecutive
  status-0 attempts are found by a grouped vote count over (run, source, index);
* outcome = ordered ``when`` chain from a per-source rule set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators.numbering import number_within
from jobtide.session import cut_lineage


@dataclass(frozen=True)
class OutcomeRules:
    """Per-source detail rules.  Texts hold ``{status}``, ``{error}`` (transport
    error) or ``{mark}`` (block needle found) where the source's message does."""
    no_id: str = "no slug"
    http_error: str = "http {status}"
    transport_error: str = "{error}"
    no_response: str = "no result"                 # status 0 without an error text
    unparsed: str | None = None                    # a 2xx body without the expected content; None: http_error
    malformed: str | None = None                   # a 2xx body whose content is there but can't be read
    unparsed_any_status: bool = False              # the body is parsed before the status is looked at
    empty_error: str = "empty description"
    empty_is_fetched: bool = False
    block_status: str | None = "http {status}"
    block_needle: str | None = "block signal"
    blocked_counts_error: bool = True
    consecutive_fail_limit: int | None = None


# Per-source detail rules and messages.
RULES = {
    "justjoin": OutcomeRules(unparsed="ld+json not found", malformed="ld+json parse: invalid JSON",
                             block_needle="block-signal: {mark}"),
    "rocketjobs": OutcomeRules(unparsed="ld+json JobPosting not found", transport_error="fetch {error}",
                               no_response="empty result"),
    "talentdays": OutcomeRules(unparsed="bad json (http {status})", unparsed_any_status=True,
                               transport_error="fetch {error}", no_response="no content", empty_error="no content",
                               blocked_counts_error=False),
    "nofluffjobs": OutcomeRules(no_id="no slug in url", http_error="detail fetch failed (status {status})",
                                transport_error="detail fetch failed (status 0)",
                                no_response="detail fetch failed (status 0)", empty_is_fetched=True,
                                block_status="blocked (status {status})", block_needle="blocked (status {status})",
                                consecutive_fail_limit=3),
    "olx": OutcomeRules(no_id="no ad id on card", http_error="HTTP {status}", transport_error="HTTP 0 / {error}",
                        no_response="HTTP 0", empty_is_fetched=True, block_status=None, block_needle=None,
                        blocked_counts_error=False),
}

KEY = ["run_id", "source"]
MAX_CUTS = 1 << 17   # (run, source) rows, some dozens of bytes each, that may be broadcast


def _flags(att: DataFrame) -> DataFrame:
    """Expects run_id, source, position, url_key, cache_hit, no_slug, status, blocked, description;
    optional: parsed (the body has the expected content; default true), malformed (the content can't be
    read; default false), error (transport error text), block_mark (the needle found), nonempty (there is a description;
    by default ``description`` is looked at)."""
    for name, default in (("parsed", F.lit(True)), ("malformed", F.lit(False)), ("error", F.lit(None).cast("string")),
                          ("block_mark", F.lit(None).cast("string"))):
        if name not in att.columns:
            att = att.withColumn(name, default)
    got = F.coalesce(F.col("status").between(200, 299) & ~F.col("blocked"), F.lit(False))
    ok = got & F.coalesce(F.col("parsed") & ~F.col("malformed"), F.lit(False))
    nonempty = F.col("nonempty") if "nonempty" in att.columns else F.coalesce(F.length(F.col("description")) > 0, F.lit(False))
    has_url = F.coalesce(F.col("url_key") != "", F.lit(False))
    return (att.withColumn("_has_url", has_url).withColumn("_got", got)
               .withColumn("_ok", ok).withColumn("_success", ok & nonempty))


def _text(template: str | None) -> Column:
    """The message with its places filled from the row."""
    if template is None:
        return F.lit(None).cast("string")
    out = F.lit(template)
    for place, value in (("{status}", F.coalesce(F.col("status"), F.lit(0)).cast("string")),
                         ("{error}", F.coalesce(F.col("error"), F.lit(""))),
                         ("{mark}", F.coalesce(F.col("block_mark"), F.lit("")))):
        if place in template:
            out = F.replace(out, F.lit(place), value)
    return out


def error_text(rules: OutcomeRules, outcome: Column) -> Column:
    """The source's message for a blocked or failed detail; null otherwise."""
    status = F.coalesce(F.col("status"), F.lit(0))
    bad_body = ~F.coalesce(F.col("parsed"), F.lit(False))
    failed = (F.when(F.col("no_slug"), F.lit(rules.no_id))
              .when(F.col("_ok"), F.lit(rules.empty_error))
              .when(F.col("_got") & F.col("malformed") & F.lit(rules.malformed is not None), _text(rules.malformed))
              .when(F.col("_got"), _text(rules.unparsed or rules.http_error))
              .when((status == 0) & (F.coalesce(F.col("error"), F.lit("")) != ""), _text(rules.transport_error))
              .when(status == 0, _text(rules.no_response))
              .when(bad_body & F.lit(rules.unparsed_any_status), _text(rules.unparsed))
              .otherwise(_text(rules.http_error)))
    block = F.when(status.isin(403, 429), _text(rules.block_status)).otherwise(_text(rules.block_needle))
    return F.when(outcome == "blocked", block).when(outcome == "error", failed)


def reuse_twins(att: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """adds ``twin`` — a later offer whose key was fetched successfully earlier in the
    run — and, for ``fields``, ``twin_<field>`` copied from that first success."""
    extra = [F.min_by(F.col(f), F.col("position")).alias(f"twin_{f}") for f in fields]
    # Only rows that can be or have a twin meet in the join; cached rows and rows without a key
    # (which would all share one blank key) pass by.
    can = F.col("_has_url") & ~F.col("cache_hit")
    first_ok = (att.where(can & ~F.col("no_slug") & F.col("_success"))
                .groupBy(*KEY, "url_key").agg(F.min("position").alias("_first_ok"), *extra))
    rows = att.where(can).join(first_ok, [*KEY, "url_key"], "left")
    rest = att.where(~can).withColumns({c: F.lit(None).cast(first_ok.schema[c].dataType)
                                        for c in first_ok.columns if c not in (*KEY, "url_key")})
    return (rows.unionByName(rest)
            .withColumn("twin", F.coalesce(F.col("position") > F.col("_first_ok"), F.lit(False))).drop("_first_ok"))


def abort_cut(att: DataFrame) -> DataFrame:
    """first blocked attempt per (run, source)."""
    return att.where(F.col("_attempt") & F.col("blocked")).groupBy(*KEY).agg(F.min("position").alias("cut_blocked"))


def consecutive_fail_cut(att: DataFrame, n: int = 3) -> DataFrame:
    """position of the n-th consecutive status-0 attempt per (run, source).

    Attempts get a dense per-source index.  Every failure at index j votes for the run
    ending at j, j+1, …, j+n-1; an end index collecting n votes closes n consecutive
    failures.  One explode + one grouped count (map-side combined) replaces n-1
    self-joins."""
    attempts = number_within(att.where(F.col("_attempt")).select(*KEY, "position", "status"), KEY, ["position"], "_i")
    fails = attempts.where(F.col("status") == 0).select(*KEY, "position", "_i")
    votes = fails.select(*KEY, "position", "_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_d"))
    ends = (votes.groupBy(*KEY, (F.col("_i") + F.col("_d")).alias("_end"))
            .agg(F.count(F.lit(1)).alias("_votes"),
                 F.max(F.when(F.col("_d") == 0, F.col("position"))).alias("_pos")))
    return ends.where((F.col("_votes") == n) & F.col("_pos").isNotNull()) \
        .groupBy(*KEY).agg(F.min("_pos").alias("cut_consecutive"))


def _with_cuts(att: DataFrame, fail_limit: int | None, twin_fields: tuple[str, ...], materialize: bool) -> DataFrame:
    """The attempts with twins and the positions at which their (run, source) was cut, by block and by failures."""
    a = _flags(att)
    if materialize:
        a = cut_lineage(a)
    a = reuse_twins(a, twin_fields)
    a = a.withColumn("_attempt", F.col("_has_url") & ~F.col("cache_hit") & ~F.col("twin") & ~F.col("no_slug"))
    # Both cuts are read off the same narrow rows, written once.
    narrow = cut_lineage(a.where("_attempt").select(*KEY, "position", "status", "blocked", "_attempt"))
    cuts = abort_cut(narrow)
    if fail_limit:
        cuts = cuts.join(consecutive_fail_cut(narrow, fail_limit), KEY, "full_outer")
    else:
        cuts = cuts.withColumn("cut_consecutive", F.lit(None).cast("bigint"))
    # One row per (run, source) that was cut: counted, so the wide rows need no exchange on a key
    # with few values.
    cuts = cut_lineage(cuts)
    cuts = F.broadcast(cuts) if cuts.count() <= MAX_CUTS else cuts
    return a.join(cuts, KEY, "left")


def _outcome(rules: OutcomeRules) -> tuple[Column, Column]:
    """The cut and the outcome of an attempt by a source's rules."""
    cut = F.least("cut_blocked", "cut_consecutive") if rules.consecutive_fail_limit else F.col("cut_blocked")
    after_cut = F.coalesce(F.col("position") > cut, F.lit(False))
    empty_outcome = "fetched" if rules.empty_is_fetched else "error"
    return cut, (F.when(~F.col("_has_url") | after_cut, F.lit("skipped"))
                 .when(F.col("cache_hit") | F.col("twin"), F.lit("cached"))
                 .when(F.col("no_slug"), F.lit("error"))
                 .when(F.col("blocked"), F.lit("blocked"))
                 .when(F.col("_success"), F.lit("fetched"))
                 .when(F.col("_ok"), F.lit(empty_outcome))
                 .otherwise(F.lit("error")))


_INNER = ("_has_url", "_got", "_ok", "_success", "_attempt", "parsed", "malformed", "error", "block_mark", "nonempty")


def resolve_outcomes(att: DataFrame, rules: OutcomeRules, twin_fields: tuple[str, ...] = (),
                     materialize: bool = False) -> DataFrame:
    """Adds twin, attempt, cut, outcome (cached|fetched|error|blocked|skipped) and detail_error.

    The attempts table feeds several aggregates and joins; when its columns are expensive
    (text extracted from detail bodies) ``materialize`` writes it once as a reliable
    checkpoint so the extraction is not repeated per branch."""
    a = _with_cuts(att, rules.consecutive_fail_limit, twin_fields, materialize)
    cut, outcome = _outcome(rules)
    return (a.withColumn("cut", cut).withColumn("outcome", outcome)
             .withColumn("detail_error", error_text(rules, F.col("outcome")))
             .withColumn("attempt", F.col("_attempt")).drop(*_INNER))


def resolve_by_rules(att: DataFrame, rules: dict[str, OutcomeRules]) -> DataFrame:
    """The outcomes of the same attempts by several rule sets: rules (its name), run_id, source, position, outcome,
    detail_error.  Twins and cuts, which the rules share, are found once (a cut by failures counts for the rule sets that
    have one; their limits must agree)."""
    limits = {r.consecutive_fail_limit for r in rules.values()} - {None}
    if len(limits) > 1:
        raise ValueError("rule sets with different limits of consecutive failures")
    a = _with_cuts(att, next(iter(limits), None), (), False)
    outcomes = F.array(*[F.struct(F.lit(name).alias("rules"), _outcome(r)[1].alias("outcome")) for name, r in rules.items()])
    rows = a.withColumn("_o", F.explode(outcomes)).withColumn("outcome", F.col("_o.outcome"))
    error = None
    for name, r in rules.items():
        mine = F.col("_o.rules") == name
        error = F.when(mine, error_text(r, F.col("outcome"))) if error is None else error.when(mine, error_text(r, F.col("outcome")))
    return rows.select("_o.rules", *KEY, "position", "outcome", error.alias("detail_error"))


def run_status(outcomes: DataFrame, rules: OutcomeRules, by=("run_id", "source")) -> DataFrame:
    """Per (run, source) offer count and detail counters."""
    o = F.col("outcome")
    err = (o == "error") | ((o == "blocked") & F.lit(rules.blocked_counts_error))
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"),
        F.count_if(o == "fetched").cast("bigint").alias("details_fetched"),
        F.count_if(o == "cached").cast("bigint").alias("details_cached"),
        F.count_if(err).cast("bigint").alias("detail_errors"),
        F.max(F.col("cut").isNotNull()).alias("detail_aborted"),
    )
