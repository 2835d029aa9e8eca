"""Rule tables over texts (L1, L3): many patterns against many offers without trying each pair.

A rule is (rule_id, pattern, weight): a regular expression over the lower-cased text.  Patterns of plain strings, also
several as top-level alternatives, are searched as such, all at once (``needles``).  Every match of another indexable rule
holds one of a few literal grams (``GRAM`` characters, one for each top-level alternative of its pattern); these are
searched in the same pass, and the rules whose grams a text holds are tried exactly.
Rules without such grams (``.*``, ``b.``) are tried on every text.

The offers are read once and never exchanged: the strings are broadcast, the rules literals of the plan.  Rules are
configuration and pass through the driver; more than ``MAX_RULES`` are refused.

Cases: a null text matches nothing; null patterns match nothing; rules of one id count once each; hits are in rule order
(rule_id, then pattern), so sums of weights don't depend on how a text is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.literals import Literals, let
from jobtide.operators.needles import Needles

GRAM = 3
MAX_RULES = 200_000
_GAP = "\x00"
_PLAIN = re.compile(r"[^\\^$.\[\](){}?*+|]+(?:\|[^\\^$.\[\](){}?*+|]+)*")     # strings without signs of expressions


def required_grams(pattern: Column) -> Column:
    """array<string>: grams one of which every match holds; null if the pattern gives none."""
    p = pattern
    gap = F.lit(_GAP)
    for what in (r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[pP]\{[^}]*\}|\\Q.*?(?:\\E|$)|\\.",     # escapes
                 r"\[\^?\]?[^\]]*\]"):                                                          # classes
        p = F.regexp_replace(p, F.lit(what), gap)
    for _ in range(4):                                                                         # groups, innermost first
        p = F.regexp_replace(p, F.lit(r"\([^()]*\)"), gap)
    plain = ~p.rlike(r"[()\[\]\\]") & ~pattern.rlike(r"\(\?[a-zA-Z]")         # deeper nesting and flags: not indexed
    p = F.regexp_replace(p, F.lit(r"(?s).(?:[?*]|\{[^}]*\})[?+]?|[+.^$]"), gap)                 # quantified, any, edges
    longest = lambda alt: F.array_max(F.transform(                                             # noqa: E731
        F.split(alt, _GAP), lambda run: F.struct(F.length(run).alias("n"), run.alias("run"))))
    # The last characters of the longest run: word endings tell more apart than beginnings.
    grams = F.transform(F.split(p, r"\|"), lambda alt: let(longest(alt), lambda x: F.when(
        x["n"] >= GRAM, F.lower(F.substring(x["run"], x["n"] - (GRAM - 1), F.lit(GRAM))))))
    return F.when(plain & F.forall(grams, lambda g: g.isNotNull()), F.array_distinct(grams))


def _rows(rules: DataFrame) -> list:
    rows = rules.where(F.col("pattern").isNotNull()).select(
        F.col("rule_id").cast("string").alias("rule_id"), "pattern", F.col("weight").cast("double").alias("weight"),
        required_grams(F.col("pattern")).alias("grams")).orderBy("rule_id", "pattern").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return rows


def match(offers: DataFrame, rules: DataFrame, text_cols: Sequence[str], out: str = "rule_hits") -> DataFrame:
    """Adds ``out``: array<struct<rule_id, weight>> of the rules that match the joined lower-cased texts."""
    rows = _rows(rules)
    plain = [k for k, r in enumerate(rows) if _PLAIN.fullmatch(r.pattern)]
    exact = set(plain)
    strings = [r.pattern.split("|") if k in exact else r.grams or () for k, r in enumerate(rows)]
    always = [k for k, s in enumerate(strings) if not s]
    held = offers.sparkSession.sparkContext.broadcast(Needles(strings))
    literals = Literals(offers.sparkSession)
    table = literals.put([{**r.asDict(), "plain": k in exact} for k, r in enumerate(rows)],
                         "array<struct<rule_id:string,pattern:string,weight:double,plain:boolean>>")
    every = literals.put(always, "array<int>")
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols]))

    @F.arrow_udf("array<int>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield held.value.search(texts)

    found = search(text)
    if len(plain) < len(rows):
        found = F.filter(F.array_sort(F.concat(found, every)), lambda k: F.get(table, k)["plain"] | F.rlike(
            text, F.get(table, k)["pattern"]))
    matched = offers.withColumn(out, F.transform(found, lambda k: F.struct(
        F.get(table, k)["rule_id"].alias("rule_id"), F.get(table, k)["weight"].alias("weight"))))
    matched.schema      # analysed: the plan holds the literals
    literals.drop()
    return matched


def exclude(offers: DataFrame, rules: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    """L1: the offers that no rule matches."""
    return match(offers, rules, text_cols, "_hits").where(F.size("_hits") == 0).drop("_hits")


def score(offers: DataFrame, rules: DataFrame, text_cols: Sequence[str], out: str = "fit_score") -> DataFrame:
    """L3: sum of the weights of the rules that match."""
    total = F.aggregate("_hits", F.lit(0.0), lambda s, h: s + F.coalesce(h["weight"], F.lit(0.0)))
    return match(offers, rules, text_cols, "_hits").withColumn(out, total).drop("_hits")
