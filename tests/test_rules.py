"""Rule tables (L1, L3) against the plain form."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobtide.operators import rules as R

PATTERNS = ["staż|praktyk", "senior", "zdaln", "b2b", "(?<![a-z])mid(?![a-z])", "team ?lead", "a{2}bcd", "xyz*w", "x[abc]yzab", r"c\+\+",
            r"praca\s+zdalna", "(junior|młodszy) tester", "ab(cd|ef)?gh", ".*", "k.t", "(a|b)+c", r"\bremote\b", "", None, "foo|", "^start",
            "end$", "((a(b)c)d)e(f)", "(?i)SeniOR", "abc+d", r"100\.5", r"\p{L}+tester", "java|kotlin|scala", "[[:alpha:]]x", "日本語テスト"]


def test_required_grams_are_in_every_match(spark):
    texts = ["staż", "praktykant", "senior dev", "praca   zdalna", "junior tester", "młodszy tester", "abgh", "abcdgh", "abefgh", "abccd",
             "kat kot", "xbyzab", "aabcd", "xyw xyzzw", "team lead teamlead", "java", "scala", "remote", "start", "the end", "100.5", "日本語テスト",
             "mid", "c++", "abcdef", "żtester"]
    rows = {r.pattern: r.grams for r in spark.createDataFrame([(p,) for p in PATTERNS if p is not None], "pattern string").select(
        "pattern", R.required_grams(F.col("pattern")).alias("grams")).collect()}
    assert rows["staż|praktyk"] == ["taż", "tyk"] and rows["java|kotlin|scala"] == ["ava", "lin", "ala"] and rows["senior"] == ["ior"]
    assert all(rows[p] is None for p in ("b2b|", ".*", "k.t", "", "foo|", "(?i)SeniOR", "(a|b)+c") if p in rows)
    for p, grams in rows.items():
        if grams:
            py = p.replace(r"\p{L}", r"\w").replace("[[:alpha:]]", "[a-z]")
            for t in texts:
                if re.search(py, t):
                    assert any(g in t for g in grams), (p, t)


def plain(rules, text):
    return sorted({(i, w) for i, p, w in rules if p is not None and re.search(p.replace(r"\p{L}", r"[^\W\d_]"), text)}, key=str)


def test_ten_thousand_rules_equal_the_plain_form(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeżłó") for _ in range(rng.randrange(2, 7)))
    rules = [(f"w{i:05d}", rng.choice([word(), f"{word()}|{word()}", f"{word()}[ab]?{word()}", f"({word()}|{word()}){word()}"]),
              float(rng.randrange(-4, 5))) for i in range(10_000)]
    rules += [(f"p{i:02d}", p, 1.5) for i, p in enumerate(PATTERNS) if p != "[[:alpha:]]x"]
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(25)] + ["", "Senior B2B, Praca zdalna; C++", "Junior Tester"]
    offers = spark.createDataFrame([(i, t, None if i % 3 else "Extra " + t[:9]) for i, t in enumerate(texts)] + [(99, None, None)],
                                   "k long, title string, body string")
    table = spark.createDataFrame(rules, "rule_id string, pattern string, weight double")
    out = {r.k: sorted(((h.rule_id, h.weight) for h in r.rule_hits), key=str) for r in R.match(offers, table, ["title", "body"]).collect()}
    want = {}
    for r in offers.collect():
        want[r.k] = plain(rules, f"{r.title or ''} {r.body or ''}".lower())
    assert out == want
    totals = {r.k: r.fit_score for r in R.score(offers, table, ["title", "body"]).collect()}
    assert totals == {k: pytest.approx(sum(w for _, w in v)) for k, v in want.items()}
    few = table.where("rule_id IN ('p01', 'p03')")
    kept = {r.k for r in R.exclude(offers, few, ["title", "body"]).collect()}
    assert kept == {k for k, v in want.items() if not {"p01", "p03"} & {i for i, _ in v}} and len(kept) == len(texts)
    assert R.exclude(offers, table.where("false"), ["title"]).count() == len(texts) + 1


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_RULES", 2)
    with pytest.raises(ValueError):
        R.match(spark.range(1).select(F.lit("x").alias("t")), spark.createDataFrame([(str(i), "a", 1.0) for i in range(3)],
                "rule_id string, pattern string, weight double"), ["t"])


def test_needles_equal_plain_search(monkeypatch):
    import pyarrow as pa
    from jobtide.operators import needles as N
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("abż") for _ in range(rng.randrange(a, b)))
    needles = [[word(1, 14) for _ in range(rng.randrange(0, 3))] for _ in range(300)] + [["abżabżabżabżabżabż" * 3]]
    texts = [word(0, 90) for _ in range(200)] + [None, "", needles[-1][0], needles[-1][0][:-1], "x" + needles[-1][0]]
    want = [[k for k, mine in enumerate(needles) if any(s in (t or "") for s in mine)] for t in texts]
    for piece, expand in ((1 << 20, 1 << 22), (50, 7)):
        monkeypatch.setattr(N, "PIECE", piece)
        monkeypatch.setattr(N, "EXPAND", expand)
        found = N.Needles(needles)
        assert found.search(pa.array(texts)).to_pylist() == want
        assert found.search(pa.array(texts).slice(7, 150)).to_pylist() == want[7:157]
    assert N.Needles([]).search(pa.array(texts)).to_pylist() == [[]] * len(texts) and found.search(pa.array([], pa.string())).to_pylist() == []
    assert N.Needles([["a"]]).search(pa.array([None], pa.string())).to_pylist() == [[]]


def test_plain_rules_are_tried_in_no_expression(spark):
    rules = spark.createDataFrame([("a", "senior|b2", 1.0), ("b", "praca zdalna", 2.0), ("c", "ż", 4.0)], "rule_id string, pattern string, weight double")
    offers = spark.createDataFrame([(1, "SENIOR"), (2, "B2B, praca ZDALNA"), (3, "Ż senio r"), (4, None)], "k long, t string")
    out = R.score(offers, rules, ["t"])
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert "rlike" not in plan and "regexp" not in plan
    assert {r.k: r.fit_score for r in out.collect()} == {1: 1.0, 2: 3.0, 3: 4.0, 4: 0.0}


def test_exclude_tries_no_plain_rule_one_by_one(spark):
    rules = spark.createDataFrame([("a", "senior|b2", None), ("b", "stacjonarna", None)], "rule_id string, pattern string, weight double")
    offers = spark.createDataFrame([(1, "SENIOR"), (2, "zdalna"), (3, "b 2"), (4, None), (5, "praca stacjonarna")], "k long, t string")
    out = R.exclude(offers, rules, ["t"])
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert "rlike" not in plan and plan.count("arrowevalpython") == 1
    assert sorted(r.k for r in out.collect()) == [2, 3, 4]
