"""Keyed merges, cache rules, positional outcome rules, numbering and dedup."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobtide.operators import cache as K
from jobtide.operators import enrich as EN
from jobtide.operators.dedup import dedup_run
from jobtide.operators.numbering import number_within
from jobtide.operators.outcomes import RULES, resolve_outcomes, run_status
from jobtide.operators.positional import budget_report, run_names


def test_merge_fill_group_guard(spark):
    df = spark.createDataFrame([(4000.0, None, None, None), (None, None, None, None)],
                               "salary_from double, salary_to double, salary_currency string, company string")
    det = F.struct(F.lit(5000.0).alias("salary_from"), F.lit(6000.0).alias("salary_to"),
                   F.lit("PLN").alias("salary_currency"), F.lit("Acme").alias("company"))
    out = EN.merge_fill(df.withColumn("d", det), "d", ["company"], ["salary_from", "salary_to", "salary_currency"],
                        "salary_from").collect()
    assert (out[0]["salary_from"], out[0]["salary_to"], out[0]["company"]) == (4000.0, None, "Acme")
    assert (out[1]["salary_from"], out[1]["salary_to"], out[1]["salary_currency"]) == (5000.0, 6000.0, "PLN")


def test_param_first_occurrence(spark):
    df = spark.createDataFrame([([("agreement", "A"), ("agreement", "B"), ("type", "T")],), ([("type", "T")],)],
                               "p array<struct<key:string,label:string>>")
    assert [r[0] for r in df.select(EN.param("p", ["agreement", "type"])).collect()] == ["A", "T"]


def test_cache_ttl_boundary(spark):
    now = dt.datetime(2024, 3, 1)
    rows = [("a", now - dt.timedelta(days=60)), ("b", now - dt.timedelta(days=60, milliseconds=1)), ("c", None)]
    df = spark.createDataFrame(rows, "url_key string, fetched_at timestamp_ntz")
    assert sorted(r[0] for r in K.cache_prune(df, now, 60).collect()) == ["a"]


def test_cache_upsert_blank_never_enters(spark):
    old = spark.createDataFrame([("k", dt.datetime(2024, 1, 1), "old")], "url_key string, fetched_at timestamp, description string")
    new = spark.createDataFrame([("k", dt.datetime(2024, 1, 2), ""), ("n", dt.datetime(2024, 1, 2), "fresh")],
                                "url_key string, fetched_at timestamp, description string")
    got = {r["url_key"]: r["description"] for r in K.cache_upsert(old, new).collect()}
    assert got == {"k": "old", "n": "fresh"}


def _att(spark, seq, source="s"):
    rows = []
    for i, (status, key, extra) in enumerate(seq, start=1):
        rows.append(("R", source, i, key or f"k{i}", status, extra == "cached", extra == "noslug",
                     status in (403, 429), "desc" if status == 200 else None))
    return spark.createDataFrame(rows, "run_id string, source string, position long, url_key string, status int, "
                                       "cache_hit boolean, no_slug boolean, blocked boolean, description string")


def _outcomes(spark, seq, profile):
    o = resolve_outcomes(_att(spark, seq), RULES[profile]).orderBy("position").collect()
    return [r["outcome"] for r in o], o


def test_blocked_aborts(spark):
    outs, rows = _outcomes(spark, [(200, None, None), (403, None, None), (200, None, "cached"), (200, None, None)], "justjoin")
    assert outs == ["fetched", "blocked", "skipped", "skipped"]
    st = run_status(resolve_outcomes(_att(spark, [(200, None, None), (403, None, None), (200, None, "cached"),
                                                  (200, None, None)]), RULES["justjoin"]), RULES["justjoin"]).first()
    assert (st["details_fetched"], st["details_cached"], st["detail_errors"], st["detail_aborted"]) == (1, 0, 1, True)


def test_consecutive_failures(spark):
    outs, _ = _outcomes(spark, [(0, None, None), (200, None, "cached"), (0, None, None), (0, None, None), (200, None, None)],
                        "nofluffjobs")
    assert outs == ["error", "cached", "error", "error", "skipped"]
    outs, _ = _outcomes(spark, [(0, None, None), (0, None, None), (500, None, None), (0, None, None), (200, None, None)],
                        "nofluffjobs")
    assert outs == ["error", "error", "error", "error", "fetched"]


def test_twins(spark):
    outs, _ = _outcomes(spark, [(200, "same", None), (200, "same", None)], "justjoin")
    assert outs == ["fetched", "cached"]
    outs, _ = _outcomes(spark, [(500, "same", None), (200, "same", None)], "justjoin")
    assert outs == ["error", "fetched"]


def test_blocked_error_rules_by_source(spark):
    for profile, has_error, counts in (("olx", False, 0), ("talentdays", True, 0)):
        a = _att(spark, [(200, None, None), (403, None, None)])
        o = resolve_outcomes(a, RULES[profile])
        row = o.where("position = 2").first()
        assert (row["detail_error"] is not None) == has_error
        assert run_status(o, RULES[profile]).first()["detail_errors"] == counts


def test_all_rule_sets_in_one_pass(spark):
    from jobtide.operators.outcomes import resolve_by_rules
    seq = [(200, "a", None), (0, None, None), (0, None, "cached"), (200, "a", None), (0, None, None), (500, None, None), (0, None, None),
           (0, None, None), (0, None, None), (None, None, "noslug"), (200, None, None), (403, None, None), (200, "z", None)]
    for att in (_att(spark, seq), _att(spark, seq[:4]), _att(spark, seq[-3:]), _att(spark, seq).where("false")):
        got = {}
        for r in resolve_by_rules(att, RULES).collect():
            got.setdefault(r.rules, []).append((r.position, r.outcome, r.detail_error))
        for name, rules in RULES.items():
            want = [(r.position, r.outcome, r.detail_error) for r in resolve_outcomes(att, rules).collect()]
            assert sorted(got.get(name, [])) == sorted(want), name


def test_number_within_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5003).alias("o"))
    got = number_within(df, ["g"], ["o"], "rn", partitions=7)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("bigint"))
    assert got.exceptAll(ref.select(*got.columns)).count() == 0 and got.count() == 5000


def test_run_name_collisions(spark):
    runs = spark.createDataFrame([("a", dt.datetime(2024, 5, 1, 8, 0, 5)), ("b", dt.datetime(2024, 5, 1, 8, 0, 40))],
                                 "run_id string, started_at timestamp")
    got = {r["run_id"]: (r["run_tab"], r["export_stamp"]) for r in run_names(runs).collect()}
    assert got == {"a": ("01.05.2024 10-00", "2024-05-01_10-00"), "b": ("01.05.2024 10-00 (2)", "2024-05-01_10-00_2")}


def test_dedup_run_first_wins_and_idempotent(spark):
    df = spark.createDataFrame([("R", "b", 1, "https://x.pl/a?x=1"), ("R", "a", 5, "https://X.pl/a/"),
                                ("R", "a", 6, None), ("R2", "a", 1, "https://x.pl/a")],
                               "run_id string, source string, position long, url string")
    once = dedup_run(df)
    got = sorted((r["run_id"], r["source"], r["position"]) for r in once.collect())
    assert got == [("R", "a", 5), ("R2", "a", 1)]
    assert sorted(tuple(r) for r in dedup_run(once).collect()) == sorted(tuple(r) for r in once.collect())


def test_budget_report_counts_and_drops_nothing(spark):
    df = spark.range(1, 21).select(F.lit("R").alias("run_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b")
                                   .alias("source"), F.col("id").alias("position"))
    got = {r["source"]: (r["rows"], r["budget"], r["beyond"]) for r in budget_report(df, {"a": 3}).collect()}
    assert got == {"a": (10, 3, 7), "b": (10, None, 0)}


def test_param_present_key_without_label_does_not_fall_through(spark):
    df = spark.createDataFrame([([("agreement", None), ("type", "T")],)], "p array<struct<key:string,label:string>>")
    assert df.select(EN.param("p", ["agreement", "type"])).first()[0] is None


def test_detail_messages_by_source(spark):
    rows = [("no id", None, False, True, None, True), ("forbidden", 403, True, False, None, True),
            ("needle", 200, True, False, None, True), ("server", 500, False, False, None, True),
            ("net", 0, False, False, "boom", True), ("silent", 0, False, False, None, True),
            ("odd body", 200, False, False, None, False), ("empty", 200, False, False, None, True)]
    att = spark.createDataFrame([(name, "s", 1, f"k{name}", st, False, no_id, blocked, None, parsed, err, "captcha")
                                 for name, st, blocked, no_id, err, parsed in rows],
                                "run_id string, source string, position long, url_key string, status int, "
                                "cache_hit boolean, no_slug boolean, blocked boolean, description string, "
                                "parsed boolean, error string, block_mark string")
    want = {
        "justjoin": ["no slug", "http 403", "block-signal: captcha", "http 500", "boom", "no result", "ld+json not found",
                     "empty description"],
        "rocketjobs": ["no slug", "http 403", "block signal", "http 500", "fetch boom", "empty result",
                       "ld+json JobPosting not found", "empty description"],
        "talentdays": ["no slug", "http 403", "block signal", "http 500", "fetch boom", "no content", "bad json (http 200)",
                       "no content"],
        "nofluffjobs": ["no slug in url", "blocked (status 403)", "blocked (status 200)", "detail fetch failed (status 500)",
                        "detail fetch failed (status 0)", "detail fetch failed (status 0)",
                        "detail fetch failed (status 200)", None],
        "olx": ["no ad id on card", None, None, "HTTP 500", "HTTP 0 / boom", "HTTP 0", "HTTP 200", None],
    }
    for source, texts in want.items():
        got = {r["run_id"]: r["detail_error"] for r in resolve_outcomes(att, RULES[source]).collect()}
        assert [got[name] for name, *_ in rows] == texts, source


def test_fill_takes_each_salary_field_on_its_own(spark):
    df = spark.createDataFrame([(None, 8000.0, "PLN", None), (None, 8000.0, None, (5000.0, 9000.0, "EUR")),
                                (1.0, None, None, (5000.0, 9000.0, "EUR"))],
                               "salary_from double, salary_to double, salary_currency string, "
                               "det struct<salary_from: double, salary_to: double, salary_currency: string>")
    f = ["salary_from", "salary_to", "salary_currency"]
    got = [tuple(r) for r in EN.merge_fill(df, "det", [], group=f, group_guard="salary_from").select(*f).collect()]
    assert got == [(None, 8000.0, "PLN"), (5000.0, 8000.0, "EUR"), (1.0, None, None)]


def test_block_signals_of_each_source(spark):
    from jobtide.operators.status import block_signal
    rows = [("justjoin", 200, "cloudflare", "", "", ""), ("indeed", 200, "cloudflare", "", "", ""),
            ("indeed", 200, "", "Just a moment", "", ""), ("indeed", 503, "", "", "", ""), ("olx", 503, "", "", "", ""),
            ("pracuj", 200, "", "", "https://x/__cf?", ""), ("theprotocol", 200, "", "", "", "Challenge"),
            ("olx", 200, "", "", "https://x/captcha", ""), ("talentdays", 429, None, None, None, None)]
    df = spark.createDataFrame(rows, "source string, status int, text string, title string, final_url string, "
                                     "cf_mitigated string")
    got = [r[0] for r in df.select(block_signal(df.columns)).collect()]
    assert got == [False, True, True, True, False, True, True, True, True]
    assert df.select("source", "status", "text").select(block_signal(["source", "status", "text"])).count() == len(rows)
