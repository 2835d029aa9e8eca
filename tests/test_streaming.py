"""Streams over several micro-batches, restarts and replays (J1–J3), and versions with a commit protocol."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from jobtide.operators.cache import cache_prune, cache_upsert
from jobtide.sinks.versions import VersionConflict, Versions
from jobtide.streaming import pipeline as SP
from jobtide.streaming import ttl_cache as TC

DAY = dt.datetime(2024, 1, 1)


def entries(spark, rows):
    return spark.createDataFrame([(k, DAY + dt.timedelta(days=d), e, x) for k, d, e, x in rows], TC.ENTRY)


def batch_cache(df, days=60):
    now = df.agg(F.max("fetched_at")).first()[0]
    all_of = cache_upsert(df.limit(0), df, tie="event_id", prefer_new=False)
    return {r.url_key: r.description for r in cache_prune(all_of, F.lit(now), days).collect()}


ROWS = [("a", 0, 1, "a0"), ("b", 1, 2, "b1"), ("c", 2, 3, ""), ("hot", 3, 4, "h3"), ("a", 30, 5, "a30"), ("b", 1, 6, "b1 again"),
        ("d", 55, 7, "d55"), ("hot", 50, 8, None), ("e", 95, 9, "e95"), ("late", 10, 10, "expired on arrival"), ("a", 20, 11, "older"),
        ("f", 36, 12, "still fresh"), ("b", 96, 13, "b96"), ("b", 97, 14, ""), (None, 96, 15, "no key")]


def live(spark, base):
    return {r.url_key: r.description for r in TC.current(spark, base).collect()}


def test_ttl_cache_equals_the_batch_form(spark, tmp):
    """Every prefix of the stream, with a restart after each part, compaction in between and a replay."""
    base, done = f"{tmp}/cache", []
    for k in range(5):
        part = ROWS[3 * k:3 * k + 3]
        done += part
        SP.land_json(entries(spark, part), f"{tmp}/in/{k}", files=1)
        TC.stream_ttl_cache(spark, f"{tmp}/in/*", base, f"{tmp}/ck", 60, files_per_trigger=1, timestamp_format=SP.TS_FORMAT)
        assert live(spark, base) == batch_cache(entries(spark, done)), k
        if k % 2:
            before = live(spark, base)
            assert TC.compact(spark, base) == (k + 1) // 2
            assert live(spark, base) == before
            assert [f for f in os.listdir(f"{base}/changes") if f.startswith("batch")] == []     # old changes are gone
            assert len(os.listdir(f"{base}/snapshots/data")) == 1                                # and old versions
    assert TC.compact(spark, base) == 3 and TC.compact(spark, base) == 3


def test_a_replayed_batch_replaces_its_changes(spark, tmp):
    base = f"{tmp}/cache"
    SP.land_json(entries(spark, ROWS[:6]), f"{tmp}/in/0", files=1)
    TC.stream_ttl_cache(spark, f"{tmp}/in/*", base, f"{tmp}/ck", 60, timestamp_format=SP.TS_FORMAT)
    want = live(spark, base)
    last = max(int(f) for f in os.listdir(f"{tmp}/ck/commits") if f.isdigit())
    for name in (str(last), f".{last}.crc"):        # the run died before it noted the last batch
        if os.path.exists(f"{tmp}/ck/commits/{name}"):
            os.remove(f"{tmp}/ck/commits/{name}")
    TC.stream_ttl_cache(spark, f"{tmp}/in/*", base, f"{tmp}/ck", 60, timestamp_format=SP.TS_FORMAT)
    assert live(spark, base) == want


def offers(spark, rows):
    return spark.createDataFrame(rows, "run_id string, source string, position long, url string, landed_at timestamp")


def test_dedup_reads_only_the_batch_partitions(spark, tmp):
    rows = [(f"R{i % 3}", "olx", i, f"https://x.pl/{i % 50}", DAY) for i in range(300)]
    o = offers(spark, rows)
    for k in range(3):
        SP.land_json(o.where(F.col("position").between(100 * k, 100 * k + 99)), f"{tmp}/in/{k}", files=1)
    SP.stream_dedup(spark, f"{tmp}/in/*", o.schema, f"{tmp}/out", f"{tmp}/ck", files_per_trigger=1)
    got = spark.read.parquet(f"{tmp}/out")
    assert got.count() == got.select("run_id", "identity_key").distinct().count() == 150
    new = spark.createDataFrame([("R1", "https://x.pl/1"), ("R1", "https://x.pl/new")], "run_id string, identity_key string")
    plan = SP._unseen(new, got, 99)
    text = plan._jdf.queryExecution().executedPlan().toString()
    filters = text[text.index("PartitionFilters"):]
    assert "run_id" in filters.split("]")[0] + filters.split("]")[1] and "bucket" in filters[:400]
    assert [r.identity_key for r in plan.collect()] == ["https://x.pl/new"]


def documents(spark, parts):
    """parts: list of (run, source, first position, [urls])."""
    rows = [(r, s, p, len(u), [{"url": x, "title": f"t{p + i}", "salary_from": 1.0 * i} for i, x in enumerate(u)])
            for r, s, p, u in parts]
    return spark.createDataFrame(rows, "run_id string, source string, first long, count long, "
                                       "offers array<struct<url:string,title:string,salary_from:double>>")


def test_tracker_ids_run_on_over_batches_and_replays(spark, tmp):
    out = f"{tmp}/out"
    parts = [[("R1", "olx", 0, ["https://x.pl/a", "https://x.pl/b", "https://x.pl/a?x=1"]), ("R2", "olx", 0, ["https://x.pl/a"])],
             [("R1", "indeed", 0, ["https://x.pl/b", "https://x.pl/c"]), ("R1", "olx", 3, ["https://x.pl/d", ""])],
             [("R2", "olx", 1, ["https://x.pl/z", "https://x.pl/a"])]]
    for k, p in enumerate(parts):
        SP.land_json(documents(spark, p), f"{tmp}/in/{k}", files=1)
    SP.stream_tracker(spark, f"{tmp}/in/*", out, f"{tmp}/ck", files_per_trigger=1)
    read = lambda: sorted((r.run_id, r.id, r.url) for r in SP.read_stream_tracker(spark, out).collect())
    want = read()
    assert {(r, i) for r, i, _ in want} == {("R1", 1), ("R1", 2), ("R1", 3), ("R1", 4), ("R2", 1), ("R2", 2)}
    assert sorted(u for r, _, u in want if r == "R1") == [f"https://x.pl/{x}" for x in "abcd"]
    last = max(int(f) for f in os.listdir(f"{tmp}/ck/commits") if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{tmp}/ck/commits/{name}"):
            os.remove(f"{tmp}/ck/commits/{name}")
    SP.stream_tracker(spark, f"{tmp}/in/*", out, f"{tmp}/ck", files_per_trigger=1)
    assert read() == want
    SP.land_json(documents(spark, [("R1", "olx", 9, ["https://x.pl/late", "https://x.pl/c"])]), f"{tmp}/in/9", files=1)
    SP.stream_tracker(spark, f"{tmp}/in/*", out, f"{tmp}/ck", files_per_trigger=1)
    assert read() == sorted([*want, ("R1", 5, "https://x.pl/late")])


def numbers(spark, n):
    return spark.range(n).withColumnRenamed("id", "n")


def test_versions(spark, tmp):
    v = Versions(spark, f"{tmp}/t")
    assert v.current() is None and v.read(schema=numbers(spark, 1).schema).count() == 0
    with pytest.raises(FileNotFoundError):
        v.read()
    assert v.commit(numbers(spark, 3), note={"upto": 7}) == 1 and v.note() == {"upto": 7}
    v.stage(numbers(spark, 99), 2)                                          # a writer dies before its manifest
    assert v.current() == 1 and v.read().count() == 3
    assert v.commit(numbers(spark, 5), based_on=1) == 2
    with pytest.raises(VersionConflict):                                    # made from version 1, but 2 is there
        v.commit(numbers(spark, 7), based_on=1)
    with pytest.raises(VersionConflict):
        v.publish(2, v.stage(numbers(spark, 8), 2), numbers(spark, 1).schema)
    assert v.read().count() == 5 and v.read(1).count() == 3
    open(f"{tmp}/t/manifests/{3:020d}.json", "w").write('{"version": 3, "da')     # cut off while being written
    assert v.current() == 2 and v.read().count() == 5
    assert v.commit(numbers(spark, 6)) == 4 and v.read().count() == 6
    assert v.expire(keep=2) == [1] and v.read(2).count() == 5
    assert v.expire() == [2, 3] and v.read().count() == 6 and len(os.listdir(f"{tmp}/t/data")) == 1
    assert v.expire() == []
