import collections
import hashlib

import numpy as np

from jobtide.llm import line_dedup as L
from tests.llm.cases import documents_of, empty_documents, odd_documents, spark_documents, SF

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UP)


def expected(frame):
    rows = [(-1 if i is None or i != i else int(i), t or "") for i, t in zip(frame.doc_id.astype(object).where(
        frame.doc_id.notna(), None), frame.text)]
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def test_digest_equals_brute_force(spark):
    for frame in (odd_documents(), documents_of(SF)):
        assert got(L.digest(spark_documents(spark, frame))) == expected(frame)


def test_empty_table_and_apply_keeps_columns(spark):
    assert L.digest(empty_documents(spark)).count() == 0
    docs = spark_documents(spark)
    out = L.apply(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[16] == "own a" and texts[17] == "x\ny" and texts[10] is None and texts[27] == "tail\n"


def test_deleting_documents_brings_lines_back(spark):
    docs = spark_documents(spark)
    first = L.insert(None, docs.where("doc_id <= 16"))
    both = L.insert(first, docs.where("doc_id > 16"))
    assert sorted(both.collect()) == sorted(L.insert(both, docs.where("doc_id > 12")).collect())
    less = L.delete(both, docs.where("doc_id in (17, 18)").select("doc_id"))
    kept = {r.doc_id: r.text for r in L.apply(docs.where("doc_id in (15, 16)"), less).collect()}
    assert kept[16] == docs.where("doc_id = 16").first().text       # two holders left: nothing goes
    assert L.apply(docs.where("doc_id = 16"), both).first().text == "own a"


def test_cuckoo_filter_inserts_and_removes():
    keys = np.random.default_rng(3).integers(-2**62, 2**62, 50_000)
    f = L.build_filter(keys)
    assert f.contains(keys).all()
    other = np.random.default_rng(4).integers(-2**62, 2**62, 50_000)
    assert f.contains(other).mean() < 0.01
    f.remove(keys[:25_000])
    assert f.contains(keys[25_000:]).all() and f.contains(keys[:25_000]).mean() < 0.01


def test_filters_follow_the_reference_table(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id) as k1", "xxhash64(id, 5) as k2", "id")
    made = L.shard_filters(keys.where("id < 1000"), 4)
    new = L.update_filters(made, keys.where("id >= 1000 and id < 1100"), keys.where("id < 500"), 4)
    left = {r.id for r in L.maybe_in(keys, new, 4).collect()}
    assert set(range(500, 1100)) <= left and len(left) < 620


def test_a_full_filter_rules_nothing_out_until_it_is_built_anew(spark):
    keys = spark.range(6000).selectExpr("xxhash64(id) as k1", "xxhash64(id, 5) as k2", "id")
    made = L.shard_filters(keys.where("id < 1000"), 4)
    grown = L.update_filters(made, keys.where("id between 1000 and 4999"), keys.where("id < 10"), 4)
    assert grown.where("length(filter) = 0").count() > 0
    held = set(range(10, 5000))
    assert held <= {r.id for r in L.maybe_in(keys, grown, 4).collect()}
    refs = keys.where("id between 10 and 4999")
    anew = L.rebuild_full(grown, refs, 4)
    assert anew.where("length(filter) = 0").count() == 0 and anew.count() == 4
    left = {r.id for r in L.maybe_in(keys, anew, 4).collect()}
    assert held <= left and len(left) < 5100
    assert L.rebuild_full(anew, refs, 4) is anew


def test_deleting_documents_brings_their_lines_back(spark):
    import pandas as pd
    texts = {1: "A line that repeats here.\none", 2: "A line that repeats here.\ntwo", 3: "A line that repeats here.\nthree", 4: "other\n"}
    docs = spark_documents(spark, pd.DataFrame({"doc_id": list(texts), "text": list(texts.values()), "lang": "x", "source": "x", "n_chars": 1}))
    held = L.insert(None, docs)
    cut = {r.doc_id: r.text for r in L.apply(docs, held).collect()}
    assert cut[1] == "one" and cut[2] == "two" and cut[3] == texts[3]
    two = spark.createDataFrame([(3,)], "doc_id long")
    left = L.delete(held, two)
    rest = docs.where("doc_id <> 3")
    assert {r.doc_id: r.text for r in L.apply(rest, left).collect()} == {i: t for i, t in texts.items() if i != 3}
    again = L.insert(left, docs.where("doc_id = 3"))
    assert {r.doc_id: r.text for r in L.apply(docs, again).collect()} == cut
