import hashlib
import re

import pandas as pd

from jobtide.llm import decontaminate as D
from tests.llm.cases import PASSAGE, SF, documents_of, empty_documents, odd_documents, spark_documents

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def expected(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(0, min(len(w), len(w) - 9) if len(w) >= 10 else min(1, len(w)))):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in df.collect())


def rows_of(frame):
    return [(-1 if i is pd.NA or i != i else int(i), t) for i, t in zip(frame.doc_id.astype(object), frame.text)]


ODD_ITEMS = [(1, PASSAGE), (2, PASSAGE[40:300]), (3, None), (4, ""), (5, "..."), (6, "one"), (7, "THREE; four"),
             (8, "word " * 12), (9, "word " * 9), (10, PASSAGE), (None, "tail"), (11, "ünï ÇÉ ñandú " * 4)]


def test_equals_brute_force(spark):
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    frame = odd_documents()
    some = [x for x in ODD_ITEMS if x[0] is not None]
    assert got(D.judge(spark_documents(spark, frame), items.where("item_id is not null"))) == expected(rows_of(frame), some)
    assert D.judge(spark_documents(spark, frame), items).count() == len(frame)
    frame, bench = documents_of(SF), pd.read_parquet(f"{SF}/benchmark.parquet")
    bench = list(zip(bench.item_id, bench.text))
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = expected(rows_of(frame), bench)
    assert got(D.judge(spark_documents(spark, frame), items)) == want and any(r[-1] for r in want)


def test_shuffled_benchmark_gives_the_same(spark, monkeypatch):
    items = spark.createDataFrame(ODD_ITEMS[:-2], "item_id long, text string")
    want = got(D.judge(spark_documents(spark), items))
    monkeypatch.setattr(D, "MAX_BROADCAST", 0)
    assert got(D.judge(spark_documents(spark), items)) == want


def test_empty_tables_and_clean(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark_documents(spark)
    assert {r.contaminated for r in D.judge(docs, none).collect()} == {False}
    assert D.judge(empty_documents(spark), none).count() == 0
    left = D.clean(docs, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string"))
    assert left.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()}
    assert gone == {5, 19, 20, 21, 22} and left.where("text is null").count() == 2


def test_no_python_in_the_plan(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = D.judge(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
