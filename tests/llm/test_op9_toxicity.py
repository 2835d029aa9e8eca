import itertools
import zlib

import numpy as np
import pandas as pd

from jobtide.llm import toxicity as T
from tests.llm.cases import SF, empty_documents, spark_documents


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    step = rng.normal(size=(2, 2))
    model = T.Model({}, 0.0, step, None)
    texts = [rng.normal(size=n) for n in (0, 1, 4, 7, 7, 2)]
    for odds, got in zip(texts, model.marginals(texts)):
        total, hit = 0.0, np.zeros(len(odds))
        for path in itertools.product((0, 1), repeat=len(odds)):
            w = np.exp(sum(o * s for o, s in zip(odds, path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
            total += w
            hit += w * np.array(path)
        np.testing.assert_allclose(got, hit / total if len(odds) else hit, atol=1e-12)


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = T.sample(docs, labels)
    assert len(rows) <= T.MAX_TOXIC + T.MAX_CLEAN
    got = {r.doc_id: r for r in T.score(docs, T.fit(rows)).collect()}
    assert len(got) == docs.count() and all(r.held_out == held(i) for i, r in got.items())
    test = [(got[i].score, got[i].predicted, y) for i, y in labels.select("doc_id", "toxic").collect() if held(i)]
    hit = sum(p for _, p, y in test if y)
    assert hit / sum(y for *_, y in test) > 0.85 and hit / sum(p for _, p, _ in test) > 0.95
    assert all(0 <= s <= 1 and p == (s >= 0.7) for s, p, _ in test)
    texts = {r.doc_id: r.text.lower() for r in docs.collect()}
    for i, r in got.items():
        assert all(texts[i][s.start:s.end].strip() for s in r.spans)


def test_held_out_labels_and_other_columns_are_never_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    flip = labels.copy()
    out = flip.doc_id.map(held)
    flip.loc[out, "toxic"] = 1 - flip.loc[out, "toxic"]
    a, b = (T.sample(docs, spark.createDataFrame(x)) for x in (labels, flip))
    assert a == b


def test_cases(spark):
    model = T.Model({"=bad": 9.0}, -4.0, np.zeros((2, 2)), np.array([-4.0, 2.0, 6.0]))
    docs = spark_documents(spark)
    rows = T.score(docs, model).collect()
    assert len(rows) == docs.count() and all(r.predicted == 0 for r in rows)
    more = spark.createDataFrame([(1, "so Bad bad, fine\nBAD"), (1, "so Bad bad, fine\nBAD"), (2, "fine"), (3, None)],
                                 "doc_id long, text string")
    got = T.score(more, model).collect()
    assert [r.predicted for r in got] == [1, 1, 0, 0] and got[0] == got[1]
    assert [(s.start, s.end) for s in got[0].spans] == [(3, 10), (17, 20)]
    assert [r.doc_id for r in T.keep_clean(more, model).collect()] == [2, 3]
    assert T.keep_clean(docs, model).columns == docs.columns
    assert T.score(empty_documents(spark), model).count() == 0
    labels = spark.createDataFrame([(1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    none = T.fit(T.sample(more, labels))
    assert {r.score for r in T.score(more, none).collect()} == {0.0}


def test_fit_without_repeated_words():
    model = T.fit([("alpha beta", 1), ("gamma delta", 0), (None, 0)])
    assert model.score(model.marginals([np.zeros(0)])).shape == (1,)
