import hashlib

import pandas as pd

import corpus_pipeline as C
from jobtide.llm import line_dedup, toxicity
from tests.llm import test_op3_jaccard as op3, test_op8_decontamination as op8
from tests.llm.cases import SF, documents_of, folder, spark_documents
from tests.llm.test_op2_lines import key


def without_lines(frame):
    holders = {}
    for i, t in zip(frame.doc_id, frame.text):
        for x in t.split("\n"):
            if len(key(x)) >= line_dedup.MIN_CHARS:
                holders.setdefault(key(x), set()).add(i)
    keep = lambda i, x: not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]))
    texts = ["\n".join(x for x in t.split("\n") if keep(i, x)) for i, t in zip(frame.doc_id, frame.text)]
    return frame.assign(text=texts)


def test_run_equals_brute_force(spark):
    frame = documents_of(SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(toxicity.sample(spark.read.parquet(f"{SF}/documents.parquet"), labels))
    odds = [model.odds(toxicity._WORD.findall(t.lower())) for t in frame.text]
    frame = frame[model.score(model.marginals(odds)) < toxicity.THRESHOLD]
    frame = without_lines(frame)
    frame = frame[[i == c for i, c in sorted_components(frame)]]
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    bad = {r[0] for r in op8.expected(op8.rows_of(frame), list(zip(bench.item_id, bench.text))) if r[-1]}
    frame = frame[~frame.doc_id.isin(bad)]
    want = sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(frame.doc_id, frame.text))
    got = sorted((r.doc_id, r.decoded_sha256) for r in C.run(spark, SF).collect())
    assert got == want and 100 < len(want) < 200


def sorted_components(frame):
    comp = {r[0]: r[2] if r[1] else r[0] for r in op3.expected(frame, 5, 80)}
    return [(i, comp[i]) for i in frame.doc_id]


def test_stages_keep_the_columns_and_odd_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.createDataFrame([(1, None), (2, "word " * 12)], "item_id long, text string")
    docs = spark_documents(spark).drop("k1", "pos", "items", "words")
    for rows in (docs, docs.where("false")):
        sf = folder(spark, documents=rows, labels=labels, benchmark=bench)
        out = rows
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, out, sf)
            assert out.columns == docs.columns, name
        got = {r.doc_id for r in out.collect()}
        assert C.run(spark, sf).count() == out.count()
        assert (not got) or {10, 11, 12} <= got and not {23, 24} & got
