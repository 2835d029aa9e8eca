import zlib

import numpy as np

from jobtide.llm import sharding as S
from tests.llm.cases import SF, documents_of, empty_documents, folder, odd_documents, spark_documents


def check(frame, rows):
    want = sorted((-1 if i is None or i != i else int(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                  for i, t in zip(frame.doc_id.astype(object).where(frame.doc_id.notna(), None), frame.text))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = {}
    for r in rows:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    for mine in by.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    return np.array([sum(r["size"] for r in by.get(s, [])) for s in range(16)])


def test_assignment(spark):
    check(odd_documents(), S.assign(spark_documents(spark)).collect())
    frame = documents_of("/root/testdata/sf0.01")
    load = check(frame, S.assign(spark_documents(spark, frame)).collect())
    assert load.max() - load.min() < 0.01 * load.mean()
    assert S.assign(empty_documents(spark)).count() == 0


def test_map_versions(spark):
    path = folder(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    S.assign(docs, map_path=path).count()
    old, new = S.read_map(spark, path, 0), S.read_map(spark, path, 1)
    assert (old == S.initial_map()).all() and (old != new).any()
    size, _ = S.slot_weights(S.with_slots(docs), S.N_SLOTS)
    grown = S.grow(new, size, 16)
    assert ((grown == new) | (grown == 16)).all()
    load = np.bincount(grown, weights=size, minlength=17)
    assert load[16] > 0.5 * load.mean() and load.sum() == size.sum()


def test_rebalancing_goes_on_until_no_step_helps():
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 100, 4096)
    owner = np.zeros(4096, np.int64)                 # all on one shard
    new = S.rebalance(owner, weights, 16)
    load = np.bincount(new, weights=weights, minlength=16)
    assert load.max() - load.min() <= 1 and load.sum() == weights.sum()
    one = S.rebalance(np.zeros(5, np.int64), np.array([7, 0, 0, 0, 0]), 4)
    assert np.bincount(one, weights=[7, 0, 0, 0, 0], minlength=4).max() == 7
