import numpy as np
import pandas as pd
import pytest

from jobtide.llm import ann as A


def expected(ids, x, queries, k=5):
    out = {}
    norm = np.sqrt((x * x).sum(axis=1))
    for q in queries:
        i = list(ids).index(q)
        s = (x * x[i]).sum(axis=1) / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_over_the_whole_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    frame, vectors = pd.read_parquet(path), spark.read.parquet(path)
    got = collected(A.search(vectors, vectors.where("vec_id % 50 = 0")))
    ids = frame.vec_id.to_numpy()
    want = expected(ids, np.stack(frame.embedding).astype(float), ids[ids % 50 == 0])
    assert got.keys() == want.keys()
    right = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert right >= 0.93 * 5 * len(want)
    true = {q: dict(expected(ids, np.stack(frame.embedding).astype(float), [q], k=len(ids))[q]) for q in list(want)[:3]}
    for q in true:
        assert all(abs(true[q][i] - s) < 1e-12 for i, s in got[q])


ODD = [(0, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0]), (100, [0.0, 0.0, 0.0]), (150, None), (200, [1.0, None, 0.0]),
       (250, [float("nan"), 1.0, 0.0]), (300, [float("inf"), 1.0, 0.0]), (350, []), (3, [2.0, 0.0, 0.0]),
       (4, [0.9, 0.1, 0.0]), (5, [0.0, 1.0, 0.5]), (6, [-1.0, 0.0, 0.0]), (6, [-1.0, 0.0, 0.0]), (7, [1.0, 2.0]),
       (None, [1.0, 1.0, 1.0])]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_cases(spark, kind):
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in ODD], f"vec_id long, embedding array<{kind}>, id string, list int")
    got = collected(A.search(vectors, vectors.where("vec_id % 50 = 0")))
    good = [(i, v) for i, v in ODD[:-3] if i in (0, 50, 3, 4, 5, 6)]
    want = expected(np.array([i for i, _ in good]), np.array([v for _, v in good], np.dtype(kind if kind != "float" else "f4")).astype(float), [0, 50])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [i for i, _ in got[0]][:2] == [3, 50]
    few = spark.createDataFrame(ODD[:2], "vec_id long, embedding array<float>")
    assert collected(A.search(few, few)) == {0: [(50, 1.0)], 50: [(0, 1.0)]}
    assert A.search(few.where("false"), few).count() == 0


def test_hot_vector_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[100]
    frame = pd.DataFrame({"vec_id": np.arange(300), "embedding": [v.tolist() for v in x]})
    vectors = spark.createDataFrame(frame)
    got = collected(A.search(vectors, vectors.where("vec_id % 50 = 0"), prune=10.0))
    want = expected(np.arange(300), x, range(0, 300, 50))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(3)
    c = A.Centroids(A._unit(rng.normal(size=(500, 16))))
    x = A._unit(rng.normal(size=(100, 16)))
    ids, far = c.search(x, 24)
    sim = x @ c.points.T
    assert (ids[:, 0] == sim.argmax(axis=1)).mean() > 0.97 and (np.diff(far, axis=1) >= 0).all()
    assert all(len(set(r)) == 24 for r in ids)
    everything, _ = c.search(x, 500)
    assert all(len(set(r)) == 500 for r in everything)


def test_small_clusters_get_all_their_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "PER_LIST", 16)
    rng = np.random.default_rng(5)
    sizes = [300] + [1, 2, 3, 4, 5] * 12          # one large cluster and sixty of fewer than 6
    middle = A._unit(rng.normal(size=(len(sizes), 12)))
    x = np.concatenate([m + 0.001 * rng.normal(size=(n, 12)) for m, n in zip(middle, sizes)])
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [v.tolist() for v in x]}))
    got = collected(A.search(vectors, vectors))
    want = expected(np.arange(len(x)), x, range(len(x)))
    assert got.keys() == want.keys() and all(len(rows) == 5 for rows in got.values())
    right = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert right >= 0.95 * 5 * len(want)


def test_extreme_magnitudes(spark):
    rows = [(0, [1e-200, 1e-200]), (50, [1.0, 0.0]), (1, [1e200, 1e200]), (2, [1.0, 2.0]), (3, [5e-324, 0.0]), (4, [-1e308, 1e308])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(A.search(vectors, vectors.where("vec_id % 50 = 0")))
    half, wide = 1 / np.sqrt(2), 3 / np.sqrt(10)
    want = {0: [(1, 1.0), (2, wide), (3, half), (50, half), (4, 0.0)],
            50: [(3, 1.0), (0, half), (1, half), (2, 1 / np.sqrt(5)), (4, -half)]}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(s - w) < 1e-15 for q in want for (_, s), (_, w) in zip(got[q], want[q]))
