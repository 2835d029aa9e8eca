import numpy as np
import pytest

from jobtide.llm import vector_codes as V

PATH = "/root/testdata/sf0.1/embeddings.parquet"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """Plain rounds over Python integers: {(vec_id, components): (code, error)}, final entries."""
    good = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) // parts
    x = np.array([v for _, v in good]).reshape(len(good), parts, width)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(axis=0).tolist()]
    code, d = nearest()
    return sorted(((i, "".join(f"{c:02x}" for c in cs), int(e)) for (i, _), cs, e in zip(good, code, d.sum(axis=1))), key=str), books


def got(df):
    return sorted(((r.vec_id, r.code, r.error) for r in df.collect()), key=str)


def test_whole_table_against_plain_rounds(spark):
    vectors = spark.read.parquet(PATH)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    coded, books = V.compress(vectors)
    want, entries = brute(rows)
    assert got(coded) == want and np.array_equal(books, entries)
    coded, books = V.compress(vectors, parts=4, entries=20, rounds=6)
    want, entries = brute(rows, 4, 20, 6)
    assert got(coded) == want and np.array_equal(books, entries)


def test_bounds_prove_assignments_and_never_change_them():
    """Many rounds on clustered points: the search is rare later, and every code is the exact nearest entry."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (12, 3))
    x = (centres[rng.integers(0, 12, 4000)] + rng.integers(-300, 300, (4000, 3))).astype(np.int64)
    history = [x[:12].copy()]
    code, bound = V.search(x, history[0])
    stamp, opened = np.zeros(len(x), np.uint8), []
    for _ in range(8):
        new = history[-1].copy()
        for e in np.unique(code):
            new[e] = x[code == e].sum(axis=0) // (code == e).sum()
        history.append(new)
        code, bound, stamp, open_ = V.reassign(x, code, bound, stamp, history)
        opened.append(len(open_))
        d = V.distances(x, new)
        assert np.array_equal(code, d.argmin(axis=1))
        d[np.arange(len(x)), code] = 1 << 60
        assert (bound - V.net_moves(history, 0).max() * 0 <= 1e9).all()
        for t in np.unique(stamp):       # a bound holds for the codebook of its stamp
            at = stamp == t
            then = V.distances(x[at], history[t]).astype(float)
            then[np.arange(at.sum()), code[at]] = np.inf
            assert (bound[at] <= np.sqrt(then.min(axis=1))).all()
    assert min(opened) < len(x) // 2


def test_net_moves_are_at_most_the_sum_of_steps():
    history = [np.array([[0, 0], [10, 0], [0, 10]]), np.array([[3, 4], [10, 1], [0, 10]]), np.array([[0, 0], [10, 2], [0, 11]])]
    assert V.net_moves(history, 0).tolist() == [2.0, 1.0, 2.0]      # entry 0 went and came back
    assert V.net_moves(history, 1).tolist() == [1.0, 5.0, 5.0]
    assert V.net_moves([h[:1] for h in history], 1).tolist() == [0.0]


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(5, [0.5, -0.25, 1.0, 2.0]), (5, [0.5, -0.25, 1.0, 2.0]), (7, [3.0, 1.0, -1.0, 0.001]), (None, [0.1, 0.2, 0.3, 0.4]),
            (9, [-0.001, 0.0, 0.0, 1e30]), (9, [-0.002, 0.0, 0.0, 0.0])]
    bad = [(1, None), (2, []), (3, [1.0, None, 0.0, 0.0]), (4, [nan, 0.0, 0.0, 0.0]), (6, [inf, 0.0, 0.0, 0.0]), (8, [1.0, 2.0])]
    rows = [(i, v, None if k % 2 else 3, "x") for k, (i, v) in enumerate(good + bad)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")
    most = V.limit(4) / 256
    clipped = [(i, [min(c, most) for c in v]) for i, v in good]
    coded, _ = V.compress(vectors, parts=2, entries=3, rounds=3)
    assert got(coded) == brute(clipped, 2, 3, 3)[0]
    few, books = V.compress(vectors.where("vec_id = 7"), parts=3, entries=64, rounds=1)      # four components in three parts
    assert got(few) == [(7, "000000", 0)] and books.tolist() == [[[768, 256]], [[-256, 0]], [[0, 0]]]
    none = V.digest(vectors.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        V.compress(vectors, entries=257)


def test_label_errors(spark, monkeypatch):
    rows = [(i, i % 3 if i % 4 else None, "00", i) for i in range(200)] + [(999, 7, "00", 2**62), (998, 7, "00", 2**62)]
    coded = spark.createDataFrame(rows, "vec_id long, label int, code string, error long")
    sums = {}
    for _, label, _, e in rows:
        sums[label] = sums.get(label, 0) + e
    sums[7] = None      # beyond a long
    for most in (V.MAX_LABELS, 1):
        monkeypatch.setattr(V, "MAX_LABELS", most)
        out = V.with_label_error(coded).collect()
        assert len(out) == len(rows) and all(r.label_error == sums[r.label] for r in out)
