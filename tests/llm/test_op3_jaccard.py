import itertools
import random
import re

import pandas as pd
import pytest

from jobtide.llm import jaccard_join as J
from jobtide.llm.components import components
from tests.llm.cases import documents_of, empty_documents, odd_documents, spark_documents

LAST = (1 << 63) - 1
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def expected(frame, size=4, percent=85):
    ids = [LAST if i is pd.NA or i != i else int(i) for i in frame.doc_id.astype(object)]
    sets = [shingles(t, size) for t in frame.text]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for k, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    seen = set()
    for ks in holders.values():
        for a, b in itertools.combinations(ks, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(ids[a]), find(ids[b])
                    root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in zip(ids, sets))


def got(df):
    return sorted((LAST if r.doc_id is None else r.doc_id, r.n_shingles,
                   LAST if r.component_id is None else r.component_id) for r in df.collect())


def family(seed, n=60, words=80):
    """Copies of one text, each with a few words changed: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        if i % 7 == 0:
            w = w[:rng.randrange(words // 2, words)]
        rows.append((rng.randrange(10**6) * 100 + i, " ".join(w), "en", "s", 1))
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_families_on_both_sides_of_the_threshold(spark, size, percent):
    frame = pd.concat([family(s) for s in range(3)])
    want = expected(frame, size, percent)
    assert got(J.join(spark_documents(spark, frame).repartition(4), size, percent)) == want
    assert len({r[2] for r in want}) > 5


def test_equals_brute_force(spark):
    frame = odd_documents()
    assert got(J.join(spark_documents(spark, frame))) == expected(frame)
    frame = documents_of("/root/testdata/sf0.01")
    assert got(J.join(spark_documents(spark, frame))) == expected(frame)
    assert J.join(empty_documents(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    frame = family(9)
    docs = spark_documents(spark, frame)
    groups = {r[2] for r in expected(frame, 5, 80)}
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == groups
    odd = spark_documents(spark)
    assert J.keep_one(odd).where("text is null or text = ''").count() == odd.where("text is null or text = ''").count()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)] + [(500, i) for i in range(501, 560)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[150] == 100 and got[559] == 500


def test_rows_of_one_id_with_different_texts(spark):
    words = [[f"{c}{i}" for i in range(103)] for c in "abcdef"]
    near = lambda w: " ".join(w[:-1] + ["z"])
    a, b, c, d, e, f = (" ".join(w) for w in words)
    # id 10 holds three sets of one size, each like another document; null-id rows resemble 5 and 6
    rows = [(10, a), (10, b), (10, c), (1, near(words[0])), (2, near(words[1])), (3, near(words[2])),
            (None, d), (None, e), (5, near(words[3])), (6, near(words[4])), (7, f)]
    frame = pd.DataFrame([(i, t, "en", "s", 1) for i, t in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])
    frame["doc_id"] = pd.array([i for i, _ in rows], "Int64")
    docs = spark_documents(spark, frame)
    assert got(J.join(docs)) == expected(frame)
    kept = [r.doc_id for r in J.keep_one(docs).collect()]
    assert sorted(i for i in kept if i) == [1, 5, 6, 7] and kept.count(None) == 2
