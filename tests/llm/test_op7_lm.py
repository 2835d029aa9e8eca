import collections
import math
import re

import numpy as np
import pandas as pd
import pytest

from jobtide.llm import lm_score as L
from tests.llm.cases import SF, documents_of, empty_documents, odd_documents, spark_documents

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(frame, target, vocab):
    """vocab: the words of the vocabulary (ties in frequency are the operator's choice)."""
    docs = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)) for t in frame.text]
    ids = [None if i is pd.NA or i != i else int(i) for i in frame.doc_id.astype(object)]
    v, models = len(vocab) + 1, []
    seqs = [["<s>"] + [w if w in vocab else None for w in d] for d in docs]
    for keep in ([i in target for i in ids], [True] * len(ids)):
        pair, ctx, word = collections.Counter(), collections.Counter(), collections.Counter()
        for s, k in zip(seqs, keep):
            if k:
                pair.update(zip(s, s[1:]))
                ctx.update(s[:-1])
                word.update(s[1:])
        n = sum(word.values())
        models.append(lambda h, w, pair=pair, ctx=ctx, word=word, n=n:
                      -math.log((pair[h, w] + L.MASS * (word[w] + 1) / (n + v)) / (ctx[h] + L.MASS)))
    out = []
    for i, s in zip(ids, seqs):
        loss = [sum(m(h, w) for h, w in zip(s, s[1:])) / max(1, len(s) - 1) for m in models]
        out.append((-1 if i is None else i, len(s) - 1, *loss, loss[0] - loss[1]))
    return sorted(out)


@pytest.mark.parametrize("odd,size", [(True, 40), (False, 200)])
def test_equals_plain_model(spark, odd, size):
    frame = odd_documents() if odd else documents_of(SF)
    docs = spark_documents(spark, frame)
    words = collections.Counter(w for t in frame.text for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)))
    hashes = set(L.vocabulary(docs, size).tolist())
    hash_of = {}
    for w in words:
        one = spark_hash(w)
        hash_of[w] = one
    vocab = {w for w, h in hash_of.items() if h in hashes}
    assert len(vocab) == min(size - 1, len(words))
    assert min(words[w] for w in vocab) >= max((c for w, c in words.items() if w not in vocab), default=0)
    target = {int(i) for i in frame.doc_id.dropna() if int(i) % 3 == 0}
    ids = spark.createDataFrame([(i,) for i in sorted(target)] * 2, "doc_id long")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score)
                 for r in L.score(docs.repartition(3), ids, size).collect())
    want = expected(frame, target, vocab)
    np.testing.assert_allclose(np.array(got, float), np.array(want, float), atol=1e-9)


def spark_hash(word):
    import pyarrow as pa

    from jobtide.llm.bytescan import pieces
    p = next(pieces(pa.RecordBatch.from_arrays([pa.array([word])], ["text"])))
    p.words()
    return int(p.word_hashes(lower=True)[0])


def test_cases(spark):
    docs = spark_documents(spark)
    none = spark.createDataFrame([], "doc_id long")
    rows = L.score(docs, none).collect()
    assert len(rows) == docs.count() and all(r.score == 0 for r in rows if not r.n_tokens)
    assert L.score(empty_documents(spark), none).count() == 0
    two = spark.createDataFrame([(1, "a b a b a b"), (2, "c d c d c d"), (3, "a b a b"), (4, "c d c d")],
                                "doc_id long, text string")
    s = {r.doc_id: r.score for r in L.score(two, two.where("doc_id = 1").select("doc_id")).collect()}
    assert s[3] < 0 < s[4]


@pytest.mark.parametrize("words,pairs,flush", [(1 << 19, 1 << 19, 1 << 21), (300, 200, 500), (0, 0, 1 << 21)])
def test_no_word_is_left_out(spark, monkeypatch, words, pairs, flush):
    for name, value in (("MAX_WORDS", words), ("MAX_PAIRS", pairs), ("FLUSH", flush)):
        monkeypatch.setattr(L, name, value)
    base = documents_of(SF)
    frame = pd.concat([odd_documents()[list(base.columns)], base, base.head(5)])
    vocab = {w for t in frame.text for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))}
    assert len(vocab) > 2000
    target = {int(i) for i in frame.doc_id.dropna() if int(i) % 3 == 0}
    ids = spark.createDataFrame([(i,) for i in sorted(target)], "doc_id long")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score)
                 for r in L.score(spark_documents(spark, frame).repartition(3), ids).collect())
    np.testing.assert_allclose(np.array(got, float), np.array(expected(frame, target, vocab), float), atol=1e-9)


def test_rare_words_alone_tell_documents_apart(spark):
    common = [(i, f"w{i} " * 3) for i in range(100, 1300)]       # more words than the 1,023 once kept
    rare = [(1, "left right"), (2, "up down"), (3, "left right"), (4, "up down")]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string")
    s = {r.doc_id: r.score for r in L.score(docs, docs.where("doc_id = 1").select("doc_id")).collect()}
    assert s[3] < s[4]


def test_the_most_frequent_rows_stay_within_the_bound(spark):
    big = spark.range(100).selectExpr("id AS w", "65536L * 4 + id % 2 AS a")
    assert L._most(big, 3).count() == 0 and L._most(big, 100).count() == 100
    mixed = spark.createDataFrame([(i, c) for i, c in enumerate([1, 1, 1, 5, 5, 70_000, 1 << 20, 1 << 40])], "w long, a long")
    assert sorted(r.a for r in L._most(mixed, 4).collect()) == [70_000, 1 << 20, 1 << 40]
    assert sorted(r.a for r in L._most(mixed, 1).collect()) == [1 << 40]
    assert L._most(mixed, 8).count() == 8 and L._most(mixed.where("false"), 3).count() == 0


def test_blocks_grow_with_the_text_not_with_documents_times_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_WORDS", 0)
    monkeypatch.setattr(L, "MAX_PAIRS", 0)
    monkeypatch.setattr(L, "CHUNK", 3000)
    docs = spark_documents(spark, documents_of(SF)).repartition(2)
    one = L.score(docs, docs.select("doc_id").where("doc_id % 2 = 0")).collect()
    monkeypatch.setattr(L, "CHUNK", 1 << 19)
    monkeypatch.setattr(L, "FAN", 3)
    two = L.score(docs, docs.select("doc_id").where("doc_id % 2 = 0")).collect()
    plain = lambda rows: np.array(sorted(tuple(r) for r in rows), float)
    np.testing.assert_allclose(plain(one), plain(two), atol=1e-9)


def test_planes():
    for kind in (np.uint32, np.uint64):
        x = np.array([0, 1, 255, 256, 70_000, 2 ** 32 - 1], kind)
        assert (L._numbers(L._planes(x), kind) == x).all() and not len(L._numbers(L._planes(x[:0]), kind))
    assert L._planes(np.array([1, 2, 3], np.uint32)) == b"\1\2\3" + bytes(9)


def test_places_find_what_a_search_finds():
    rng = np.random.default_rng(5)
    top = np.uint64(2 ** 64 - 1)
    for keys in (rng.integers(0, 2 ** 64, 1000, np.uint64), top - rng.integers(0, 2000, 900, np.uint64), np.zeros(0, np.uint64), np.array([top])):
        keys = np.unique(keys)
        h = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), rng.integers(0, 2 ** 64, 500, np.uint64), np.array([0, 1, top], np.uint64)])
        assert (L._Places(keys).find(h) == L._find(keys, h)).all()
