import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from jobtide.llm import resampling as R
from tests.llm.cases import SF, documents_of, empty_documents, odd_documents, spark_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, runs=1):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=10, runs=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, texts in ((s, docs.text), (t, target)):
        for text in texts:
            counts.update(map(bucket, features(text, runs)[1]))
    ss, tt, rows = sum(s.values()), sum(t.values()), []
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets))))
    for doc, text in zip(docs.doc_id, docs.text):
        doc = None if pd.isna(doc) else int(doc)
        n_words, f = features(text, runs)
        weight = sum(gain(bucket(x)) for x in f) // max(len(f), 1)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    place = {id(r): i + 1 for i, r in enumerate(able[:percent * len(able) // 100])}
    return sorted(((*r[:4], place.get(id(r))) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_crc_matrices_equal_zlib():
    rng = np.random.default_rng(2)
    sizes = np.concatenate([rng.integers(1, 40, 3000), [700, 1, 700, 5000]])
    data = rng.integers(0, 3, int(sizes.sum())).astype(np.uint8)
    starts = np.cumsum(sizes) - sizes
    want = [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(starts, sizes)]
    assert R.crcs(data, starts, sizes).tolist() == want
    assert R.crcs(data, starts[:0], sizes[:0]).tolist() == []


def test_documents_against_brute_force(spark):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    for frame in (documents_of(SF), odd_documents()):
        docs = spark_documents(spark, frame)
        assert got(R.resample(docs, target)) == brute(frame, bench.text)
        assert got(R.resample(docs, target, percent=60, runs=3, buckets=97)) == brute(frame, bench.text, 60, 3, 97)


def test_pieces_of_texts_and_null_target(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = ["aB", "Zz9", "ñandú", "日本", "x", "The", "\x00", "--", "é\x80"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", ",", "_", ""]) for _ in range(n)) for n in rng.integers(0, 200, 120)]
    frame = pd.DataFrame({"doc_id": range(120), "text": [*texts[:118], "word " * 400_000, None], "lang": "x", "source": "x", "n_chars": 1})
    target = spark.createDataFrame([(None,), ("the x",)], "text string")
    assert got(R.resample(spark_documents(spark, frame), target, percent=35)) == brute(frame, [None, "the x"], 35)
    assert got(R.resample(spark_documents(spark, frame), target.where("false"), percent=35)) == brute(frame, [], 35)


def test_hot_equal_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    frame = pd.DataFrame({"doc_id": pd.array([None] * 400 + list(range(200)), "Int64"), "text": [text] * 400 + [f"{text} {i}" for i in range(200)],
                          "lang": "x", "source": "x", "n_chars": 1})
    target = spark.createDataFrame([("w1 w2",)], "text string")
    out = got(R.resample(spark_documents(spark, frame), target, percent=50))
    assert out == brute(frame, ["w1 w2"], 50)
    assert sorted(r[4] for r in out if r[4]) == list(range(1, 301))
    assert got(R.resample(empty_documents(spark), target)) == []
