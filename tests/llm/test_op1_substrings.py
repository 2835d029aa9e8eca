import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from jobtide.llm import bytescan, repeat_sketch, substring_dedup as S
from tests.llm.cases import PASSAGE, SF, documents_of, empty_documents, odd_documents, spark_documents

LAST = 1 << 63


def expected(frame):
    rows = [(LAST if i is pd.NA or i != i else int(i), re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            for i, t in zip(frame.doc_id.astype(object), frame.text)]
    least = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            least[g] = min(least.get(g, LAST), i)
    out = []
    for i, w in rows:
        gone = {j for k in range(len(w) - 12) if least[tuple(w[k:k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


@pytest.mark.parametrize("flush", [1 << 21, 50])
def test_equals_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(S, "FLUSH", flush)
    for frame in (odd_documents(), documents_of(SF)):
        assert got(S.dedup(spark_documents(spark, frame).repartition(3), whole_text=False)) == expected(frame)


def test_texts_and_empty_table(spark):
    kept = {r.doc_id: r.kept for r in S.dedup(spark_documents(spark)).collect()}
    assert kept[20] == "before after" and kept[21] == "and more" and kept[5] == PASSAGE and kept[22] == ""
    assert S.dedup(empty_documents(spark)).count() == 0


def test_places_longer_than_a_span():
    n = 200_000
    k = np.arange(n)
    both = lambda x: np.concatenate([x, x])
    rows = list(S._decide(both(k), both(k).astype(np.int32), np.repeat([1, 2], n), both(k << 16 | 1)))
    table = pa.Table.from_batches(rows)
    places = table.filter(pa.compute.equal(table["k2"], -1))["place"].to_numpy()
    assert S.removed_words(places, n + 12, 13).all() and len(places) == 4


def test_words_and_windows_from_buffers():
    texts = ["a bb  a\tbb", None, "", "  a bb a bb c ", "é\x0bü\x1fx é", "a bb"]
    for arr in (pa.array(texts), pa.array(["x"] + texts).slice(1)):
        p = next(bytescan.pieces(pa.RecordBatch.from_arrays([arr], ["text"])))
        p.words()
        words = [bytes(p.data[s:e]) for s, e in zip(p.starts, p.ends)]
        assert words == [w.encode() for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        h = p.word_hashes()
        assert len(set(h.tolist())) == len(set(words))
        g, at = p.windows(h, 2)
        grams = [words[i:i + 2] for i in at]
        assert len({tuple(x) for x in grams}) == len(set(g.tolist()))
        assert len(grams) == 3 + 4 + 2 + 1


def test_sketch_never_loses_a_repeated_hash(spark, monkeypatch):
    monkeypatch.setattr(repeat_sketch, "FLUSH", 1000)
    values = np.random.default_rng(1).integers(0, 1 << 63, 4000).astype(np.uint64)
    values = np.concatenate([values, values[:300], values[:10]])
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(5)
    hashes = lambda bs: (b.column(0).to_numpy().view(np.uint64) for b in bs)
    for n, fan in ((3, 1), (2, 3)):
        parts = df.mapInArrow(lambda bs: repeat_sketch.sketch_parts(hashes(bs), n, fan), repeat_sketch.SCHEMA)
        sketch = repeat_sketch.Repeated(parts, n, fan)
        sketch.held._value = repeat_sketch._Bits(list(sketch.held.value.blobs))    # as a worker would open it
        assert sketch.maybe(values[:300]).all() and sketch.maybe(values[300:4000]).mean() < 0.05


@pytest.mark.parametrize("bound", [1 << 19, 0])
def test_many_texts_without_id_keep_their_own_words(spark, monkeypatch, bound):
    monkeypatch.setattr(S, "MAX_BROADCAST", bound)
    shared = " ".join(f"s{j}" for j in range(13))
    # 50,000 null-id rows of different lengths: the shared window stands elsewhere in each
    texts = [" ".join([f"t{i}"] * (i % 9) + [shared] * (i % 4 == 0) + [f"u{i}"]) for i in range(50_000)]
    frame = pd.DataFrame({"doc_id": pd.array([None] * len(texts) + [1], "Int64"), "text": texts + [shared],
                          "lang": "en", "source": "s", "n_chars": pd.array([1] * (len(texts) + 1), "Int64")})
    assert got(S.dedup(spark_documents(spark, frame).repartition(3), whole_text=False)) == expected(frame)
