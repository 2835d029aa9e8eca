import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from jobtide.llm import token_files as T
from tests.llm.cases import SF, documents_of, empty_documents, folder, odd_documents, spark_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(frame):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    rows = [(-1 if i is None or i != i else int(i), t or "") for i, t in zip(frame.doc_id.astype(object).where(
        frame.doc_id.notna(), None), frame.text)]
    for i, t in sorted(rows, key=lambda r: (r[0], zlib.crc32(r[1].encode()))):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out)


def test_files_hold_the_ids(spark):
    for frame, size in ((odd_documents(), 500), (documents_of(SF), 20_000)):
        out = folder(spark) + "/files"
        T.write_files(spark_documents(spark, frame), PATH, out, shard_tokens=size, parts=3)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32)
                     for r in T.read_files(spark, out).collect())
        assert got == expected(frame)
        files = spark.read.parquet(out).inputFiles()
        assert len(files) == spark.read.parquet(out).count() > 3    # one file per shard
    out = folder(spark) + "/files"
    T.write_files(empty_documents(spark), PATH, out)
    assert T.read_files(spark, out).count() == 0


def test_odd_words_are_encoded_as_the_library_does():
    tok, words = Tokenizer.from_file(PATH), T.WordEncoder(PATH)
    texts = ["a  b\tc d\x1fe f", "<|endoftext|> Hi<|startoftext|>X", "Ünï é é ́x", "ΣΑΣ İ I'll don't 12³ ΟΔΟΣ",
             "日本 語text한국", "a\r\nb\n\n c ", "end. Stop, it..", "ª µ ß ĳ ŉ ǆ ﬁ", "., . ,", "it's 's x's, re're."]
    for _ in range(2):
        for text, raw in zip(texts, words.encode(texts)):
            assert np.frombuffer(raw, np.uint32).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    for n, top in ((1, 1), (700, 3), (5000, 900), (4096, 70_000)):
        ids = (rng.integers(0, top, n) ** 2 // max(1, top)).astype(np.uint32)
        w = T.WaveletMatrix.build(ids)
        at = rng.integers(0, n, 50)
        assert (w.ids() == ids).all() and (w.access(at) == ids[at]).all()
        for token in {int(ids[0]), int(ids[-1]), 999_999}:
            assert w.count(token) == (ids == token).sum()
            assert w.count(token, n // 2) == (ids[:n // 2] == token).sum()
            assert (w.locate(token) == np.flatnonzero(ids == token)).all()


def test_words_cut_on_the_buffers_are_the_library_words():
    tok, words = Tokenizer.from_file(PATH), T.WordEncoder(PATH)
    texts = ["H\u0331ello T\u0308 J\u030c W\u030a Y\u030a I\u0307", "WOW!! hey?!... a<b> <|x|> {Z} [q]; 'tis rock'n'roll' I'LL", "É Été ÀB",
             "", None, "\n\n", "A\nB C", "x--y -z- _a_ #b $5 %c &d (e) *f +g, /h: =i @j \\k ^l `m |n ~o", "ab'cd' ef'", "Ünï!? 1.5 v2."]
    end = 2
    ids, sizes = words.flat(pa.array(texts, pa.string()), end)
    want = [tok.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]
    assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == want[0]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    ids, sizes = words.flat(pa.array([], pa.string()), end)
    assert not len(ids) and not len(sizes)


def test_one_id_for_many_rows_is_spread_over_parts(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(7, "same")] * 300 + [(i, "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = folder(spark) + "/files"
    T.write_files(docs, PATH, out, parts=8)
    per = [len(r.doc_ids) for r in spark.read.parquet(out).collect()]
    assert sum(per) == 900 and max(per) < 250
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in T.read_files(spark, out).collect())
    import pandas as pd
    assert got == expected(pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]}))
