import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from jobtide.llm import byte_pairs as B
from tests.llm.cases import SF, documents_of, empty_documents, odd_documents, spark_documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.load(PATH), special_tokens={})


@pytest.fixture(scope="module")
def pairs(spark):
    return B.BytePairs.load(spark, PATH, public_tokenizers.PATTERN)


def wanted(library, frame):
    out = []
    for doc, text in zip(frame.doc_id, frame.text):
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        out.append((None if pd.isna(doc) else int(doc), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def test_documents_equal_the_library(spark, pairs, library):
    for frame in (odd_documents(), documents_of(SF)):
        docs = spark_documents(spark, frame)
        assert got(B.encode(docs, pairs)) == wanted(library, frame)
    # many small blocks and folds: words of several blocks meet, rows of words are cut
    assert got(B.encode(docs, pairs, block=500, fold=7)) == wanted(library, frame)


def test_ids_decode_to_the_texts(spark, pairs, library):
    frame = odd_documents()
    out = B.encode(spark_documents(spark, frame), pairs)
    assert {(r.doc_id, tuple(r.ids)) for r in out.collect()} == {
        (None if i is pd.NA else i, tuple(library.encode_ordinary(t or ""))) for i, t in zip(frame.doc_id, frame.text)}
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in B.decode(out, pairs).collect()) == sorted(
        (str(None if i is pd.NA else i), (t or "").encode()) for i, t in zip(frame.doc_id, frame.text))
    odd = spark.createDataFrame([(1, [1, None, 99_999_999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.bytes) for r in B.decode(odd, pairs).collect()} == {1: library.decode_bytes([1]), 2: b"", 3: b""}


def test_words_of_all_kinds(spark, pairs, library):
    rng = np.random.default_rng(5)
    alphabet = list("aeinorst' \n\t.!?0129éèßøЖдあ漢字한😀‍\x00\x85\xa0 　") + ["\U00016100", "ᲊ", "\U00010d40", "'ll", "  "]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(1500)]
    texts += ["a" * 300, "ab" * 200, " " * 100 + "x", "!" * 90, "日本語" * 60, "I'll we've I'd 'Ll", "\n\n  x", "x  ", "x \n", "\r\n y"]
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "x", "source": "x", "n_chars": 1})
    assert got(B.encode(spark_documents(spark, frame), pairs)) == wanted(library, frame)


def test_every_character_is_cut_as_the_library_cuts_it(spark, pairs, library):
    points = [c for c in [*range(0x3000), *range(0xA640, 0xABFF), *range(0xF900, 0x11000, 3), *range(0x11000, 0x1F000, 7)]
              if not 0xD800 <= c < 0xE000]
    frame = pd.DataFrame({"doc_id": points, "text": [f"a{chr(c)}a1{chr(c)}1 {chr(c)} !{chr(c)}" for c in points],
                          "lang": "x", "source": "x", "n_chars": 1})
    assert got(B.encode(spark_documents(spark, frame), pairs)) == wanted(library, frame)


def test_a_vocabulary_whose_joined_pieces_rank_below_their_parts(spark):
    ranks = {bytes([b]): b + 10 for b in range(256)}
    ranks |= {b"abc": 0, b"ab": 5, b"bc": 300, b"cd": 3, b"cda": 301, b"aa": 302, b"aaa": 2}
    lib = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    p = B.BytePairs(spark, ranks, public_tokenizers.PATTERN)
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcd"), rng.integers(1, 14))) for _ in range(800)})
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", p.fold(F.col("w")).alias("ids"))
    p.close()               # the DataFrame keeps the literals
    assert {r.w: r.ids for r in df.collect()} == {w: lib.encode_ordinary(w) for w in words}


def test_empty_table_and_incomplete_vocabulary(spark, pairs, tmp):
    assert B.encode(empty_documents(spark), pairs).count() == 0
    with open(f"{tmp}/few", "w") as out:
        out.write("YQ== 0\n")
    with pytest.raises(ValueError):
        B.load(f"{tmp}/few")
