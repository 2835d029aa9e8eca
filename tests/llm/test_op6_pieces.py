import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from jobtide.llm import pieces as P
from tests.llm.cases import SF, documents_of, empty_documents, odd_documents, spark_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def varint(raw, at):
    out = shift = 0
    while True:
        out |= (raw[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if raw[at - 1] < 128:
            return out, at


def as_unigram(raw):
    """The model file with its type set to unigram: the library then searches its own lattice by the scores."""
    out, at = bytearray(), 0
    while at < len(raw):
        start = at
        tag, at = varint(raw, at)
        assert tag & 7 == 2
        size, at = varint(raw, at)
        body = bytearray(raw[at:at + size])
        if tag >> 3 == 2:                       # trainer_spec; field 3 is the model type
            k = 0
            while k < size:
                field, k = varint(body, k)
                if field == 3 << 3:
                    body[k] = 1
                if field & 7 == 0:
                    _, k = varint(body, k)
                elif field & 7 == 2:
                    n, k = varint(body, k)
                    k += n
                else:
                    k += 4 if field & 7 == 5 else 8
        at += size
        out += raw[start:at - size] + body
    return bytes(out)


def brute(pieces, text):
    """Best total score over all segmentations, by plain dynamic programming."""
    best = [0.0] + [-1e300] * len(text)
    scores = {pieces.text[i]: s for _, (_, s, i) in pieces.automaton.items()}
    for end in range(1, len(text) + 1):
        for start in range(end):
            w = text[start:end]
            s = scores.get(w, pieces.least if end - start == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def total(pieces, ids):
    if not hasattr(pieces, "scores"):
        pieces.scores = {i: s for _, (_, s, i) in pieces.automaton.items()}
    return sum(pieces.scores[i] for i in ids)


def test_small_vocabularies_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        vocab = {"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 5))) for _ in range(14)}
        rows = [("<unk>", 0.0)] + [(w, -float(rng.randrange(1, 9))) for w in sorted(vocab | set("abc▁"))]
        p = P.Pieces(rows, [False] + [True] * (len(rows) - 1))
        for _ in range(10):
            text = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 25)))
            ids = p.encode(text).tolist()
            assert total(p, ids) == brute(p, "▁" + text.replace(" ", "▁"))
            assert "".join(p.text[i] for i in ids) == "▁" + text.replace(" ", "▁")
            assert p.decode(ids) == text


def test_equals_the_library_lattice():
    lib = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(PATH, "rb").read()))
    p = P.Pieces.load(PATH)
    assert p.wordwise
    words = sorted({w for t in documents_of(SF).text.tolist()[:60] for w in t.split()})[:3000]
    for w in words + ["a  b   c", "x.y", "the cat, the hat"]:
        mine, best = p.encode(w).tolist(), lib.nbest_encode(w, nbest_size=2)[0]
        known = all(i > 258 for i in mine + best)
        assert mine == best or known and total(p, mine) == total(p, best)
    for t in ["héllo wörld", "日本語 x", "a  b   c ", " x\ny\tz", "😀 ok"]:
        assert p.decode(p.encode(t).tolist()) == t


def test_round_trip_of_tables(spark):
    for frame in (odd_documents(), documents_of(SF)):
        out = P.encode(spark_documents(spark, frame), PATH)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.decoded_sha256) for r in out.collect())
        assert got == sorted((-1 if i is None or i != i else int(i), hashlib.sha256((t or "").encode()).hexdigest())
                             for i, t in zip(frame.doc_id.astype(object).where(frame.doc_id.notna(), None), frame.text))
        for r in out.take(20):
            assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert {r.doc_id: r.text for r in P.decode(out, PATH).collect()} == dict(zip(frame.doc_id, frame.text))
    assert P.encode(empty_documents(spark), PATH).count() == 0


def test_without_byte_pieces_and_bounded_memory(monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 3)
    p = P.Pieces([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0)], [False, True, True])
    assert p.encode("a?a").tolist() == [1, 2, 0, 2] and p.decode([1, 2, 0, 2]) == "a ⁇ a"
    assert [p.encode(f"a {'a' * k} a").size for k in range(1, 9)] == [2 + k + 1 + 2 for k in range(1, 9)]
    assert len(p.seen) <= 5
