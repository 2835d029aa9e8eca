"""SentencePiece encoding and decoding with an Aho-Corasick Viterbi (operator 6).

An automaton over all normal pieces of a model reads a text once.  At every end position its output links
give the pieces that end there, longest first, and each relaxes the best score of that position; the best path is
read back at the end.  A character that no one-character piece covers costs the least score less 10
and becomes its UTF-8 bytes' pieces (or the unknown piece, if the model has no byte pieces).

Blanks become U+2581 and the text gets one in front, as the model's training did.  If no piece holds
U+2581 behind another character, as in word-wise vocabularies, a best path is the sequence of the words' best paths; words
and their ids are then remembered.  Otherwise a text is one word.

The scores of the model file decide, so a model trained as BPE gets the segmentation of greatest total score, not
the one its merges would give.

Cases: null and empty texts have no ids; equal scores prefer the longer last piece; U+2581 in a text reads
as a blank, as in the original library; all other texts decode to themselves when the model has byte pieces;
repeated rows get equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from jobtide.llm.common import held

CACHE_WORDS = 100_000
BLANK = "▁"
_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Pieces:
    """A vocabulary with scores, ready to encode and decode."""

    def __init__(self, pieces: list[tuple[str, float]], normal: list[bool], unknown: int = 0):
        import ahocorasick
        self.text, self.unknown = [p for p, _ in pieces], unknown
        self.byte = {int(p[3:5], 16): i for i, (p, _) in enumerate(pieces)
                     if not normal[i] and re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.automaton = ahocorasick.Automaton()
        for i, (p, score) in enumerate(pieces):
            if normal[i] and p:
                self.automaton.add_word(p, (len(p), score, i))
        self.automaton.make_automaton()
        self.least = min((s for (_, s), n in zip(pieces, normal) if n), default=0.0) - 10
        self.wordwise = not any(BLANK in p.lstrip(BLANK) for (p, _), n in zip(pieces, normal) if n)
        self.silent = {i for i, n in enumerate(normal) if not n} - set(self.byte_of)
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> "Pieces":
        """Pieces and scores of a SentencePiece model file."""
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
        return cls([(m.id_to_piece(i), m.get_score(i)) for i in ids], [not special(i) for i in ids], max(0, m.unk_id()))

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text that already has U+2581 for blanks."""
        n = len(text)
        best, back = [0.0] + [None] * n, [None] * (n + 1)     # back: (start, id), -1 for a character in bytes
        single, done = -1, 0

        def unknowns(upto):       # positions the automaton passed: characters without a piece of their own
            nonlocal done
            while done < upto:
                done += 1
                if done - 1 != single and best[done - 1] is not None:
                    score = best[done - 1] + self.least
                    if best[done] is None or score > best[done]:
                        best[done], back[done] = score, (done - 1, -1)

        for end, (length, score, i) in self.automaton.iter(text):
            if end > done:
                unknowns(end)
                single = -1
            at = best[end + 1 - length]
            if length == 1:
                single = end
            if at is not None and (best[end + 1] is None or at + score > best[end + 1]):
                best[end + 1], back[end + 1] = at + score, (end + 1 - length, i)
        unknowns(n)
        ids, at = [], n
        while at:
            start, i = back[at]
            if i >= 0:
                ids.append(i)
            elif self.byte:
                ids += [self.byte[b] for b in reversed(text[start].encode())]
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = BLANK + text.replace(" ", BLANK)
        out, seen, old = [], self.seen, self.old
        for word in _WORDS.findall(text) if self.wordwise else [text]:
            ids = seen.get(word)
            if ids is None:
                ids = old.get(word) or np.array(self.viterbi(word), np.int32).tobytes()
                if len(word) <= 64:
                    seen[word] = ids
            out.append(ids)
        if len(seen) > CACHE_WORDS:      # two generations: words in use move to the younger one
            self.old, self.seen = seen, {}
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        """The text the ids stand for."""
        out, raw = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in self.silent:
                out.append(self.text[i])
            elif i == self.unknown:
                out.append(" ⁇ ")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(BLANK, " ").removeprefix(" ")


def loaded(path: str) -> Pieces:
    return held("pieces", path, lambda: Pieces.load(path))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 and decoded_sha256 (of the text the ids decode to)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids = [pieces.encode(t) for t in piece.column("text").to_pylist()]
                size = np.array([len(i) for i in ids], np.int64)
                flat = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(size),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat),
                     pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                     pa.array([hashlib.sha256(pieces.decode(i.tolist()).encode()).hexdigest() for i in ids])],
                    ["doc_id", "n_tokens", "ids", "ids_crc32", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, decoded_sha256 string")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
