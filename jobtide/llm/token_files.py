"""Token files as wavelet matrices (operator 5).

Documents are encoded in ascending doc_id order and cut into shards of about ``SHARD_TOKENS`` ids.  A
shard is one Parquet file of one row: the document table (ids and token counts), the symbol table
(distinct ids, most frequent first) and the bit-planes of a wavelet matrix over the symbols' ranks with
a rank directory, zstd-compressed.  From that file alone a token can be read, a token id counted in any
prefix and its occurrences located (``WaveletMatrix``), or all ids restored.

Encoding works on the words between blanks and line ends, since no token of the vocabulary's
pre-tokenizer spans white space, and remembers the ids of words it has met.

Cases: a null or empty text is one end id; null doc_ids come first; rows with equal doc_id follow each
other by the CRC of their text; an empty table writes no shard; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtide.llm.common import held

SHARD_TOKENS = 4 << 20
CACHE_WORDS = 400_000
END_ID = 2
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_BLOCK = 512   # bits per rank directory entry

SHARD_SCHEMA = ("part int, shard int, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, "
                "symbols binary, planes array<binary>, ranks array<binary>")


class WaveletMatrix:
    """Bit-planes, most significant first; each plane lists the bits in the order in which the plane
    before left the tokens (zeros first, then ones, both in order)."""

    def __init__(self, n: int, symbols: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.symbols, self.planes, self.ranks = n, symbols, planes, ranks
        self.zeros = [n - int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        top = int(ids.max()) + 1 if len(ids) else 0
        freq = np.bincount(ids, minlength=top)
        symbols = np.argsort(-freq, kind="stable")[:np.count_nonzero(freq)].astype(np.uint32)
        code = np.zeros(top, np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
        code[symbols] = np.arange(len(symbols))
        seq, planes, ranks = code[ids], [], []
        for level in reversed(range(max(1, (len(symbols) - 1).bit_length()) if len(symbols) else 0)):
            bit = ((seq >> seq.dtype.type(level)) & seq.dtype.type(1)).astype(bool)
            packed = np.packbits(bit)
            planes.append(packed)
            ranks.append(_directory(packed))
            seq = np.concatenate([np.compress(~bit, seq), np.compress(bit, seq)])
        return cls(len(ids), symbols, planes, ranks)

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before position i of a plane."""
        plane, at = self.planes[level], i // _BLOCK
        out = self.ranks[level][at].astype(np.int64)
        byte = at * (_BLOCK // 8)
        for step in range(_BLOCK // 8):
            full = (byte + step) * 8 + 8 <= i
            out += np.where(full, _POP[plane[np.minimum(byte + step, len(plane) - 1)]], 0)
        rest, last = i % 8, np.minimum(i // 8, len(plane) - 1)
        return out + np.where(rest > 0, _POP[plane[last] >> (8 - np.maximum(rest, 1)).astype(np.uint8)], 0)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Token ids at the positions."""
        i, code = np.asarray(i, np.int64), np.zeros(len(i), np.int64)
        for level, plane in enumerate(self.planes):
            bit = (plane[i // 8] >> (7 - i % 8).astype(np.uint8)) & 1
            one = self._rank1(level, i)
            code = 2 * code + bit
            i = np.where(bit == 1, self.zeros[level] + one, i - one)
        return self.symbols[code]

    def _range(self, token: int, end: int) -> tuple[int, int, int] | None:
        """Code of the token and the bounds, after all planes, of its occurrences before ``end``."""
        found = np.flatnonzero(self.symbols == token)
        if not len(found):
            return None
        code, lo, hi = int(found[0]), 0, end
        for level in range(len(self.planes)):
            one = self._rank1(level, np.array([lo, hi]))
            if code >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + one
            else:
                lo, hi = lo - one[0], hi - one[1]
        return code, int(lo), int(hi)

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of the token before ``end`` (rank)."""
        r = self._range(token, self.n if end is None else end)
        return r[2] - r[1] if r else 0

    def locate(self, token: int) -> np.ndarray:
        """Positions of all occurrences (select), ascending."""
        r = self._range(token, self.n)
        if not r:
            return np.zeros(0, np.int64)
        code, lo, hi = r
        at = np.arange(lo, hi)
        for level in reversed(range(len(self.planes))):
            bits = np.unpackbits(self.planes[level], count=self.n)
            if code >> (len(self.planes) - 1 - level) & 1:
                at = np.flatnonzero(bits)[at - self.zeros[level]]
            else:
                at = np.flatnonzero(bits == 0)[at]
        return at

    def ids(self) -> np.ndarray:
        """All token ids, restored plane by plane from the last."""
        seq = np.zeros(self.n, np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32)
        for level in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            before, z = np.empty_like(seq), self.zeros[level]
            before[np.flatnonzero(~bit)] = seq[:z]
            before[np.flatnonzero(bit)] = seq[z:] | seq.dtype.type(1 << (len(self.planes) - 1 - level))
            seq = before
        return self.symbols[seq] if self.n else np.zeros(0, np.uint32)


_POP = np.array([bin(b).count("1") for b in range(256)], np.int64)


def _directory(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane, and in all."""
    pad = -len(packed) % (_BLOCK // 8)
    per = np.bitwise_count(np.pad(packed, (0, pad))).reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)


def shard_of(row: dict) -> WaveletMatrix:
    """The wavelet matrix of one row of a shard file."""
    return WaveletMatrix(row["n_tokens"], np.frombuffer(row["symbols"], np.uint32),
                         [np.frombuffer(p, np.uint8) for p in row["planes"]],
                         [np.frombuffer(r, np.uint32) for r in row["ranks"]])


class WordEncoder:
    """Ids of whole texts by the tokenizers library, the ids of words remembered.

    Words are what stands between blanks and line ends.  Words of letters alone are one token of the
    pre-tokenizer, so many are encoded in one call and told apart by the tokens that end a word; ASCII marks
    (but the apostrophe) behind such a word are a token of their own.  All other words are encoded one by one.  Two
    generations of at most CACHE_WORDS words are kept; words in use move to the younger one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok, self.seen, self.old = Tokenizer.from_file(path), {"": b""}, {}
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _one(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def _learn(self, words: set[str]) -> None:
        seen, old, ends, plain, rest = self.seen, self.old, [], set(), []
        for w in words:
            if w in old:
                seen[w] = old[w]
            elif _simple(w):
                plain.add(w)
            else:
                stem = w.rstrip(_MARKS)
                if len(stem) < len(w) and _simple(stem):
                    ends.append((w, stem, w[len(stem):]))
                    if stem not in seen:
                        plain.add(stem)
                else:
                    rest.append(w)
        plain = list(plain)
        for i in range(0, len(plain), 4096):
            part = plain[i:i + 4096]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(cut) != len(part) + 1:      # not the word ends this relies on
                rest += part
                continue
            raw = ids.tobytes()
            seen.update((w, raw[cut[k]:cut[k + 1]]) for k, w in enumerate(part))
        rest += {tail for _, _, tail in ends}
        seen.update((w, self._one(w)) for w in rest if w not in seen)
        seen.update((w, seen[stem] + seen[tail]) for w, stem, tail in ends)

    def flat(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and the number of ids of each text.

        Words are cut and told apart on the Arrow buffers; only distinct words are looked up, and the ids of all
        words are gathered at once."""
        texts = pc.fill_null(texts, "")
        # The vocabulary is lower case, so A-Z may be lower-cased first, so that fewer words differ; not in texts with
        # special tokens, nor with marks that compose with some letters in one case only.
        plain = pc.invert(pc.match_substring_regex(texts, "<\\||[\u0300-\u036f]"))
        texts = pc.replace_substring(pc.if_else(plain, pc.ascii_lower(texts), texts), "\n", " ")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        if len(self.seen) > CACHE_WORDS:
            self.old, self.seen = self.seen, {"": b""}
        distinct = words.dictionary.to_pylist()
        self._learn(set(distinct).difference(self.seen))
        known = [self.seen[w] for w in distinct] + [np.uint32(end_id).tobytes()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), np.uint32)
        # The end id is one more word behind each text's last.
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        at = np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(distinct))
        n = sizes[at]
        last = np.cumsum(n)
        ids = flat[np.repeat(starts[at] - (last - n), n) + np.arange(last[-1] if len(last) else 0)]
        return ids, np.diff(last[ends + np.arange(len(ends))], prepend=0)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, sizes = self.flat(pa.array(texts, pa.string()), END_ID)
        return [part[:-1].astype("<u4").tobytes() for part in np.split(ids, np.cumsum(sizes)[:-1])]


def _simple(word: str) -> bool:
    """Letters alone, none of which normalizes to several characters."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0130")


def coder(path: str) -> WordEncoder:
    return held("token_files", path, lambda: WordEncoder(path))


def _shards(path: str, end_id: int, shard_tokens: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(path)
        part, number = TaskContext.get().partitionId(), 0
        owned, ids, lengths, size = [], [], [], 0

        def shard():
            nonlocal number, owned, ids, lengths, size
            w = WaveletMatrix.build(np.concatenate(ids))
            row = pa.RecordBatch.from_pylist([{
                "part": part, "shard": number, "n_tokens": w.n, "doc_ids": owned, "lengths": lengths,
                "symbols": w.symbols.tobytes(), "planes": [p.tobytes() for p in w.planes],
                "ranks": [r.tobytes() for r in w.ranks]}], schema=pa.schema([
                    ("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("symbols", pa.binary()),
                    ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))]))
            number, owned, ids, lengths, size = number + 1, [], [], [], 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                flat, sizes = words.flat(piece.column("text"), end_id)
                docs, ends, low = piece.column("doc_id").to_pylist(), np.cumsum(sizes), 0
                while low < len(docs):      # documents that still fit into the shard; at least one
                    before = int(ends[low - 1]) if low else 0
                    high = min(len(docs), int(np.searchsorted(ends, before + shard_tokens - size)) + 1)
                    docs_here, upto = docs[low:high], int(ends[high - 1])
                    owned += docs_here
                    lengths += sizes[low:high].tolist()
                    ids.append(flat[before:upto])
                    size, low = size + upto - before, high
                    if size >= shard_tokens:
                        yield shard()
        if owned:
            yield shard()
    return build


def write_files(docs: DataFrame, tokenizer: str, out: str, end_id: int = END_ID,
                shard_tokens: int = SHARD_TOKENS, parts: int | None = None) -> None:
    """Encode the documents and write one file per shard below ``out``."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id are ordered by the CRC of their text, equal rows by their place, so that an id (or null) that many
    # rows share is spread over partitions like any other.
    order = [F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("place")]
    rows = docs.select("doc_id", "text", F.crc32(F.col("text").cast("binary")).alias("crc"),
                       F.monotonically_increasing_id().alias("place")) \
        .repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(_shards(tokenizer, end_id, shard_tokens), SHARD_SCHEMA) \
        .write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, lengths = shard_of(row).ids(), np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                k = len(lengths)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * k, pa.int32()), "shard": pa.array([row["shard"]] * k, pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "before": pa.array(ends - lengths),
                    "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())})

    rows = files.mapInArrow(restore, "part int, shard int, doc_id long, before long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "shard", "n_tokens")
    # Offsets: parts before this one, then shards before this one in the part (a row per part, per shard).
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard")
    starts = sizes.withColumn("inner", F.sum("n_tokens").over(inside) - F.col("n_tokens")).drop("n_tokens") \
        .join(parts, "part")
    return rows.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("part_start") + F.col("inner") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
