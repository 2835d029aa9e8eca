"""Byte-level BPE encoding and decoding with Spark's higher-order functions (operator 11).

A text is cut into words by the vocabulary's pattern.  A word's bytes (one character a byte, ISO-8859-1) are an array of
pieces; ``aggregate`` folds merges over it: each step joins the leftmost pair of neighbours whose joined
bytes have the least rank in a literal rank map, and looks up the two pairs that the join makes new.  The map is a literal
array of small maps, one per hash of the bytes, so a lookup doesn't search 50,000 entries.

Distinct words are folded, not occurrences:

1. Documents are read in blocks of up to ``BLOCK`` words.  A block numbers its distinct words; its payload is the
   numbers of all its words in order, its requests are its distinct words, dealt over ``DEAL`` rows by hash.
2. Requests of up to ``DEAL`` blocks for the same hash meet, so a word is folded once for all of them.
3. The answers (ids of each word) go back to the block, where they are put in the place of the words' numbers.

What meets in one task is bounded by the constants, whatever the input: a frequent word is at most one entry of a block's
requests.  Only payloads and distinct words are exchanged, packed, never the texts.

Decoding looks each id up in a literal array of binary pieces and concatenates them.

Cases: null and empty texts have no ids and decode to no bytes; a null id or one without a piece decodes to nothing; repeated
rows get equal results; extra columns are ignored; an empty table gives an empty result; a vocabulary that lacks
one of the 256 bytes is refused.  The fold's work grows with the square of a word's length (a word of 10,000 bytes takes
seconds); a text of any length whose words are short takes work in proportion.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.literals import Literals, let

BLOCK = 6_000_000       # words of a block
DEAL = 64               # rows a block's requests are dealt to, and blocks whose requests meet
FOLD = 32_768           # words of a row that is folded
BYTES = "ISO-8859-1"
MARK, EDGE, NONE = "\u0100", "\u0101", "\U0010FFFF"   # between pieces, at both ends of a word, rank of no piece

# Ranges of letters and numbers that Unicode added after version 13, in hexadecimal; a Java runtime that
# knows only version 13 takes them for symbols.
NEW_LETTERS = """
870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3
A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC
105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075
1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02
11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF
1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD
1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D
31350-323AF"""
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 " \
              "1E4F0-1E4F9 1E5F1-1E5FA"


def _ranges(text: str) -> str:
    return "".join("-".join(f"\\x{{{end}}}" for end in r.split("-")) for r in text.split())


def java_pattern(pattern: str) -> str:
    r"""The pattern as Spark's regular expressions read it: \s by Unicode, letters and numbers of newer versions.

    Behind a class of the runtime stands the new ranges' class; it is looked at only for characters from U+0870 on.
    """
    late = r"[\x{870}-\x{3FFFF}]"
    letters, numbers = (rf"[{name}[{late}&&[{_ranges(new)}]]]" for name, new in ((r"\p{L}", NEW_LETTERS), (r"\p{N}", NEW_NUMBERS)))
    symbol, space = "\0", r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
    out = pattern.replace(r"[^\s\p{L}\p{N}]", symbol).replace(r"\p{L}", letters).replace(r"\p{N}", numbers) \
        .replace(r"\s", space).replace(r"\S", f"[^{space}]")
    return out.replace(symbol, f"[^{space}{letters}{numbers}]")


def load(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line holds a piece in base 64 and its rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary has no piece for the bytes {missing}")
    return ranks


class BytePairs:
    """A vocabulary and its pattern, as column expressions.  ``close`` frees the literals' variables; DataFrames built
    before keep their values."""

    def __init__(self, spark: SparkSession, ranks: Mapping[bytes, int], pattern: str):
        self.literals = Literals(spark)
        self.pieces = {i: p for p, i in ranks.items()}
        self.pattern = java_pattern(pattern)
        # A rank is one character, so that the ranks of a word's pairs are a string; ranks order as characters do.
        self.known = self.literals.put_map({p.decode(BYTES): _character(i) for p, i in ranks.items()}, "string")
        self.id = self.literals.put_map({p.decode(BYTES): i for p, i in ranks.items()}, "int")

    @classmethod
    def load(cls, spark: SparkSession, path: str, pattern: str) -> "BytePairs":
        return cls(spark, load(path), pattern)

    def close(self) -> None:
        self.literals.drop()

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def rank(self, piece: Column) -> Column:
        return F.coalesce(self.known(piece), F.lit(NONE))

    def fold(self, word: Column) -> Column:
        """Ids of one word: the id of a word that is a piece, else its bytes with all merges done."""
        return let(F.decode(word.cast("binary"), BYTES), lambda b: let(
            self.id(b), lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(let(
                F.split(self._merged(F.split(b, "")), MARK),
                lambda p: F.transform(F.slice(p, 2, F.size(p) - 2), lambda x: self.id(x))))))

    def _merged(self, pieces: Column) -> Column:
        """The pieces after all merges, joined by MARK between two edges.

        The state is the joined pieces and the ranks of their pairs (one character each; the pairs with an edge have none).
        """
        mark, edge, none = F.lit(MARK), F.lit(EDGE), F.lit(NONE)
        before = lambda text, n: F.call_function("substring_index", text, mark, n)

        def start(p):
            left, right = F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p))
            ranks = F.array_join(F.zip_with(left, right, lambda a, b: self.rank(F.concat(a, b))), "")
            return F.struct(F.concat_ws(MARK, edge, F.array_join(p, MARK), edge).alias("p"),
                            F.concat(none, ranks, none).alias("r"))

        def step(s, _):
            return F.when(s["r"] == "", s).otherwise(let(F.array_min(F.split(s["r"], "")), lambda least: F.when(
                least == NONE, F.struct(s["p"].alias("p"), F.lit("").alias("r"))).otherwise(let(
                    F.instr(s["r"], least), lambda i: let(
                        before(s["p"], i), lambda left: let(
                            F.concat(left, F.substr(s["p"], F.char_length(left) + 2)),
                            lambda p: joined(p, s["r"], i)))))))

        def joined(p, r, i):        # the i-th mark is gone; the pairs before and behind its piece are new
            pair = lambda n: self.rank(F.replace(before(before(p, n), F.lit(-2)), mark, F.lit("")))
            return F.struct(p.alias("p"), F.overlay(r, F.concat(pair(i), pair(i + 1)), i - 1, F.lit(3)).alias("r"))

        return let(pieces, lambda p: F.aggregate(F.slice(p, 2, F.size(p)), start(p), step)["p"])

    def decoded(self, ids: Column) -> Column:
        """The bytes the ids stand for."""
        table = self.literals.put([self.pieces[i].hex() if i in self.pieces else "" for i in range(max(self.pieces) + 1)],
                                  "array<string>")
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def _character(rank: int) -> str:
    return chr(rank if rank < 0xD800 else rank + 0x800)     # surrogates are no characters


def _pack(value: object, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(value, protocol=5))


def _open(raw: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 by planes of equal byte positions, which compress well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _split(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers as one byte each, 255 for what stands in the second part: frequent words have a byte stream of their own."""
    small = codes < 255
    return np.where(small, codes, 255).astype(np.uint8).tobytes(), _planes(codes[~small] - 255)


def _joined(first: bytes, second: bytes) -> np.ndarray:
    codes = np.frombuffer(first, np.uint8).astype(np.uint32)
    codes[codes == 255] += _numbers(second)
    return codes


_ROW = pa.schema([("meet", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("packed", pa.binary())])
_SQL = "meet long, block long, part int, packed binary"


def _row(meet: int, block: int, part: int, value: object) -> pa.RecordBatch:
    packed = _pack(value, 3 if part >= 0 else 9)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((meet, block, part, packed), _ROW.types)], schema=_ROW)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Payload (part -1) and requests (part 0 to DEAL - 1) of each block of documents."""
    import xxhash
    task, made = TaskContext.get().partitionId(), 0
    number: dict[str, int] = {}
    ids, sizes, codes, held = [], [], [], 0

    def rows():
        nonlocal number, ids, sizes, held, made
        block, meet = (task << 24) + made, (((task // DEAL) << 24) + made) * DEAL
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        codes.clear()
        # Frequent words get small numbers, whose bytes compress better.
        rank = np.empty(len(number), np.int32)
        rank[np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")] = np.arange(len(number), dtype=np.int32)
        parts: list[tuple[list, list]] = [([], []) for _ in range(DEAL)]
        for word, n in zip(number, rank.tolist()):
            words, at = parts[xxhash.xxh32_intdigest(word.encode()) % DEAL]
            words.append(word)
            at.append(n)
        number = {}
        for k, (words, at) in enumerate(parts):
            if words:
                yield _row(meet + k, block, k, (words, _planes(np.array(at))))
        yield _row(-1 - block, block, -1, (ids, sizes, len(rank), *_split(rank[flat])))
        ids, sizes, held, made = [], [], 0, made + 1
        pa.default_memory_pool().release_unused()

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            words = piece.column("words")
            flat = words.flatten().dictionary_encode()
            own = np.array([number.setdefault(w, len(number)) for w in flat.dictionary.to_pylist()], np.int32)
            codes.append(own[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else own)
            ids += piece.column("doc_id").to_pylist()
            sizes += pc.list_value_length(words).to_pylist()
            held += len(flat)
            if held >= size:
                yield from rows()
    if ids:
        yield from rows()


def _ask(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Distinct words of the requests that meet here, in rows of ``size`` words, and to whom each answer goes."""
    schema = pa.schema([("words", pa.list_(pa.string())), ("meet", pa.int64()), ("block", pa.int64()), ("part", pa.int32()),
                        ("packed", pa.binary())])
    number: dict[str, int] = {}
    asked: list = []
    at = None

    def row(words, *rest):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((words, *rest), schema.types)], schema=schema)

    def rows():
        words = list(number)
        for low in range(0, len(words), size):
            to = []
            for block, part, own, codes in asked:
                here = (own >= low) & (own < low + size)
                if here.any():
                    to.append((block, part, _planes(own[here] - low), _planes(codes[here])))
            yield row(words[low:low + size], -1, -1, -1, _pack(to))

    for batch in batches:
        for meet, block, part, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if part < 0:
                yield row([], meet, block, part, packed)
                continue
            if at != meet or len(asked) >= DEAL:
                yield from rows()
                number, asked, at = {}, [], meet
            words, codes = _open(packed)
            own = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
            asked.append((block, part, own, _numbers(codes)))
    yield from rows()


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each block's words, packed for the block."""
    for batch in batches:
        for k in range(batch.num_rows):
            part, packed = batch.column("part")[k].as_py(), batch.column("packed")[k].as_py()
            if part == -1 and batch.column("block")[k].as_py() >= 0:
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(k, 1) for c in _ROW.names], schema=_ROW)
                continue
            lists = batch.column("ids").slice(k, 1).flatten()
            ids, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for block, part, own, codes in _open(packed):
                own = _numbers(own)
                n = sizes[own]
                yield _row(0, block, part, (codes, _planes(n), _planes(ids[_spread(starts[own], n)])))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size values) for each pair."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _documents(pieces: Mapping[int, bytes], with_ids: bool):
    """Rows of one block, the payload first: ids of its documents and their digests."""
    piece_of = [pieces.get(i, b"") for i in range(max(pieces) + 1)]

    def finish(payload, answers):
        docs, n_words, n_distinct, *codes = payload
        sizes, starts, flat, at = np.zeros(n_distinct, np.int64), np.zeros(n_distinct, np.int64), [], 0
        for own, n, ids in answers:
            own, n, ids = _numbers(own), _numbers(n).astype(np.int64), _numbers(ids)
            sizes[own], starts[own] = n, at + np.cumsum(n) - n
            flat.append(ids)
            at += len(ids)
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        codes, first = _joined(*codes), 0
        for low in range(0, len(docs), 256):
            out = []
            for doc, n in zip(docs[low:low + 256], n_words[low:low + 256]):
                mine = codes[first:first + n]
                first += n
                ids = flat[_spread(starts[mine], sizes[mine])]
                raw = b"".join(map(piece_of.__getitem__, ids.tolist()))
                out.append((doc, len(ids), ids if with_ids else None, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                            hashlib.sha256(raw).hexdigest()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32())),
                 pa.array(columns[3]), pa.array(columns[4])], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payload, answers = None, []
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist()):
                if part < 0:
                    if payload:
                        yield from finish(payload, answers)
                    payload, answers = _open(packed), []
                else:
                    answers.append(_open(packed))
        if payload:
            yield from finish(payload, answers)

    return run


def encode(docs: DataFrame, pairs: BytePairs, with_ids: bool = True, block: int = BLOCK, fold: int = FOLD) -> DataFrame:
    """doc_id, n_tokens, ids (null without ``with_ids``), ids_sha256 and decoded_sha256 (of the bytes the ids decode to)."""
    spark = docs.sparkSession
    # Folding is work for the processor on few bytes, so the number of tasks is given and not left to their size.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    words = docs.select("doc_id", pairs.words(F.col("text")).alias("words"))
    asked = words.mapInArrow(lambda b: _blocks(b, block), _SQL).repartition(n, "meet") \
        .sortWithinPartitions("meet", "block").mapInArrow(lambda b: _ask(b, fold), f"words array<string>, {_SQL}")
    answered = asked.select(F.transform("words", lambda w: pairs.fold(w)).alias("ids"), "meet", "block", "part", "packed") \
        .mapInArrow(_answer, _SQL)
    return answered.repartition(n, "block").sortWithinPartitions("block", "part").mapInArrow(
        _documents(pairs.pieces, with_ids),
        "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, pairs: BytePairs) -> DataFrame:
    """doc_id and the bytes that the ids stand for."""
    return encoded.select("doc_id", pairs.decoded(F.coalesce("ids", F.array().cast("array<int>"))).alias("bytes"))
