"""Cross-entropy difference scores from matched n-gram models (operator 7).

Words (lower-cased A-Z, cut at ASCII blanks) of all documents make the one vocabulary of both models, which grows
with the corpus: no word is left out.  Bigrams over it are counted in the target documents and in all documents
(the background), every document counted whole.
Both models are smoothed alike: p(w | h) = (c(h, w) + MASS p(w)) / (c(h) + MASS), p(w) = (c(w) + 1) / (n + V), where
V counts the words and one unknown word.  A caller may ask for a smaller vocabulary (``size``): all but its size - 1
most frequent words are then the unknown word.

A document's losses are the mean negative log probabilities of its words, the first after a start mark; its score
is target loss less background loss: the lower, the more it reads like the target.

Counts are shuffled tables and never gathered.  What a task can tell by itself it sums on the spot: contexts and words
of the ``MAX_WORDS`` most frequent words, the ``MAX_PAIRS`` most frequent bigrams (both broadcast with exact counts)
and bigrams that a count-min sketch proves to stand once in the corpus.  Every other occurrence is asked for under its
bigram, or under its word if that is not broadcast.  Questions travel as blocks: one for each of ``FAN`` parts of the keys
and each chunk of some ``CHUNK`` tokens, so there are as many blocks as the text has chunks.  The task that gets a part
counts it and answers block by block with the counts, from which the chunk's losses are summed.  The bounds change the
work, not the result.

Cases: null, empty and blank texts have no tokens, losses 0 and score 0; without target documents the
target model is uniform; doc_ids that the target table repeats count once, rows of ``docs`` that repeat count
each; ties in frequency go by hash; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.bytescan import mix, pieces
from jobtide.llm.common import small, stored
from jobtide.llm.repeat_sketch import repeated

MASS = 16.0
FLUSH = 2 << 20
MAX_BROADCAST = 1 << 19
MAX_WORDS = 1 << 19     # words and bigrams whose counts are broadcast (work only, never results)
MAX_PAIRS = 1 << 19
FREQUENT = 3            # a task names bigrams it meets this often for the broadcast
TOP = 1 << 16           # counts above this are alike when the broadcast ones are chosen
START, UNKNOWN = np.uint64(1), np.uint64(2)
_ODD = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 19         # tokens whose open occurrences are asked for together
FAN = 512               # parts of the keys
PAIR, CONTEXT, WORD, LOSS = range(4)    # kinds of blocks; LOSS: a chunk's texts with the sums of their settled losses
BLOCK = "part int, chunk long, kind int, key binary, sub binary, doc binary"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held):
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["w", "c"])
    held, n = [], 0
    for batch in batches:
        for p in pieces(batch):
            p.words()
            held.append(p.word_hashes(lower=True))
            n += len(held[-1])
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
    if n:
        yield flush(held)


def vocabulary(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the size - 1 most frequent words, for callers that want a bounded vocabulary."""
    rows = docs.select("text").mapInArrow(_word_counts, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")) \
        .orderBy(F.desc("c"), "w").limit(size - 1).collect()
    return np.sort(np.array([r.w for r in rows], np.int64).view(np.uint64))


def _tokens(batch: pa.RecordBatch, vocab: np.ndarray | None):
    """Per piece: its rows, the word before each word (or the start mark), the words, each text's first, last words."""
    for p in pieces(batch):
        p.words()
        w = p.word_hashes(lower=True)
        if vocab is not None:
            w = np.where(_find(vocab, w) >= 0, w, UNKNOWN)
        before = np.empty_like(w)
        before[1:] = w[:-1]
        some = np.diff(p.first) > 0
        before[p.first[:-1][some]] = START
        last = np.zeros(len(w), bool)
        last[p.first[1:][some] - 1] = True
        yield p.rows, before, w, p.first, last


def _pair(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(before * _ODD + w)


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where the hashes stand in the sorted keys, -1 where they don't."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


class _Places:
    """``_find`` by a table: keys in ascending order, each at the place its leading bits name or at the next free one."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(1, (2 * len(keys)).bit_length()))
        at = np.arange(len(keys))
        place = np.maximum.accumulate((keys >> self.shift).astype(np.int64) - at) + at
        n = max(1 << int(64 - self.shift), int(place[-1]) + 1 if len(keys) else 0) + 1
        self.keys, self.at = np.full(n, ~np.uint64(0)), np.full(n, -1, np.int32)
        self.keys[place], self.at[place] = keys, at

    def find(self, h: np.ndarray) -> np.ndarray:
        place = (h >> self.shift).astype(np.int64)
        met = self.keys[place]
        out = np.where(met == h, self.at[place], -1)
        left = np.flatnonzero(met < h)
        place, h = place[left], h[left]
        while len(left):
            place += 1
            met = self.keys[place]
            hit, on = met == h, met < h
            out[left[hit]] = self.at[place[hit]]
            left, place, h = left[on], place[on], h[on]
        return out


def _opened(held) -> np.ndarray | None:
    return None if held is None else np.frombuffer(held.value, np.uint64)


def _words(held):
    """Words with their counts in all and in target documents, and as last words of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            w, good, last = map(np.concatenate, zip(*rows))
            h, at = np.unique(w, return_inverse=True)
            counts = [np.bincount(at, x, len(h)).astype(np.int64) for x in (np.ones(len(w)), good, last, good & last)]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, counts)], ["w", "a", "t", "ea", "et"])
        vocab, rows, n = _opened(held), [], 0
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False)
            for at, _, w, first, last in _tokens(batch, vocab):
                rows.append((w, np.repeat(target[at], np.diff(first)), last))
                n += len(w)
                if n >= FLUSH:
                    yield flush(rows)
                    rows, n = [], 0
        if n:
            yield flush(rows)
    return run


def _pairs(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        vocab = _opened(held)
        for batch in batches:
            for _, before, w, _, _ in _tokens(batch, vocab):
                yield _pair(before, w)
    return run


def _frequent(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            h, c = np.unique(np.concatenate(rows), return_counts=True)
            keep = c >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep])], ["g", "a"])
        rows, n = [], 0
        for g in _pairs(held)(batches):
            rows.append(g)
            n += len(g)
            if n >= FLUSH:
                yield flush(rows)
                rows, n = [], 0
        if n:
            yield flush(rows)
    return run


def _exact(held, chosen):
    """Counts of the chosen bigrams by their number, in all and in target documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, keys = _opened(held), _opened(chosen)
        places, total, rows, n = _Places(keys), np.zeros((2, len(keys)), np.int64), ([], []), 0

        def add():
            for sums, found in zip(total, rows):
                sums += np.bincount(np.concatenate(found), minlength=len(keys))

        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False)
            for at_, before, w, first, _ in _tokens(batch, vocab):
                at = places.find(_pair(before, w))
                known = at >= 0
                rows[0].append(at[known])
                rows[1].append(at[known & np.repeat(target[at_], np.diff(first))])
                n += len(w)
                if n >= FLUSH:
                    add()
                    rows, n = ([], []), 0
        if n:
            add()
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["g", "a", "t"])
    return run


def _most(table: DataFrame, bound: int) -> DataFrame:
    """Its rows of greatest count ``a``: all down to a level of counts, at most ``bound`` rows.  Counts above TOP are
    told apart by 64ths of an octave; if more rows than the bound share the top level, there are none."""
    level = F.when(F.col("a") < TOP, F.col("a")).otherwise(TOP + F.floor(64 * F.log2(F.col("a") / F.lit(TOP))))
    rows = table.groupBy(level.alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()
    least, n = None, 0
    for r in rows:
        n += r.n
        if n > bound:
            break
        least = r.c
    return table.where(F.lit(False) if least is None else level >= least)


class _Model:
    """The broadcast counts: sorted words with M p(w) and log(c(h) + M) in target and background, bigrams with counts."""

    def __init__(self, words, pairs, sizes):
        self.words, counts, contexts = words
        self.pairs, self.pair_counts = pairs
        self.sizes, starts = np.array(sizes[:2], np.float64)[:, None], np.array(sizes[2:], np.float64)
        self.mass = self.masses(counts)
        self.context = np.log(contexts + MASS)
        self.start = np.log(starts + MASS)

    def masses(self, counts: np.ndarray) -> np.ndarray:
        return MASS * (counts + 1) / self.sizes


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: first the lowest bytes of all, and so on, so that the zeros of small ones lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    part, chunk, kind, *blobs = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()),
         *(pa.array(b, pa.binary()) for b in blobs)], ["part", "chunk", "kind", "key", "sub", "doc"])


def _settle(held, model, sketch):
    """Blocks of the open occurrences of each chunk, and the sums of what needs no other rows.

    In a block: keys; for bigrams the number of their word, for words the word before; and for each the step to its text
    from the text of the one before, * 2 + whether that is a target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, m = _opened(held), model.value
        words, pairs = _Places(m.words), _Places(m.pairs)
        number = TaskContext.get().partitionId() << 32

        def ask(open_, texts):
            rows = [(number % FAN, number, LOSS, np.concatenate(texts[0]).tobytes(),
                     b"".join(np.concatenate(x).astype(np.float64).tobytes() for x in texts[1:]), b"")]
            for kind, parts in enumerate(open_):
                key, sub, doc, good = map(np.concatenate, zip(*parts))
                part = (mix(key) >> np.uint64(55)).astype(np.uint16) % np.uint16(FAN)
                order = np.argsort(part, kind="stable")
                key, sub, doc, good = key[order], sub[order], doc[order], good[order]
                cut = np.searchsorted(part[order], np.arange(FAN + 1))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    at = slice(cut[k], cut[k + 1])
                    step = np.diff(doc[at], prepend=0).astype(np.uint32) * np.uint32(2) + good[at]
                    rows.append((k, number, kind, key[at].tobytes(), b"" if kind == CONTEXT else sub[at].tobytes() if kind == WORD
                                 else _planes(sub[at].astype(np.uint32)), _planes(step)))
            return _blocks(rows)

        open_, texts, n, base = ([], [], []), ([], [], [], []), 0, 0
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            target = batch.column("target").to_numpy(zero_copy_only=False)
            for rows, before, w, first, _ in _tokens(batch, vocab):
                lengths = np.diff(first)
                row = np.repeat(np.arange(len(lengths)), lengths)
                good = target[rows][row]
                g, at, begin = _pair(before, w), words.find(w), before == START
                from_ = np.where(begin, -1, np.roll(at, 1))
                hot, near = pairs.find(g), at >= 0
                once = near & (hot < 0)
                once[once] = ~sketch.maybe(g[once])
                done = (near & (hot >= 0)) | once
                for k, alone in ((0, good), (1, np.ones(len(w), bool))):
                    loss = np.where(begin, m.start[k], 0.0)
                    known = from_ >= 0
                    loss[known] = m.context[k][from_[known]]
                    count = alone[done].astype(np.float64)
                    count[~once[done]] = m.pair_counts[k][hot[done & ~once]]
                    loss[done] -= np.log(count + m.mass[k][at[done]])
                    texts[1 + k].append(np.bincount(row, loss, len(lengths)))
                texts[0].append(docs[rows])
                texts[3].append(lengths)
                for kind, chosen, key, sub in ((PAIR, near & ~done, g, at), (CONTEXT, (from_ < 0) & ~begin, before, at),
                                               (WORD, ~near, w, before)):
                    chosen = np.flatnonzero(chosen)
                    open_[kind].append((key[chosen], sub[chosen], base + row[chosen], good[chosen].astype(np.uint32)))
                n, base = n + len(w), base + len(lengths)
                if n >= CHUNK or base >= CHUNK:
                    yield ask(open_, texts)
                    open_, texts, n, base, number = ([], [], []), ([], [], [], []), 0, 0, number + 1
        if base:
            yield ask(open_, texts)
    return run


def _count(model):
    """Answers to the blocks of whole parts, which come sorted by part: for bigrams the counts in target and background,
    for the others the losses of each text."""
    def answers(m, blocks):
        for kind in (PAIR, CONTEXT, WORD):
            mine = [b for b in blocks if b[2] == kind]
            if not mine:
                continue
            key = np.frombuffer(b"".join(b[3] for b in mine), np.uint64)
            step = [_numbers(b[5], np.uint32) for b in mine]
            good = (np.concatenate(step) & 1).astype(np.float64)
            ends = np.cumsum([len(x) for x in step]).tolist()
            sub = None if kind == CONTEXT else np.concatenate([
                np.frombuffer(b[4], np.uint64) if kind == WORD else _numbers(b[4], np.uint32) for b in mine])
            order = np.argsort(key)
            new = np.ones(len(key), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            finer = new.copy()
            if sub is not None:
                differs = sub[order][1:] != sub[order][:-1]
                if (differs & ~new[1:]).any():      # one key, several bigrams
                    order = np.lexsort((sub, key))
                    differs = sub[order][1:] != sub[order][:-1]
                finer[1:] |= differs
            whole, part = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            whole[order], part[order] = np.cumsum(new) - 1, np.cumsum(finer) - 1
            for k, x in enumerate((good, None)):
                by_whole, by_part = np.bincount(whole, x)[whole], np.bincount(part, x)[part]
                out = by_part.astype(np.uint64) if kind == PAIR else np.log(by_whole + MASS) if kind == CONTEXT else \
                    -np.log(by_part + MASS * (by_whole + 1) / m.sizes[k])
                if k == 0:
                    first = out
            for (_, chunk, _, _, at, doc), steps, low, high in zip(mine, step, [0, *ends], ends):
                t, b = first[low:high], out[low:high]
                if kind == PAIR:
                    yield 0, chunk, kind, _planes(t) + _planes(b), at, doc
                else:
                    docs = np.cumsum(steps >> 1, dtype=np.int64)
                    cut = np.flatnonzero(np.diff(docs, prepend=-1))
                    yield (0, chunk, kind, np.add.reduceat(t, cut).tobytes() + np.add.reduceat(b, cut).tobytes(), b"",
                           _planes(np.diff(docs[cut], prepend=0).astype(np.uint32) * np.uint32(2)))
        for b in blocks:
            if b[2] == LOSS:
                yield b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _groups(batches, 0):
            yield _blocks(list(answers(model.value, blocks)))
    return run


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Rows of equal value in a column, by which they come sorted."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[by] != held[0][by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sum(model):
    """doc, t, b, n, r of every text: sums of losses, tokens and rows; the answers come sorted by chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for blocks in _groups(batches, 1):
            loss = next(b for b in blocks if b[2] == LOSS)
            docs, (t, b, n) = np.frombuffer(loss[3], np.int64), np.frombuffer(loss[4], np.float64).reshape(3, -1)
            sums = [t.copy(), b.copy()]
            for _, _, kind, key, sub, doc in blocks:
                if kind == LOSS:
                    continue
                row = np.cumsum(_numbers(doc, np.uint32) >> 1, dtype=np.int64)
                half = len(key) // 2
                for k, raw in enumerate((key[:half], key[half:])):
                    x = -np.log(_numbers(raw, np.uint64) + m.mass[k][_numbers(sub, np.uint32)]) if kind == PAIR \
                        else np.frombuffer(raw, np.float64)
                    sums[k] += np.bincount(row, x, len(docs))
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (docs, *sums, n.astype(np.int64), np.ones(len(n), np.int64))],
                                             ["doc", "t", "b", "n", "r"])
    return run


def score(docs: DataFrame, target_ids: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every document.

    ``target_ids``: doc_id of the documents the target model is made of; ``size``: all words if None."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text", F.xxhash64(F.lit(1), "doc_id", F.lit(2), "text").alias("doc"))
    vocab = None if size is None else vocabulary(docs, size)
    held = None if vocab is None else sc.broadcast(vocab.tobytes())
    good = target_ids.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()
    labels = good.count()
    marked = docs.join(small(good, labels, MAX_BROADCAST), F.col("doc_id") == F.col("__id"), "left") \
        .select("doc", "text", F.col("__id").isNotNull().alias("target"))
    words = stored(marked.select("text", "target").mapInArrow(_words(held), "w long, a long, t long, ea long, et long").groupBy("w").agg(
        *(F.sum(c).alias(c) for c in ("a", "t", "ea", "et"))), "lm-words")
    all_ = words.agg(F.count("*").alias("v"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("a", "t", "ea", "et"))).first()
    v = (all_.v if vocab is None else len(vocab)) + 1
    top = _most(words, MAX_WORDS).toArrow()
    w, a, t, ea, et = (top[c].to_numpy() for c in ("w", "a", "t", "ea", "et"))
    order = np.argsort(w.view(np.uint64))
    known = (w.view(np.uint64)[order], np.stack([t, a])[:, order], np.stack([t - et, a - ea])[:, order])
    often = stored(docs.select("text").mapInArrow(_frequent(held), "g long, a long").groupBy("g").agg(F.sum("a").alias("a")), "lm-pairs")
    chosen = np.sort(_most(often, MAX_PAIRS).select("g").toArrow()["g"].to_numpy().view(np.uint64))
    counts = np.zeros((2, len(chosen)), np.int64)
    grams = marked.select("text", "target").mapInArrow(_exact(held, sc.broadcast(chosen.tobytes())), "g long, a long, t long") \
        .groupBy("g").agg(F.sum("a").alias("a"), F.sum("t").alias("t")).toArrow()      # at most MAX_PAIRS rows
    at = grams["g"].to_numpy()
    counts[0][at], counts[1][at] = grams["t"].to_numpy(), grams["a"].to_numpy()
    model = sc.broadcast(_Model(known, (chosen, counts), (all_.t + v, all_.a + v, all_.et, all_.ea)))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = repeated(docs.select("text"), _pairs(held), total * 4 // 10)
    if labels > MAX_BROADCAST:      # rows behind an exchange have no order of their own; a chunk's texts must keep theirs
        marked = marked.sortWithinPartitions("doc")
    asked = marked.mapInArrow(_settle(held, model, sketch), BLOCK).repartition("part").sortWithinPartitions("part")
    answered = asked.mapInArrow(_count(model), BLOCK).repartition("chunk").sortWithinPartitions("chunk")
    sums = answered.mapInArrow(_sum(model), "doc long, t double, b double, n long, r long").groupBy("doc").agg(
        *(F.sum(c).alias(c) for c in ("t", "b", "n", "r")))
    loss = lambda c: F.coalesce(F.col(c) / F.col("n"), F.lit(0.0))
    return docs.select("doc_id", "doc").join(sums, "doc", "left").select(
        "doc_id", F.coalesce((F.col("n") / F.col("r")).cast("long"), F.lit(0).cast("long")).alias("n_tokens"),
        loss("t").alias("target_loss"), loss("b").alias("background_loss"), (loss("t") - loss("b")).alias("score"))
