"""Toxic spans by a linear-chain conditional random field (operator 9).

Fitting uses a bounded sample of labelled documents (``MAX_TOXIC`` toxic, ``MAX_CLEAN`` clean, the first by
hash of doc_id; longer texts than ``MAX_TRAIN_BYTES`` are not sampled).  The chain is trained on at most ``MAX_SEGMENTS``
segments of ``SEGMENT`` words of that sample: up to half of them with toxic words, in the sample's order, the rest
evenly from the others.  Documents are labelled, tokens
are not, so tokens are labelled first: a word is toxic where it stands in a toxic document and its form or
one of its beginnings is tied to toxic documents (likelihood ratio and lift).  A two-state chain over word
forms and beginnings is then fitted to those tokens by gradient ascent on the conditional
likelihood, and a logistic curve from the documents' marginals to their labels.

Scoring runs forward-backward over all words of each whole text.  A document's score comes from its largest
marginal and the expected number of toxic words; words of marginal 0.5 and more are reported as character
offsets.  Scores depend on the text alone.

Cases: null, empty and wordless texts have marginal 0 and the score that belongs to it; rows of ``labels``
without a label are ignored, with several the largest counts; without both kinds of labels every score is 0;
repeated rows score alike; other columns are kept or ignored, never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOXIC = 1000
MAX_CLEAN = 2000
MAX_TRAIN_BYTES = 200_000
THRESHOLD = 0.7
MIN_RATIO = 25.0       # likelihood ratio (G squared) of a word form with the label
MIN_LIFT = 20.0
COPY_WORD = 9          # letters of a word that tells texts apart
SEGMENT = 64           # words per training sequence
MAX_SEGMENTS = 6000
STEPS = 60
POOL, BATCH = 1024, 128
CACHE_WORDS = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def held_out():
    """Rows never learned from: crc32 of the doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(word: str) -> list[str]:
    return [f"={word}", *(f"<{word[:n]}" for n in range(3, 9) if n <= len(word))]


class Model:
    """weights: log-odds of the toxic state per feature; step: log weight of staying or changing state."""

    def __init__(self, weights: dict[str, float], bias: float, step: np.ndarray, curve: np.ndarray | None):
        self.weights, self.bias, self.step, self.curve = weights, bias, step, curve
        self._odds: dict[str, float] = {}

    def odds(self, words: list[str]) -> np.ndarray:
        """Emission log-odds of the words; what a word weighs is remembered."""
        known = self._odds
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.bias + sum(self.weights.get(f, 0.0) for f in features(w))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def marginals(self, odds: list[np.ndarray]) -> list[np.ndarray]:
        """Posterior of the toxic state for every word of each text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(odds)
        order = np.argsort([len(o) for o in odds], kind="stable")
        order = order[[len(odds[i]) > 0 for i in order]]
        for at in range(0, len(order), BATCH):
            mine = order[at:at + BATCH]
            lengths = np.array([len(odds[i]) for i in mine])
            e = np.zeros((lengths[-1], len(mine)))
            for c, i in enumerate(mine):
                e[:lengths[c], c] = odds[i]
            p = _forward_backward(np.exp(np.clip(e, -15, 15)), lengths, np.exp(self.step))[0]
            for c, i in enumerate(mine):
                out[i] = p[:lengths[c], c]
        return out

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(marginals))
        return 1 / (1 + np.exp(-np.clip(_summary(marginals) @ self.curve, -40, 40)))


def _forward_backward(e: np.ndarray, lengths: np.ndarray, t: np.ndarray):
    """Marginals of state 1 (words x texts; texts sorted by length) and, per step, the joint of both
    states with the step before.  e: odds of state 1, t[i, j]: weight of going from i to j."""
    n, texts = e.shape
    a, b = np.full_like(e, 0.5), np.full_like(e, 0.5)      # cells behind a text stay at 0.5
    first = np.searchsorted(lengths, np.arange(n), side="right")    # texts that still have a word at each step
    a[0] = e[0] / (1 + e[0])
    for k in range(1, n):
        c = first[k]
        x = a[k - 1, c:]
        one = (x * t[1, 1] + (1 - x) * t[0, 1]) * e[k, c:]
        a[k, c:] = one / (one + x * t[1, 0] + (1 - x) * t[0, 0])
    for k in range(n - 2, -1, -1):
        c = first[k + 1]
        y, o = b[k + 1, c:], e[k + 1, c:]
        one = t[1, 1] * o * y + t[1, 0] * (1 - y)
        zero = t[0, 1] * o * y + t[0, 0] * (1 - y)
        b[k, c:] = one / (one + zero)
    p = a * b / (a * b + (1 - a) * (1 - b))
    return p, a, b


def _summary(marginals: list[np.ndarray]) -> np.ndarray:
    top = [m.max() if len(m) else 0.0 for m in marginals]
    many = [np.log1p(m[m >= 0.5].sum()) for m in marginals]
    return np.stack([np.ones(len(top)), top, many], axis=1)


# --- fitting --------------------------------------------------------------------------------------

def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The training texts with their labels: bounded, and never a held-out row."""
    marks = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max("toxic").alias("__toxic")).withColumnRenamed("doc_id", "__id")
    text = docs.select("doc_id", "text").where(F.octet_length("text") <= MAX_TRAIN_BYTES)
    have = text.select(F.col("doc_id").alias("__have"))
    marks = marks.join(have, F.col("__id") == F.col("__have"), "left_semi")
    pick = lambda y, n: marks.where(F.col("__toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(n)
    chosen = pick(1, MAX_TOXIC).union(pick(0, MAX_CLEAN)).collect()
    if len({r["__toxic"] for r in chosen}) < 2:
        return []
    ids = docs.sparkSession.createDataFrame(chosen, "__id long, __toxic int")
    rows = text.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")) \
        .select("__id", "text", "__toxic").dropDuplicates(["__id"])
    return [(r.text, r["__toxic"]) for r in sorted(rows.collect(), key=lambda r: r["__id"])]


def _marked(docs: list[list[str]], y: np.ndarray) -> set[str]:
    """Word forms and beginnings tied to toxic documents."""
    toxic: dict[str, int] = {}
    forms = lambda words: {f for w in set(words) for f in features(w)}
    for words, mark in zip(docs, y.tolist()):
        for f in forms(words) if mark else ():
            toxic[f] = toxic.get(f, 0) + 1
    count = {f: [0, k] for f, k in toxic.items() if k >= 3}
    for words, mark in zip(docs, y.tolist()):
        for f in count.keys() & forms(words) if not mark else ():
            count[f][0] += 1
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    out = set()
    for f, (k0, k1) in count.items():
        if (k1 / n1) / ((k0 + 0.5) / n0) < MIN_LIFT:
            continue
        share = (k0 + k1) / (n0 + n1)
        g = 2 * (k1 * np.log(k1 / (n1 * share)) + (k0 * np.log(k0 / (n0 * share)) if k0 else 0))
        if g >= MIN_RATIO:
            out.add(f)
    return out


def _without_copies(rows: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """The sample without copies: a text most of whose long words stand in earlier texts says nothing
    new, and counted again would tie its chance words to its label."""
    seen: set[str] = set()
    texts: set[str] = set()
    out = []
    for words, toxic in rows:
        long = {w for w in words if len(w) >= COPY_WORD}
        if " ".join(words) in texts or len(long & seen) > 0.5 * len(long) and len(long) >= 5:
            continue
        texts.add(" ".join(words))
        seen |= long
        out.append((words, toxic))
    return out


def fit(rows: list[tuple[str, int]]) -> Model:
    if not rows:
        return Model({}, 0.0, np.zeros((2, 2)), None)
    rows = _without_copies([(_WORD.findall((t or "").lower()), v) for t, v in rows])
    docs, y = [words for words, _ in rows], np.array([v for _, v in rows])
    marked = _marked(docs, y)
    bad = {w for words in docs for w in set(words) if marked.intersection(features(w))}
    segments = []
    for words, toxic in zip(docs, y.tolist()):
        for at in range(0, len(words), SEGMENT):
            part = words[at:at + SEGMENT]
            tags = np.array([toxic and w in bad for w in part], np.float64)
            segments.append((part, tags))
    # segments with toxic words first, then evenly from the rest
    toxic = [s for s in segments if s[1].any()][:MAX_SEGMENTS // 2]
    rest = [s for s in segments if not s[1].any()]
    rest = rest[::max(1, -(-len(rest) // (MAX_SEGMENTS - len(toxic))))]
    model = _train(toxic + rest)
    marg = model.marginals([model.odds(w) for w in docs])
    model.curve = _logistic(_summary(marg), y)
    return model


def _train(segments: list[tuple[list[str], np.ndarray]]) -> Model:
    """Gradient ascent (Adam) on the conditional likelihood of the tags, with a small L2 penalty."""
    segments = sorted((s for s in segments if s[0]), key=lambda s: len(s[0]))
    many: dict[str, int] = {}
    for part, _ in segments:
        for w in part:
            many[w] = many.get(w, 0) + 1
    words = sorted(many)
    seen: dict[str, int] = {}
    for w in words:
        for f in features(w):
            seen[f] = seen.get(f, 0) + many[w]
    names = sorted(f for f, c in seen.items() if c > 1)
    index = {f: i for i, f in enumerate(names)}
    per = [[index[f] for f in features(w) if f in index] for w in words]
    of = np.repeat(np.arange(len(words)), [len(p) for p in per])
    col = np.array([i for p in per for i in p], np.int64)
    at = {w: i for i, w in enumerate(words)}
    lengths = np.array([len(s[0]) for s in segments])
    word = np.zeros((lengths[-1], len(segments)), np.int64)
    tag, real = np.zeros(word.shape), np.zeros(word.shape, bool)
    for c, (part, tags) in enumerate(segments):
        word[:len(part), c] = [at[w] for w in part]
        tag[:len(part), c], real[:len(part), c] = tags, True
    both = real[1:] & real[:-1]
    want = np.array([[((tag[:-1] == i) & (tag[1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    theta = np.zeros(len(names) + 5)
    theta[len(names)] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    size = len(names)
    for k in range(1, STEPS + 1):
        odds = theta[size] + np.bincount(of, weights=theta[col], minlength=len(words))
        e = np.exp(np.clip(odds, -15, 15))[word]
        t = np.exp(theta[size + 1:].reshape(2, 2))
        p, a, b = _forward_backward(e, lengths, t)
        x, z, o = a[:-1], b[1:], e[1:]
        joint = np.stack([(1 - x) * t[0, 0] * (1 - z), (1 - x) * t[0, 1] * o * z,
                          x * t[1, 0] * (1 - z), x * t[1, 1] * o * z])
        joint = np.where(both, joint / joint.sum(axis=0), 0).sum(axis=(1, 2)).reshape(2, 2)
        off = np.where(real, tag - p, 0)
        by_word = np.bincount(word.ravel(), weights=off.ravel(), minlength=len(words))
        grad = np.concatenate([np.bincount(col, weights=by_word[of], minlength=size), [by_word.sum()],
                               (want - joint).ravel()]) - 0.05 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.2 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-6)
    keep = {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3}
    return Model(keep, float(theta[size]), theta[size + 1:].reshape(2, 2), None)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


# --- scoring --------------------------------------------------------------------------------------

def _scored(batches: Iterator[pa.RecordBatch], model: Model):
    """Pieces of the batches with scores, texts and marginals."""
    for batch in batches:
        for at in range(0, batch.num_rows, POOL):
            piece = batch.slice(at, POOL)
            texts = [(t or "").lower() for t in piece.column("text").to_pylist()]
            marg = model.marginals([model.odds(_WORD.findall(t)) for t in texts])
            yield piece, model.score(marg), texts, marg


def _spans(text: str, marginals: np.ndarray) -> list[dict]:
    """Character offsets (in the lower-cased text) of the toxic words, neighbours joined."""
    hits = np.flatnonzero(marginals >= 0.5)
    if not len(hits):
        return []
    words, out, last = list(_WORD.finditer(text)), [], -2
    for k in hits.tolist():
        if k == last + 1:
            out[-1]["end"] = words[k].end()
        else:
            out.append({"start": words[k].start(), "end": words[k].end()})
        last = k
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, s, texts, marg in _scored(batches, held.value):
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)),
                 pa.array([_spans(t, m) for t, m in zip(texts, marg)], spans)],
                ["doc_id", "held_out", "score", "predicted", "spans"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, that are not predicted toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, s, _, _ in _scored(batches, held.value):
            yield piece.filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
