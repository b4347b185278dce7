"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Learning. Labels are of whole documents, so token labels are made from them: a token of a document
labelled 1 is a positive one if its word or the beginning of its word occurs nearly only in such
documents. A chain with two states (clean, toxic), with weights for words, beginnings of words and
transitions, is fitted on those token sequences by gradient ascent on the likelihood. A logistic
curve, fitted on the documents' labels, turns a document's marginals into its score.

Scoring. Every token of every text gets its forward-backward marginal over the whole text. Two states
need only the ratio of the two forward (backward) values. A text is cut into rows of ROW tokens
so that a step of all rows of a batch is one vector operation: first the product of each row's
transition matrices is made, then the ratios at the rows' borders are carried from row to row
(all texts of a batch at once), then the ratios inside the rows follow from those at the borders.

Only the text is an input of a score.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import released, with_struct

WORD = re.compile(r"[^\W_]+")
ROW = 32
#: Labelled documents that the driver learns from at most.
MAX_DOCUMENTS = 2000
#: Occurrences that a word or beginning needs to have a weight if it marks nothing.
LEAST_SEEN = 5
PREFIXES = (4, 5, 6, 7, 8)
#: Words whose odds a worker keeps at once (about 24 MB); then it starts anew.
KEPT_WORDS = 120_000
#: Tokens that a step of learning works on at once, passes over the sample, its rate and its decay.
FIT_TOKENS, PASSES, RATE, DECAY = 1 << 17, 6, 0.5, 1e-4
ODDS_LIMIT = 1e12
#: Characters of text that a worker tags at once; a longer text is tagged alone.
TAGGED_CHARS = 1 << 20


def feature(word: str, kind: int) -> str | None:
    """The word itself (kind 0) or its first `kind` characters, which a mark at the end tells from whole words; None if it is shorter."""
    return word if not kind else f"{word[:kind]}*" if kind <= len(word) else None


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f for k in (0, *PREFIXES) if (f := feature(word, k))]


class _Odds(dict):
    """Odds of the words seen lately."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        found = self.model.odds(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


@dataclass
class ToxicModel:
    """Weights of the chain (toxic against clean) and of the curve from marginals to a score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    transitions: tuple[float, float, float] = (0.0, 0.0, 0.0)  # clean-toxic, toxic-clean, toxic-toxic
    curve: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def __post_init__(self):
        self.kept = _Odds(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.kept = _Odds(self)

    def odds(self, word: str) -> float:
        """exp of the state score of a token, toxic against clean."""
        get = self.weights.get
        return math.exp(min(25.0, max(-25.0, self.bias + sum(get(f, 0.0) for f in features(word.lower())))))


def rows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many tokens: the row where each begins (one more at the end), the places of all tokens in the rows, and which places have one."""
    starts = np.concatenate([[0], np.cumsum(-(-lengths // ROW))]).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    at = np.arange(int(lengths.sum())) + np.repeat(starts[:-1] * ROW - before, lengths)
    real = np.zeros(int(starts[-1]) * ROW, bool)
    real[at] = True
    return starts, at, real.reshape(-1, ROW)


def _carried(starts: np.ndarray, step, forwards: bool) -> np.ndarray:
    """The ratio that goes into each row: 0 at a text's first row (1 at its last if not forwards), then what `step` makes of it and the row."""
    n = np.diff(starts)
    out = np.full(int(starts[-1]), 0.0 if forwards else 1.0)
    order = np.argsort(-n, kind="stable")
    first, n = (starts[:-1] if forwards else starts[1:] - 1)[order], n[order]
    sign = 1 if forwards else -1
    for k in range(1, int(n.max(initial=0))):
        row = first[: np.searchsorted(-n, -k, side="left")] + sign * k  # texts of more than k rows
        out[row] = np.clip(step(row - sign, out[row - sign]), 1 / ODDS_LIMIT, ODDS_LIMIT)
    return out


def ratios(x: np.ndarray, real: np.ndarray, starts: np.ndarray, transitions: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic against clean) of every token of texts; x: odds of each token, in the rows of rows_of.

    A forward ratio has the token's own odds in it. The first token's is its odds. Places without a token leave
    everything as it is. No ratio overflows: each is bounded by its token's odds and the transitions.
    """
    # One array a step: a step of all rows then reads memory in order. Weights of (clean, toxic), (toxic, clean), (toxic, toxic).
    x, real = np.ascontiguousarray(x.T), np.ascontiguousarray(real.T)
    ct, tc, tt = (np.where(real, weight, nothing) for weight, nothing in zip(np.exp(transitions), (0.0, 0.0, 1.0), strict=True))
    begins = starts[:-1][np.diff(starts) > 0]
    ct[0, begins], tc[0, begins], tt[0, begins] = 1.0, 0.0, 0.0
    # Products of (transition, token) of each row, kept near 1: from state i (clean 0, toxic 1) to state j.
    n = x.shape[1]
    a, b, c, d = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for t in range(len(x)):
        a, b = a + b * tc[t], (a * ct[t] + b * tt[t]) * x[t]
        c, d = c + d * tc[t], (c * ct[t] + d * tt[t]) * x[t]
        if t % 4 == 3:
            size = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / size, b / size, c / size, d / size
    into = _carried(starts, lambda row, r: (b[row] + d[row] * r) / (a[row] + c[row] * r), True)
    outof = _carried(starts, lambda row, r: (c[row] + d[row] * r) / (a[row] + b[row] * r), False)
    forward, backward = np.empty_like(x), np.empty_like(x)
    r = into
    for t in range(len(x)):
        r = forward[t] = x[t] * (ct[t] + tt[t] * r) / (1 + tc[t] * r)
    r = outof
    for t in range(len(x) - 1, -1, -1):
        backward[t] = r
        q = x[t] * r
        r = (tc[t] + tt[t] * q) / (1 + ct[t] * q)
    return forward.T, backward.T


def marginals(model: ToxicModel, texts: list[str]) -> list[np.ndarray]:
    """Odds toxic against clean of every token of every text, each text one chain."""
    words = [WORD.findall(t) for t in texts]
    return _marginals(model, [np.fromiter(map(model.kept.__getitem__, w), np.float64, len(w)) for w in words])


def _marginals(model: ToxicModel, odds: list[np.ndarray]) -> list[np.ndarray]:
    lengths = np.array([len(o) for o in odds], np.int64)
    if not lengths.sum():
        return odds
    starts, at, real = rows_of(lengths)
    x = np.ones(real.size)
    x[at] = np.concatenate(odds)
    forward, backward = ratios(x.reshape(-1, ROW), real, starts, model.transitions)
    return np.split((forward * backward).reshape(-1)[at], np.cumsum(lengths)[:-1])


def summary(m: np.ndarray) -> tuple[float, float]:
    """Of a document's marginal odds: log of 1 + the expected number of toxic tokens, and the largest log odds."""
    if not len(m):
        return 0.0, -10.0
    p = m / (1 + m)
    return float(np.log1p(p[p > 0.05].sum())), float(np.clip(np.log(m.max()), -10, 10))


def score_of(model: ToxicModel, m: np.ndarray) -> float:
    a, b, c = model.curve
    total, top = summary(m)
    return float(1 / (1 + np.exp(-(a + b * total + c * top))))


def tokens(text: str) -> tuple[list[str], np.ndarray]:
    """The distinct lower-case words of a whole text, in order, and the place among them of each token."""
    places: dict[str, int] = {}
    at = np.fromiter((places.setdefault(w, len(places)) for w in WORD.findall(text.lower())), np.int32)
    return list(places), at


def packed_tokens(words: list[str], at: np.ndarray) -> bytes:
    """The same as one compressed value."""
    text = " ".join(words).encode("utf-8", "surrogatepass")
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(text)) + text + at.tobytes())


def unpacked_tokens(data: bytes) -> tuple[list[str], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    end = 4 + struct.unpack_from("<I", raw)[0]
    return raw[4:end].decode("utf-8", "surrogatepass").split(), np.frombuffer(raw[end:], np.int32)


def token_labels(words: list[list[str]], labels: np.ndarray) -> set[str]:
    """Features that occur nearly only in documents labelled 1, by smoothed log odds. One kind is counted at a time."""
    ones, zeros = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    least = max(3, round(0.003 * ones))
    out: set[str] = set()
    for kind in (0, *PREFIXES):
        seen = [Counter(), Counter()]
        for wanted in (1, 0):  # of the others only features of documents labelled 1 matter
            for own, y in zip(words, labels, strict=True):
                if int(y) == wanted:
                    found = {f for w in own if (f := feature(w, kind))}
                    seen[wanted].update(found if wanted else found & seen[1].keys())
            if wanted:
                seen[1] = Counter({f: n for f, n in seen[1].items() if n >= least})
        out |= {f for f, n in seen[1].items() if np.log((n + 0.1) / (ones + 0.2)) - np.log((seen[0][f] + 0.1) / (zeros + 0.2)) >= 4.0}
    return out


def fit(texts: list[str], labels: list[int], passes: int = PASSES) -> ToxicModel:
    """A model from labelled texts. Without any text, or without both labels, the prior score alone, under 1/2 without a label 1."""
    return fit_tokens([tokens(t) for t in texts], labels, passes)


def fit_tokens(documents: list[tuple[list[str], np.ndarray]], labels: list[int], passes: int = PASSES) -> ToxicModel:
    """The same from the tokens of the texts. A step takes the gradient over about FIT_TOKENS tokens of whole texts."""
    y = np.array(labels, np.float64)
    prior = (y.sum() + 0.5) / (len(y) + (1.0 if y.any() else 2.0))
    model = ToxicModel(curve=(float(np.log(prior / (1 - prior))), 0.0, 0.0))
    if not 0 < y.sum() < len(y):
        return model
    marks = token_labels([words for words, _ in documents], y)
    places: dict[str, int] = {}
    sequences = [np.array([places.setdefault(w, len(places)) for w in words], np.int32)[at] for words, at in documents]
    names: list[str] = []
    for kind in (0, *PREFIXES):
        count = Counter(f for w in places if (f := feature(w, kind)))
        names += [f for f, n in count.items() if f in marks or n >= LEAST_SEEN]
    del count
    names.sort()
    column = {f: i for i, f in enumerate(names)}
    pairs = np.array([(i, column[f]) for w, i in places.items() for f in features(w) if f in column], np.int64).reshape(-1, 2)
    toxic_word = np.array([any(f in marks for f in features(w)) for w in places])

    # Steps have texts of both labels in the sample's proportion, and whole texts.
    mixed = np.argsort(np.concatenate([(np.arange(k) + 0.5) / k for k in (int((y == 0).sum()), int((y == 1).sum()))]), kind="stable")
    mixed = np.concatenate([np.flatnonzero(y == 0), np.flatnonzero(y == 1)])[mixed]
    mixed = [i for i in mixed.tolist() if len(sequences[i])]
    step_of = np.cumsum([len(sequences[i]) for i in mixed]) // FIT_TOKENS
    steps = np.split(np.array(mixed, np.int64), np.flatnonzero(np.diff(step_of)) + 1)

    weights, bias, trans = np.zeros(len(names)), -4.0, np.zeros(3)
    squares = [np.full(len(names), 1e-3), 1e-3, np.full(3, 1e-3)]
    for own in steps * passes:
        if not len(own):
            continue
        parts = [sequences[i] for i in own.tolist()]
        lengths = np.array([len(p) for p in parts], np.int64)
        starts, at, real = rows_of(lengths)
        word = np.concatenate(parts)
        truth = np.zeros(real.size)
        truth[at] = toxic_word[word] & (np.repeat(y[own], lengths) > 0)
        per_word = np.bincount(pairs[:, 0], weights=weights[pairs[:, 1]], minlength=len(places)) + bias
        x = np.ones(real.size)
        x[at] = np.exp(np.clip(per_word[word], -25, 25))
        f, b = (r.reshape(-1)[at] for r in ratios(x.reshape(-1, ROW), real, starts, tuple(trans)))
        m, x, truth = f * b, x[at], truth[at]
        miss = truth - m / (1 + m)
        # Pair marginals of neighbours: weights of (clean, toxic), (toxic, clean), (toxic, toxic) against (clean, clean).
        inside = np.ones(len(word), bool)
        inside[np.cumsum(lengths) - 1] = False
        left = np.flatnonzero(inside)
        r, q, was, now = f[left], x[left + 1] * b[left + 1], truth[left], truth[left + 1]
        both = np.stack([np.exp(trans[0]) * q, np.exp(trans[1]) * r, np.exp(trans[2]) * r * q])
        both /= 1 + both.sum(0)
        seen = np.stack([(1 - was) * now, was * (1 - now), was * now])
        scale = max(1.0, float(truth.sum()))
        gradients = [
            np.bincount(pairs[:, 1], weights=np.bincount(word, weights=miss, minlength=len(places))[pairs[:, 0]], minlength=len(names)) / scale - DECAY * weights,
            miss.sum() / scale,
            (seen - both).sum(1) / scale - DECAY * trans,
        ]
        squares = [s + g * g for s, g in zip(squares, gradients, strict=True)]
        weights = weights + RATE * gradients[0] / np.sqrt(squares[0])
        bias = bias + RATE * gradients[1] / np.sqrt(squares[1])
        trans = np.clip(trans + RATE * gradients[2] / np.sqrt(squares[2]), -6, 6)
    model.weights = {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-3}
    model.bias, model.transitions = float(bias), tuple(map(float, trans))
    parts = [documents[k : k + 100] for k in range(0, len(documents), 100)]
    odds_of = ([np.array([model.odds(w) for w in words], np.float64)[at] for words, at in part] for part in parts)
    model.curve = _curve(np.array([summary(m) for odds in odds_of for m in _marginals(model, odds)]), y)
    model.kept.clear()
    return model


def _curve(given: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(y)), given])
    w, ridge = np.zeros(3), np.diag([1e-6, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return tuple(map(float, w))


def held_out(key) -> F.Column:
    """True for the fifth of the keys that no model learns from: crc32 of the key as text by 5 is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_documents: int = MAX_DOCUMENTS) -> ToxicModel:
    """A model from at most max_documents labelled rows (those whose keys hash lowest), none of them held out.

    Only rows are bounded: whole texts are read, on the executors, and the driver gets each text's distinct words and
    four bytes for each token, compressed.
    """

    @F.arrow_udf("binary")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([packed_tokens(*tokens(t.as_py() or "")) for t in texts], pa.binary())

    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~held_out("k"))
    some = marked.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_documents)
    texts = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(some), "k")
    rows = texts.select("k", "y", F.xxhash64("t").alias("h"), split("t").alias("s")).orderBy("k", "h").limit(max_documents).collect()
    return fit_tokens([unpacked_tokens(r.s) for r in rows], [r.y for r in rows])


FIELDS = ["score", "predicted", "n_toxic_tokens", "toxic_spans"]


def tag(df: DataFrame, model: ToxicModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with score, predicted, n_toxic_tokens and toxic_spans.

    toxic_spans: start:end of the tokens with marginal 1/2 or more, neighbours joined, in code
    points, comma-joined. A null text counts as empty and gets the score of no tokens. Whole texts
    are read; columns of these names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,predicted:int,n_toxic_tokens:bigint,toxic_spans:string>")
    def tagged(texts: pa.Array) -> pa.Array:
        m = sent.value
        scores, counts, spans = [], [], []
        held: list[str] = []
        size = 0

        def flush():
            for value, odds in zip(held, marginals(m, held), strict=True):
                scores.append(score_of(m, odds))
                hit = np.flatnonzero(odds >= 1)
                counts.append(len(hit))
                spans.append(_spans(value, hit) if len(hit) else "")
            held.clear()

        for t in texts:
            held.append(t.as_py() or "")
            size += len(held[-1])
            if size >= TAGGED_CHARS:
                flush()
                size = 0
        flush()
        released()
        made = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())]
        return pa.StructArray.from_arrays(made, FIELDS)

    return with_struct(df, tagged(F.col(f"`{text}`")), FIELDS, keep)


def _spans(text: str, hit: np.ndarray) -> str:
    wanted, out, last = set(hit.tolist()), [], -2
    for k, m in enumerate(WORD.finditer(text)):
        if k in wanted:
            if last == k - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = k
    return ",".join(f"{a}:{b}" for a, b in out)
