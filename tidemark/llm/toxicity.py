"""Toxic spans and document scores by a linear-chain conditional random field.

Learning.  From a bounded sample of labelled documents, Spark counts in how
many toxic and clean documents each word and word beginning occurs; those that
clearly go with the toxic label become features.  They label the tokens of the
sampled documents, and the field (feature weights, bias, transitions between
clean and toxic tokens) is trained on windows of these tokens.

Tagging.  Most tokens carry no feature and so have the same potentials: a run
of them is a power of one 2 x 2 matrix, known in closed form.  Forward-backward
thus visits only tokens with features and gives exact marginals in one narrow
map over whole texts.  The score of a document is a logistic function, fitted
to the sampled labels, of its largest token marginal, the sum of its marginals
and its length; runs of tokens above ``SPAN_MARGINAL`` are the offending spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import hash_sample, in_slices, keyed_text, lean, rows, stored

#: Labelled documents that are learned from at most, and features at most.
TRAIN_DOCS, MAX_FEATURES = 12_000, 20_000
#: Tokens of the window that the field is trained on, one for each sampled document.
WINDOW_TOKENS = 48
#: Least share of toxic documents among those with a feature, and documents that it must occur in.
MIN_SHARE, MIN_DOCS = 0.5, 4
#: The log-likelihood ratio must exceed this and twice the log of the number of candidates, so that chance yields few features.
MIN_RATIO = 14.0
PREFIXES = (4, 5, 6)
SPAN_MARGINAL, PREDICT_AT = 0.5, 0.7
#: Tokens that a worker remembers before it forgets all, and bytes of text that it handles at a time: bound memory, never results.
CACHE_ENTRIES, SLICE_BYTES = 200_000, 2 << 20

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\S+")


def _keys(word: str) -> list[str]:
    """The word, then its beginnings, each an own kind of feature."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


@dataclass
class ToxicityModel:
    """Feature weights, bias of the toxic state, transition scores ``[from][to]``, and the weights of a document's aggregates."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    transitions: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    document: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0)

    def tagger(self) -> Tagger:
        return Tagger(self)


class Tagger:
    """Applies a model to texts, in one worker."""

    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}
        self.step = np.exp(np.array(model.transitions))
        plain = self.step * np.array([1.0, np.exp(model.bias)])
        values, vectors = np.linalg.eig(plain)
        values, vectors = values.real, vectors.real
        first = int(np.argmax(values))
        inverse = np.linalg.inv(vectors)
        self.top = np.outer(vectors[:, first], inverse[first])
        self.rest = np.outer(vectors[:, 1 - first], inverse[1 - first])
        self.ratio = float(values[1 - first] / values[first])

    def _run(self, n: int) -> np.ndarray:
        """The product over ``n`` tokens without features, up to a factor."""
        return self.top + self.ratio**n * self.rest if n else np.eye(2)

    def weight(self, token: str) -> float:
        """The strongest feature of the words in a token; 0 without any."""
        found = self.known.get(token)
        if found is None:
            get = self.model.weights.get
            found = max((get(k, 0.0) for w in _WORD.findall(token.lower()) for k in _keys(w)), default=0.0)
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[token] = found
        return found

    def marginals(self, tokens: list[str]) -> tuple[list[int], np.ndarray]:
        """Places of tokens with features, and their probabilities of being toxic."""
        weights = list(map(self.weight, tokens))
        at = [i for i, w in enumerate(weights) if w]
        if not at:
            return at, np.zeros(0)
        steps = [self.step * np.array([1.0, np.exp(self.model.bias + weights[i])]) for i in at]
        gaps = [b - a - 1 for a, b in zip([-1, *at], [*at, len(tokens)])]
        ahead, forward = np.array([1.0, 0.0]), []
        for gap, step in zip(gaps, steps):
            ahead = ahead @ self._run(gap) @ step
            ahead /= ahead.sum()
            forward.append(ahead)
        back, toxic = self._run(gaps[-1]) @ np.ones(2), []
        for k in range(len(at) - 1, -1, -1):
            both = forward[k] * back
            toxic.append(both[1] / both.sum())
            back = self._run(gaps[k]) @ steps[k] @ back
            back /= back.sum()
        return at, np.clip(np.array(toxic[::-1]), 0.0, 1.0)

    def aggregates(self, toxic: np.ndarray, n_tokens: int) -> np.ndarray:
        """What a document's score is a function of: a constant, the largest marginal as log-odds, the log of their sum, the log of its length."""
        most = float(toxic.max()) if len(toxic) else 0.0
        odds = np.log(np.clip(most, 1e-4, 1 - 1e-4)) - np.log1p(-np.clip(most, 1e-4, 1 - 1e-4))
        return np.array([1.0, odds, np.log(1e-3 + toxic.sum()), np.log1p(n_tokens)])

    def document(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score and offending spans: start and end in characters, and the largest marginal."""
        tokens = (text or "").split()
        at, toxic = self.marginals(tokens)
        score = float(1.0 / (1.0 + np.exp(-(self.aggregates(toxic, len(tokens)) @ np.array(self.model.document)))))
        if not at:
            return score, []
        spans: list[list[int | float]] = []
        over = {i: float(p) for i, p in zip(at, toxic) if p >= SPAN_MARGINAL}
        if over:
            last = -2
            for i, m in enumerate(_TOKEN.finditer(text)):
                if i in over:
                    if last == i - 1:
                        spans[-1][1], spans[-1][2] = m.end(), max(spans[-1][2], over[i])
                    else:
                        spans.append([m.start(), m.end(), over[i]])
                    last = i
        return score, [tuple(s) for s in spans]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of at most ``TRAIN_DOCS`` labelled documents, chosen by a hash of their ids."""
    known = labels.where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = hash_sample(known, TRAIN_DOCS, "id")
    return docs.where("text IS NOT NULL").join(F.broadcast(chosen), "id").select("text", "toxic")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, toxic in rows(batches, "text", "toxic"):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(texts, toxic):
            counts[label == 1].update({k for w in set(_WORD.findall(text.lower())) for k in _keys(w)})
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
            ["feature", "toxic", "clean"],
        )


def _features(sample: DataFrame) -> list[str]:
    """What clearly goes with the toxic label, clearest first."""
    totals = sample.agg(F.sum((F.col("toxic") == 1).cast("long")), F.sum((F.col("toxic") != 1).cast("long"))).first()
    if not totals[0] or not totals[1]:
        return []
    a, b, n1, n0 = F.col("toxic"), F.col("clean"), float(totals[0]), float(totals[1])

    def part(seen: Column, of: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)

    n, share = n1 + n0, (a + b) / (n1 + n0)
    ratio = 2 * (
        part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share))
    )
    counted = sample.mapInArrow(lambda batches: lean(_count(batches)), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = stored(counted.where((a + b >= MIN_DOCS) & (a + b < n)), "features")
    clear = (
        counted.where(a >= MIN_SHARE * (a + b))
        .select("feature", ratio.alias("ratio"))
        .where(F.col("ratio") >= max(MIN_RATIO, 2 * math.log(max(1, counted.count()))))
        .orderBy(F.desc("ratio"), F.desc(F.length("feature")), "feature")  # the most specific of equals
        .limit(MAX_FEATURES)
    )
    return [r.feature for r in clear.collect()]


def _windows(sample: DataFrame, features: list[str]) -> np.ndarray:
    """Windows of feature numbers + 1 (0: none) and labels, int32 of shape (windows, 2, tokens).

    One window for each document, around its first feature.
    """
    number = {f: i + 1 for i, f in enumerate(features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, toxic in rows(batches, "text", "toxic"):
            out, size = [], WINDOW_TOKENS
            for text, label in zip(texts, toxic):
                ids = [min((number[k] for w in _WORD.findall(t.lower()) for k in _keys(w) if k in number), default=0) for t in text.split()]
                at = next((i for i, x in enumerate(ids) if x), 0)
                start = max(0, at - size // 2)
                some = ids[start : start + size]
                some += [-1] * (size - len(some))
                out.append(np.array([some, [int(label == 1 and x > 0) for x in some]], dtype="<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["window"])

    got = sample.mapInArrow(lambda batches: lean(run(batches)), "window binary").collect()
    return np.frombuffer(b"".join(bytes(r.window) for r in got), dtype="<i4").reshape(-1, 2, WINDOW_TOKENS)


def _train(windows: np.ndarray, n_features: int, rounds: int = 250, rate: float = 0.6, l2: float = 1e-6) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum likelihood of the labelled windows, by gradient steps with adaptive rates."""
    ids, labels = np.maximum(windows[:, 0], 0), windows[:, 1]
    real = windows[:, 0] >= 0
    n, size = ids.shape
    w, bias, trans = np.zeros(n_features + 1), -4.0, np.zeros((2, 2))
    seen = [np.zeros_like(w), np.zeros(1), np.zeros((2, 2))]
    for _ in range(rounds):
        weight = np.where(ids > 0, w[ids], 0.0)
        emit = np.stack([np.ones((n, size)), np.exp(np.clip(bias + weight, -30, 30))], -1)
        emit[~real] = 1.0
        step = np.exp(trans)
        alpha, beta = np.zeros((size, n, 2)), np.ones((size, n, 2))
        alpha[0] = np.array([1.0, 0.0]) @ step * emit[:, 0]
        alpha[0] /= alpha[0].sum(-1, keepdims=True)
        for t in range(1, size):
            alpha[t] = alpha[t - 1] @ step * emit[:, t]
            alpha[t] /= alpha[t].sum(-1, keepdims=True)
        for t in range(size - 2, -1, -1):
            beta[t] = (emit[:, t + 1] * beta[t + 1]) @ step.T
            beta[t] /= beta[t].sum(-1, keepdims=True)
        both = alpha * beta
        p = (both[..., 1] / both.sum(-1)).T
        miss = np.where(real, labels - p, 0.0)
        pair = alpha[:-1, :, :, None] * step * (emit.transpose(1, 0, 2)[1:] * beta[1:])[:, :, None, :]
        pair /= pair.sum((-1, -2), keepdims=True)
        pair *= real.T[1:, :, None, None]
        was, now = labels[:, :-1][real[:, 1:]], labels[:, 1:][real[:, 1:]]
        truth = np.bincount(was * 2 + now, minlength=4).reshape(2, 2)
        steps = [np.bincount(ids.ravel(), miss.ravel(), n_features + 1) / n - l2 * w, np.array([miss.sum() / n - l2 * bias]), (truth - pair.sum((0, 1))) / n - l2 * trans]
        steps[0][0] = 0.0
        for s, g in zip(seen, steps):
            s += g * g
        w, bias, trans = w + rate * steps[0] / np.sqrt(seen[0] + 1e-12), bias + float(rate * steps[1][0] / np.sqrt(seen[1][0] + 1e-12)), trans + rate * steps[2] / np.sqrt(seen[2] + 1e-12)
    return w, bias, trans


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from at most ``TRAIN_DOCS`` labelled documents; without both labels the model finds nothing toxic."""
    sample = _sample(keyed_text(docs, id_col, text_col), labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")))
    features = _features(sample)
    if not features:
        return ToxicityModel()
    w, bias, trans = _train(_windows(sample, features), len(features))
    weights = {f: float(x) for f, x in zip(features, w[1:]) if x > 0}
    model = ToxicityModel(weights, bias, tuple(map(tuple, trans.tolist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model.tagger()
        for texts, toxic in rows(batches, "text", "toxic"):
            cut = [x.split() for x in texts]
            values = [tagger.aggregates(tagger.marginals(t)[1], len(t)).tolist() for t in cut]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), pa.array([x == 1 for x in toxic], pa.bool_())], ["x", "y"])

    got = sample.mapInArrow(lambda batches: lean(run(batches)), "x array<double>, y boolean").collect()
    return replace(model, document=tuple(_logistic(np.array([r.x for r in got]), np.array([r.y for r in got])).tolist()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge so that separable labels have a solution."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def tag(df: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, spans``: the toxic spans of every whole text and its score between 0 and 1.

    Null and empty texts have the score of a text without evidence and no
    spans; repeated rows are each scored alike; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model.tagger()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("marginal", pa.float64())]))
        for ids, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            found = [tagger.document(x) for x in texts]
            spans = [[{"start": a, "stop": b, "marginal": p} for a, b, p in s] for _, s in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s for s, _ in found], pa.float64()), pa.array(spans, kind)], ["id", "score", "spans"])

    schema = "id long, score double, spans array<struct<start: long, stop: long, marginal: double>>"
    return keyed_text(df, id_col, text_col).mapInArrow(lambda batches: lean(run(batches)), schema).withColumnRenamed("id", id_col)


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def keep_clean(df: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """``df`` without the documents that score ``PREDICT_AT`` or more; all columns stay.

    Null and empty texts are scored as in :func:`tag`, equal rows stay or go
    together, null ids do not matter, and an empty table stays empty.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model.tagger()
        for batch in in_slices(batches, text_col, SLICE_BYTES):
            texts = batch.column(names.index(text_col)).to_pylist()
            yield batch.filter(pa.array([tagger.document(x)[0] < PREDICT_AT for x in texts], pa.bool_()))

    return df.mapInArrow(lambda batches: lean(run(batches)), df.schema)
