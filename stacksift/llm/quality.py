"""Quality by random-indexing word vectors and a two-layer network in numpy.

Every token has a sparse random index vector, fixed by its hash bucket. A word's vector is the sum of the index vectors
that stand around it in the fit's texts; a document pools the vectors of all its words, and beside them the index vectors
of its tokens' shapes (first and last byte, case, length), which unseen words share. A two-layer network scores the
pooled vector; a part of the fit set aside gives the temperature that calibrates its probabilities.

The fit uses at most ``caps`` labelled documents; every whole text is scored. Defined cases: a null or empty text pools
to zero and gets the network's score for that. Without labels of both kinds all scores are the share of label 1.
Repeated rows score alike, rows without doc_id aren't held out. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, lean, mix, texts
from .labelled import held_out, sample

BASE, WORDS, SHAPES, DIM, HIDDEN = 0xD1342543DE82EF95, 1 << 14, 1 << 12, 32, 24
#: Documents of label 0 and 1 in the fit at most.
CAPS = (1000, 1000)
CHUNK, TOKENS = 1 << 20, 1 << 17


def index_vectors(rows: int, seed: int, ones: int = 4) -> np.ndarray:
    """Sparse ternary vectors."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIM), np.float32)
    at = np.argsort(rng.random((rows, DIM)), axis=1)[:, :ones]
    np.put_along_axis(out, at, rng.choice(np.float32([-1, 1]), (rows, ones)), axis=1)
    return out


INDEX, SHAPE = index_vectors(WORDS, 11), index_vectors(SHAPES, 12)


def tokens(some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and shape buckets of all tokens, and where each text's tokens begin."""
    raw = np.frombuffer(b" " + b" ".join(some) + b" ", np.uint8)
    space = raw <= 32
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    word = (mix(Rolling(raw, BASE).span(start, end)) & np.uint64(WORDS - 1)).astype(np.int64)
    upper = np.append(0, np.cumsum((raw >= 65) & (raw <= 90)))
    size = end - start
    caps = np.minimum(upper[end] - upper[start], 2) + 3 * (upper[end] - upper[start] > size // 2)
    first, last = raw[start], raw[end - 1]
    letter = lambda c: np.where((c | 32 >= 97) & (c | 32 <= 122), 97, np.where(c >= 128, 128, np.where((c >= 48) & (c <= 57), 48, c)))
    code = ((letter(first).astype(np.uint64) * np.uint64(256) + letter(last)) * np.uint64(8) + caps.astype(np.uint64)) * np.uint64(8) + np.minimum(size // 4, 7).astype(np.uint64)
    shape = (mix(code) & np.uint64(SHAPES - 1)).astype(np.int64)
    edge = np.cumsum([1, *(len(t) + 1 for t in some)])
    return word, shape, np.searchsorted(start, edge)


def _parts(some: list[bytes]) -> Iterator[list[bytes]]:
    part, held = [], 0
    for t in some:
        part.append(t)
        held += len(t)
        if held > CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


def context_vectors(some: list[bytes]) -> np.ndarray:
    """By word bucket: what stands up to two tokens away, as a unit vector."""
    total = np.zeros((WORDS, DIM))
    for part in _parts(some):
        word, _, edge = tokens(part)
        text = np.repeat(np.arange(edge.size - 1), np.diff(edge))
        for step in (1, 2):
            same = text[step:] == text[:-step]
            a, b = word[:-step][same], word[step:][same]
            for d in range(DIM):
                total[:, d] += np.bincount(a, INDEX[b, d], WORDS) + np.bincount(b, INDEX[a, d], WORDS)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(some: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Means of word vectors and of shape vectors, how well the index vectors of tokens agree with those one and two
    places before, how far their mean is from zero, and the logarithm of the number of tokens."""
    out = np.zeros((len(some), 2 * DIM + 4))
    mean = np.zeros((len(some), DIM))
    done = 0
    for part in _parts(some):
        word, shape, edge = tokens(part)
        text = np.repeat(np.arange(edge.size - 1), np.diff(edge))
        for at in range(0, word.size, TOKENS):
            s = slice(at, at + TOKENS)
            begin = np.flatnonzero(np.append(True, np.diff(text[s]) != 0))
            row = done + text[s][begin]
            out[row, :DIM] += np.add.reduceat(vectors[word[s]], begin, axis=0, dtype=np.float64)
            out[row, DIM : 2 * DIM] += np.add.reduceat(SHAPE[shape[s]], begin, axis=0, dtype=np.float64)
            mean[row] += np.add.reduceat(INDEX[word[s]], begin, axis=0, dtype=np.float64)
        for step in (1, 2):
            alike = (word[step:] == word[:-step]) & (text[step:] == text[:-step])
            out[done : done + len(part), 2 * DIM + step - 1] = np.bincount(text[step:][alike], minlength=len(part))
        n = np.diff(edge)
        rows = slice(done, done + len(part))
        out[rows, : 2 * DIM + 2] /= np.maximum(n, 1)[:, None]
        out[rows, -2] = np.linalg.norm(mean[rows], axis=1) / np.maximum(n, 1)
        out[rows, -1] = np.log1p(n) / 10
        done += len(part)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float = 1.0
    share: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.centre) / self.spread @ a + b) @ c + d

    def score(self, some: list[bytes]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(some), self.share)
        return _sigmoid(self.logits(pooled(some, self.vectors)) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(some: list[bytes], y: np.ndarray, share: float, steps: int = 500, rate: float = 0.02, seed: int = 4) -> Model:
    """Adam on the logistic loss, classes weighted by their share among all labels; then the temperature."""
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros((1, 1)), np.zeros(1), np.ones(1), (), share=share)
    vectors, rng = context_vectors(some), np.random.default_rng(seed)
    x = pooled(some, vectors)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 0.02
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    aside = rng.random(y.size) < 0.2
    layers = [rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(())]
    model = Model(vectors, centre, spread, tuple(layers))
    u, t, w = ((x - centre) / spread)[~aside], y[~aside], weight[~aside] / weight[~aside].sum()
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, steps + 1):
        a, b, c, d = layers
        h = np.tanh(u @ a + b)
        wrong = w * (_sigmoid(h @ c + d) - t)
        back = wrong[:, None] * c * (1 - h * h)
        slopes = [u.T @ back + 1e-4 * a, back.sum(axis=0), h.T @ wrong + 1e-4 * c, wrong.sum()]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            layers[i] = layers[i] - rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(layers)
    model.temperature = _temperature(model.logits(x[aside]), y[aside], weight[aside])
    return model


def _temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Least weighted log loss, by golden section over the logarithm."""
    if not z.size:
        return 1.0
    loss = lambda s: float(np.average(np.logaddexp(0, np.where(y == 1, -z, z) / np.exp(s)), weights=weight))
    low, high, cut = -1.5, 2.5, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _score(model: Model, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return score


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, caps: tuple[int, int] = CAPS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    aside = held_out(4, 2)
    model = fit(*sample(docs, labels, "quality", aside, caps))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), aside.alias("held_out"), "text")
    return rows.mapInArrow(lean(_score(model, threshold)), "doc_id long, held_out boolean, score double, predicted int")
