"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams, its ends marked, so that an unseen spelling shares vectors with the known one; a
run of one word counts once.
Embeddings are averaged over windows of a few words and go through a linear softmax; a document is as toxic as its most
toxic window, so that one insult counts in a long text: the average over a whole document dilutes it (the README has the
figures of both). Labels are of documents: training lets the most toxic windows stand for their document, embeddings and
softmax moving together.

At scoring time softmax and average are both linear, so each n-gram bucket has one number: its embedding's product with
the softmax's direction. What the executors get is that vector, of fixed size.

The fit uses at most ``caps`` labelled documents and holds the n-grams of their distinct words; every whole text is scored. Defined cases: a null or empty text has no
window and scores as the softmax's bias. Without labels of both kinds all scores are the share of label 1. Repeated rows
score alike, rows without doc_id aren't held out. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, give_back, lean, mix, texts
from .labelled import held_out, sample

BASE, BUCKETS, DIM = 0x9E3779B97F4A7C15, 1 << 18, 4
GRAMS, WINDOW, STRIDE = (4, 5, 6), 8, 4
#: Documents of label 0 and 1 in the fit at most.
CAPS = (1200, 700)
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
CHUNK = 1 << 20


def _parts(some: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, about CHUNK bytes at a time."""
    part, held = [], 0
    for t in some:
        part.append(t)
        held += len(t)
        if held > CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers from each begin to before its end, and which range each is from."""
    size = end - begin
    of = np.repeat(np.arange(size.size, dtype=np.int32), size)
    return of, np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(of.size)


def _words(some: list[bytes]) -> tuple[np.ndarray, ...]:
    """Bytes of all texts; first byte, end and name of each word, a run of one word once; words of each text."""
    raw = np.frombuffer((b" " + b" ".join(some) + b" ").translate(LETTERS), np.uint8)
    space = raw == 32
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    name = Rolling(raw, BASE).span(starts, ends)
    fresh = np.append(True, name[1:] != name[:-1])[: name.size]
    starts, ends, name = starts[fresh], ends[fresh], name[fresh]
    edge = np.cumsum([1, *(len(t) + 1 for t in some)])
    return raw, starts, ends, name, np.diff(np.searchsorted(starts, edge))


def _grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram buckets of words with the bytes beside them, word by word, and how many each has."""
    counts, buckets, owners = np.zeros(starts.size, np.int32), [], []
    rolling = Rolling(raw, BASE)
    for n in GRAMS:
        of, at = _ranges(starts - 1, np.maximum(ends + 2 - n, starts - 1))
        buckets.append((mix(rolling.span(at, at + n) + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        owners.append(of)
        counts += np.bincount(of, minlength=starts.size).astype(np.int32)
    return np.concatenate(buckets)[np.argsort(np.concatenate(owners), kind="stable")], counts


class Bags:
    """N-gram buckets of some texts, by distinct word: a word has the same ones wherever it stands; windows of words, by text."""

    def __init__(self, some: list[bytes]):
        nothing = np.zeros(0, np.int32)
        self.gram, self.counts, self.docs = nothing, nothing, len(some)
        names, numbers = np.zeros(0, np.uint64), nothing  # of the distinct words so far, names in order
        words, sizes, held = [nothing], [nothing], 0
        for part in _parts(some):
            raw, starts, ends, name, size = _words(part)
            found, first, which = np.unique(name, return_index=True, return_inverse=True)
            at = np.searchsorted(names, found)
            new = (at == names.size) | (np.append(names, np.uint64(0))[at] != found)
            number = np.empty(found.size, np.int32)
            number[~new] = numbers[at[~new]]
            number[new] = held + np.arange(new.sum())
            held += int(new.sum())
            names, numbers = np.insert(names, at[new], found[new]), np.insert(numbers, at[new], number[new])
            gram, counts = _grams(raw, starts[first[new]], ends[first[new]])
            self.gram, self.counts = np.concatenate([self.gram, gram]), np.concatenate([self.counts, counts])
            words.append(number[which])
            sizes.append(size)
        self.words, size = np.concatenate(words), np.concatenate(sizes)
        self.first = np.append(0, np.cumsum(size, dtype=np.int64))
        self.edge = np.append(0, np.cumsum(self.counts, dtype=np.int64))
        per = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1), 0)
        self.of = np.repeat(np.arange(size.size), per)
        self.begin = self.first[:-1][self.of] + STRIDE * (np.arange(self.of.size) - np.repeat(np.cumsum(per) - per, per))
        self.end = np.minimum(self.begin + WINDOW, self.first[1:][self.of])
        total = np.append(0, np.cumsum(self.counts[self.words], dtype=np.int64))
        self.weight = np.maximum(1, total[self.end] - total[self.begin])

    def spread(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words from each begin to its end, and which of these runs each is from."""
        row, at = _ranges(begin, end)
        word = self.words[at]
        owner, at = _ranges(self.edge[word], self.edge[word + 1])
        return self.gram[at], row[owner]

    def means(self, value: np.ndarray) -> np.ndarray:
        """Of a number by bucket, in each window."""
        of = np.bincount(np.repeat(np.arange(self.counts.size, dtype=np.int32), self.counts), value[self.gram], self.counts.size)
        total = np.append(0.0, np.cumsum(of[self.words]))
        return (total[self.end] - total[self.begin]) / self.weight

    def most(self, value: np.ndarray) -> np.ndarray:
        """Largest window mean of each text; minus infinity without windows."""
        out = np.full(self.docs, -np.inf)
        np.maximum.at(out, self.of, self.means(value))
        return out


@dataclass
class Model:
    value: np.ndarray
    bias: float
    share: float | None = None

    def score(self, some: list[bytes]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(some), self.share)
        top = np.concatenate([np.zeros(0), *(Bags(p).most(self.value) for p in _parts(some))])
        return _sigmoid(np.where(np.isfinite(top), top, 0.0) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _odds(bags: Bags, y: np.ndarray) -> np.ndarray:
    """Log-odds of label 1 by bucket from how many texts hold it: where embeddings start from."""
    ones, zeros = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for d in range(bags.docs):
        own = np.unique(bags.words[bags.first[d] : bags.first[d + 1]])
        _, at = _ranges(bags.edge[own], bags.edge[own + 1])
        (ones if y[d] == 1 else zeros)[np.unique(bags.gram[at])] += 1
    p, n = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    odds = np.log((ones + 0.5) / (p + 1)) - np.log((zeros + 0.5) / (n + 1))
    return np.where(ones + zeros >= 4, np.clip(odds, -2, 5), 0.0)


def fit(some: list[bytes], y: np.ndarray, share: float, rounds: int = 6, steps: int = 12, rate: float = 0.4, seed: int = 5) -> Model:
    """Rounds choose each text's most toxic windows; steps move embeddings and softmax by their gradients (AdaGrad)."""
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(1), 0.0, share)
    bags, rng = Bags(some), np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (BUCKETS, DIM))
    table[:, 0] += _odds(bags, y)
    direction, bias = np.append(2.0, np.full(DIM - 1, 0.1)), -4.0
    # as rare among the weights as among all labels
    weight = np.where(y == 1, 1.0, (1 - share) / max(share, 1e-6) * (y == 1).sum() / (y == 0).sum())
    weight /= weight.mean()
    grown, drift, lean = np.full((BUCKETS, DIM), 1e-3), np.full(DIM, 1e-3), 1e-3
    for _ in range(rounds):
        mean = bags.means(table @ direction)
        by = np.lexsort((-mean, bags.of))
        place = np.arange(by.size) - np.searchsorted(bags.of[by], bags.of[by])
        chosen = by[place < 3]
        flat, row = bags.spread(bags.begin[chosen], bags.end[chosen])
        text = bags.of[chosen]
        for _ in range(steps):
            bag = np.stack([np.bincount(row, table[flat, d], chosen.size) for d in range(DIM)], axis=1) / bags.weight[chosen][:, None]
            z = bag @ direction + bias
            top = np.full(bags.docs, -np.inf)
            np.maximum.at(top, text, z)
            p = _sigmoid(z)
            wrong = (p - y[text]) * weight[text] * (z == top[text]) / bags.docs
            pull = np.bincount(flat, (wrong / bags.weight[chosen])[row], BUCKETS)
            hit = np.flatnonzero(pull)
            slope = pull[hit, None] * direction + 2e-6 * table[hit]
            turn, tilt = wrong @ bag + 1e-4 * direction, wrong.sum()
            slope *= 50  # embeddings see a small part of each window
            grown[hit] += slope**2
            drift += turn**2
            lean += tilt**2
            table[hit] -= rate * slope / np.sqrt(grown[hit])
            direction = direction - rate / 4 * turn / np.sqrt(drift)
            bias -= rate / 4 * tilt / np.sqrt(lean)
    value = table @ direction
    slope, level = _calibrated(bags.most(value), y, weight**0.75)
    return Model((value * slope).astype(np.float32), float(level))


def _calibrated(top: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level that fit the texts' largest means to their labels, by damped Newton steps on the logistic loss."""
    seen = np.isfinite(top)
    x, t, w = np.stack([top[seen], np.ones(seen.sum())], axis=1), y[seen], weight[seen]
    theta = np.array([1.0, 0.0])
    theta[1] = -np.average(top[seen], weights=w)
    prior = np.array([1.0, 0.0])
    for _ in range(60):
        p = _sigmoid(x @ theta)
        slope = x.T @ (w * (p - t)) + 0.02 * (theta - prior) * [1, 0]
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([0.02, 1e-6])
        step = np.linalg.solve(curve, slope)
        theta = theta - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def _score(model: Model, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return score


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, caps: tuple[int, int] = CAPS) -> Model:
    model = fit(*sample(docs, labels, label, held_out(modulus, remainder), caps))
    give_back()  # the driver has other stages to run
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, caps: tuple[int, int] = CAPS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = train(docs, labels, caps=caps)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), "text")
    return rows.mapInArrow(lean(_score(model, threshold)), "doc_id long, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, caps: tuple[int, int] = CAPS) -> DataFrame:
    """The rows, all their columns kept, whose score is below the threshold: ``toxicity``'s cases hold, so that without
    labels of both kinds the share of label 1 decides for all, and null and empty texts go by the softmax's bias."""
    model, at = train(docs, labels, caps=caps), docs.columns.index("text")

    def civil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(texts(batch.column(at))) < threshold))

    return docs.mapInArrow(lean(civil), docs.schema)
