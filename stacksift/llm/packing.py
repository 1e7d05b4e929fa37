"""Best-fit decreasing packing of tokenised documents.

Pieces of one length are interchangeable, so the packing is decided on the histogram of lengths: at most ``capacity``
rows whatever the corpus. Lengths go from long to short; a segment tree over the remaining capacities gives the
tightest open bin in logarithmic time, and since a bin stays the tightest until the length no longer fits, equal pieces
are placed in runs: exactly the bins that best-fit decreasing opens piece by piece. The plan's rows name a length, a
range of ordinals, the first bin, pieces a bin, and the offset; the number of rows is bounded by the capacity alone.
Ordinals come from two levels, each piece's place within its task and length and the sum of earlier tasks' counts, so no
task holds all pieces of a length.

Ids are those of the byte-level BPE file, its added tokens included. They are computed with its rank file, which gives the
same ids at several times the speed; the tests hold both against each other.

Defined cases: a null or empty text has the final id alone. Repeated rows and rows without doc_id are packed like
others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long"
_encoders: dict[str, object] = {}


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _added(path: str) -> dict[str, int]:
    """The added tokens of the vocabulary whose rank file this is."""
    whole = f"{path.removesuffix('.tiktoken')}.json"
    if not os.path.exists(whole):
        return {}
    with open(whole, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    odd = [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    assert not odd, f"added tokens that take in their surroundings: {odd}"
    return {t["content"]: t["id"] for t in found}


def _encoding(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=_added(path))
    return _encoders[path]


def full_encoder(path: str):
    """Ids of texts as ``tokenizers`` gives them: texts are split at the added tokens, which have their own ids."""
    return functools.partial(_encoding(path).encode, allowed_special="all")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter when there are several."""
    head = n % capacity or capacity
    return [(0, min(head, n))] + [(s, capacity) for s in range(head, n, capacity)]


def _pieces(path: str, final: int, capacity: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, chunk = full_encoder(path), np.zeros(capacity + 1, np.int64).tolist(), TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.array([*encode(text.decode()), final], "<u4")
                for p, (start, length) in enumerate(cuts(ids.size, capacity)):
                    out.append((doc, p, start, length, zlib.crc32(ids[start : start + length].tobytes()), chunk, seen[length]))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"])

    return emit


class Open:
    """Open bins by remaining capacity, with a segment tree for the tightest that holds a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, r: int, value: bool) -> None:
        i = r + self.size
        self.any[i] = value
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def add(self, r: int, first: int, count: int) -> None:
        if r and count:
            self.bins.setdefault(r, []).append((first, count))
            self._mark(r, True)

    def take(self, r: int) -> tuple[int, int]:
        held = self.bins[r].pop()
        if not self.bins[r]:
            self._mark(r, False)
        return held

    def tightest(self, length: int) -> int:
        """Least remaining capacity of at least ``length``, 0 if no bin is open for it."""
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return 0


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Plan rows (length, first ordinal, first bin, pieces a bin, offset), by length and ordinal; and the bins used."""
    plan, bins, open_ = [], 0, Open(capacity)
    for length in sorted(histogram, reverse=True):
        left, at = histogram[length], 0
        while left:
            room = open_.tightest(length)
            if room:
                first, count = open_.take(room)
                each = room // length
            else:
                room, each = capacity, capacity // length
                first, count = bins, -(-left // each)
                bins += count
            full = min(count, left // each)
            if full:
                plan.append((length, at, first, each, capacity - room))
                open_.add(room - each * length, first, full)
                at, left = at + full * each, left - full * each
            if left and full < count:  # fewer pieces than this bin could take
                plan.append((length, at, first + full, each, capacity - room))
                open_.add(room - left * length, first + full, 1)
                full, left = full + 1, 0
            open_.add(room, first + full, count - full)
    return np.array(plan, np.int64).reshape(-1, 5), bins


def _place(plan: np.ndarray):
    span = np.int64(1) << 40  # ordinals of one length
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    marks = plan[:, 0] * span + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(c).to_numpy() for c in ("length", "ordinal"))
            row = plan[np.searchsorted(marks, length * span + nth, "right") - 1]
            i = nth - row[:, 1]
            put = [pa.array(row[:, 2] + i // row[:, 3], pa.int64()), pa.array(row[:, 4] + i % row[:, 3] * length, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *put], [*names, "sequence_id", "offset"])

    return place


def pack_sequences(docs: DataFrame, capacity: int = 1024, final: int = 2, ranks: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(docs.mapInArrow(lean(_pieces(ranks or rank_file(), final, capacity)), PIECES))
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan, _ = best_fit(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = pieces.join(base, ["chunk", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("ordinal"))
    return placed.mapInArrow(_place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
