"""Exact top-k inner products by multi-resolution segment statistics.

A vector's segments are summed up by mean and deviation. For integer vectors q and x and segments of length L,
|q - x|^2 >= sum L ((mean_q - mean_x)^2 + (dev_q - dev_x)^2), hence q.x <= sum L (mean_q mean_x + dev_q dev_x): a bound
that tightens as segments get shorter. Blocks of candidates meet blocks of queries; pairs are dropped against the
block's running k-th best score, coarse level first, and what survives gets its exact integer product.

Candidates lie in lanes by the hash of id and vector, so that a vector that is very common spreads out, and queries in
blocks by the hash of their id. Lanes and blocks form a grid: a task meets one lane with one block, both of a bounded size,
and what is shuffled grows with queries x lanes + rows x blocks. The k best of each lane are merged by a window per query.

Defined cases: a vector that is null or holds a null or a non-finite component takes no part, nor does a row without id.
An empty vector scores 0 with all. Vectors of unequal length meet as if padded with zeros. A query has as its own every
row of its id; if its id has several vectors the least is the query. Repeated candidate rows count one by one. Products
beyond a long are held at its ends. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pack, unpack

#: Vectors in a lane, queries in a block, and queries compared at once, about.
LANE, BLOCK, PART = 8192, 32_768, 512
LEVELS = (4, 16)
FOUND_DDL = "query_id long, vec_id long, score long"
LONG = np.iinfo(np.int64)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of doubles, padded with zeros to the longest."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    at = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.float64)
    size = np.diff(at)
    out = np.zeros((size.size, int(size.max(initial=0))))
    if flat.size:
        out[np.repeat(np.arange(size.size), size), np.arange(flat.size) - np.repeat(at[:-1] - at[0], size)] = flat
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(L) times mean and deviation, so that the bound is an inner product."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, max(x.shape[1], 1)) + 1).astype(int))
    parts = [x[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if not parts:
        return np.zeros((x.shape[0], 1))
    return np.concatenate([np.stack([p.mean(axis=1), p.std(axis=1)], axis=1) * np.sqrt(p.shape[1]) for p in parts], axis=1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of one query with rows."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.size, 1)
    if most < 2**53:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    sums = (sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in x)
    return np.array([max(LONG.min, min(LONG.max, s)) for s in sums], np.int64)


def search(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of this block for each query: higher score first, then smaller id."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    levels = [(statistics(q, s), statistics(x, s)) for s in LEVELS]
    out: tuple[list, list, list] = ([], [], [])
    coarse_q, coarse_x = levels[0]
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = np.nan_to_num(coarse_q @ coarse_x.T, nan=np.inf)
    for i in range(qid.size):
        live = np.flatnonzero(xid != qid[i])
        bound = bounds[i, live]
        if live.size > 4 * k:  # a first threshold from the most promising rows
            top = live[np.argpartition(-bound, 2 * k)[: 2 * k]]
            floor = np.partition(exact(q[i], x[top]), -k)[-k]
            slack = 1 + 1e-9 * (np.abs(float(floor)) + np.abs(bound))
            live = live[bound + slack >= floor]
            for a, b in levels[1:]:
                bound = np.nan_to_num(b[live] @ a[i], nan=np.inf)
                live = live[bound + 1 + 1e-9 * (np.abs(float(floor)) + np.abs(bound)) >= floor]
        score = exact(q[i], x[live])
        best = np.lexsort((xid[live], -score.astype(object) if score.size and score.min() == LONG.min else -score))[:k]
        out[0].append(np.full(best.size, qid[i]))
        out[1].append(xid[live[best]])
        out[2].append(score[best])
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def _query_blocks(lanes: int):
    """Packed queries of a block, once for each lane."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(2).to_numpy()
            for which in np.unique(block):
                own = batch.take(pa.array(np.flatnonzero(block == which)))
                for at in range(0, own.num_rows, PART):
                    part = own.slice(at, PART)
                    payload = pack(part.column(0).to_numpy(), matrix(part.column(1)).reshape(-1))
                    for low in range(0, lanes, 256):
                        n = min(256, lanes - low)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + n)), pa.array(np.full(n, which)), pa.array([payload] * n, pa.binary())], ["lane", "block", "payload"])

    return emit


def _meet(k: int):
    """One cell of the grid."""

    def meet(key, rows, queries):
        xid, x = rows.column("vec_id").to_numpy(), matrix(rows.column("v"))
        found = []
        for payload in queries.column("payload") if xid.size else ():
            qid, flat = unpack(payload.as_py())
            found.append(search(qid, flat.reshape(qid.size, -1), xid, x, k))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return meet


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``. Returns query_id, rank, vec_id, score."""
    v = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    size = vectors.agg(F.count("*").alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    lanes, blocks = max(8, -(-size["rows"] // LANE)), max(1, -(-size["queries"] // BLOCK))
    placed = rows.withColumn("lane", F.pmod(F.xxhash64("vec_id", "v"), F.lit(lanes))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    packed = queries.mapInArrow(_query_blocks(lanes), "lane long, block long, payload binary")
    found = placed.groupBy("lane", "block").cogroup(packed.groupBy("lane", "block")).applyInArrow(_meet(k), FOUND_DDL)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
