"""SimHash near-duplicates found through Golay codes.

The 64 bits are cut into segments of 22, 21 and 21 bits. The binary Golay code [23, 12, 7] is perfect with radius 3: the
codewords met by decoding a segment and each of its 23 neighbours number one (if a codeword lies within 2 bits) or six,
and two segments that differ in at most 2 bits share one of them. With 4 differing bits the two best segments differ in
at most 2 bits together, so the pairs of codeword indices of two segments, 24 bits, find every link. Candidates are
verified by their exact distance inside the hash bucket of the key, where a key that many rows have is divided by its third
segment's codewords and by equal segments, and a bucket keeps no more than a spanning forest of its links, so that a large
group gives as many edges as members.

Defined cases: a null text has no words. No words give the fingerprint zero, which links like any other. Equal texts,
repeated rows and rows without doc_id have the fingerprint of their text; a component made of such rows only has a null
component_id (2^63 - 1 counts as no id). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, lean, lean_group, merged, mix, pack, texts
from .components import components

#: Generator polynomial of the binary Golay code, and how the fingerprint is cut: (shift, bits).
GOLAY, SEGMENTS = 0xC75, ((42, 22), (21, 21), (0, 21))
SEED, WORDS = 42, 4
#: Fingerprints that a bucket of keys holds, about; rows of one key that are compared directly.
BUCKET_KEYS, DIRECT = 1_500_000, 64


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits that are set in over half of the hashes of the text's shingles."""
    w = text.lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hash_of = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(grams)
    for i in range(0, n, 1 << 16):
        part = np.fromiter((hash_of(g, SEED) for g in grams[i : i + (1 << 16)]), np.uint64)
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t) for t in texts(batch.column(2))], pa.int64())], ["doc_id", "row", "fp"])


def _remainder(x: int) -> int:
    for bit in range(22, 10, -1):
        if x >> bit & 1:
            x ^= GOLAY << (bit - 11)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by bit position, and by remainder the errors to take away (a perfect code has one entry for each)."""
    bits = np.array([_remainder(1 << i) for i in range(23)], np.int64)
    errors = np.zeros(2048, np.int64)
    for size in (1, 2, 3):
        for where in combinations(range(23), size):
            errors[np.bitwise_xor.reduce(bits[list(where)])] = sum(1 << i for i in where)
    return bits, errors


BITS, ERRORS = _tables()


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords near each 23-bit word, and which of them are repeats: shapes (words, 24)."""
    rest = np.zeros(segment.size, np.int64)
    for i in range(23):
        rest ^= (segment >> i & 1) * BITS[i]
    near = segment[:, None] ^ np.append(0, 1 << np.arange(23))
    found = np.sort((near ^ ERRORS[rest[:, None] ^ np.append(0, BITS)]) >> 11, axis=1)
    again = np.zeros(found.shape, bool)
    again[:, 1:] = found[:, 1:] == found[:, :-1]
    return found, again


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints: (index into fp, key)."""
    u = fp.view(np.uint64)
    parts = [codewords(((u >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64)) for s, b in SEGMENTS]
    packed = []
    for found, again in parts:  # at most six each: repeats go to the back
        order = np.argsort(again, axis=1, kind="stable")[:, :6]
        packed.append((np.take_along_axis(found, order, 1), ~np.take_along_axis(again, order, 1)))
    who, key = [], []
    for n, (i, j) in enumerate(combinations(range(3), 2)):
        (a, ok), (b, fine) = packed[i], packed[j]
        both = ok[:, :, None] & fine[:, None, :]
        value = (a[:, :, None] << 12 | b[:, None, :]) + (n << 24)
        who.append(np.nonzero(both)[0])
        key.append(value[both])
    return np.concatenate(who), np.concatenate(key)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component."""
    label = np.arange(n)
    while a.size:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


NODE_DDL = "struct<least:long,fp:long>"
PACKED_DDL, EDGE_DDL = "bucket long, payload binary", f"a {NODE_DDL}, b {NODE_DDL}"
#: The least id of a fingerprint whose rows have none.
NONE = np.iinfo(np.int64).max


def _emit(buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part, least in zip(*(np.array_split(x, fps.size // 4000 + 1) for x in (fps, ids)), strict=True):
                who, key = keys(part)
                place = (mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(place[order]) != 0)) if order.size else order
                rows = [(int(place[s[0]]), pack(key[s].astype(np.uint32), part[who[s]], least[who[s]])) for s in np.split(order, at[1:]) if s.size]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])

    return emit


def divided(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Finer keys for the rows of keys that many have: nothing is lost, pairs that can't be links mostly part.

    A link's two nearest segments differ in at most two bits together and have a key. If its third differs in at most two,
    it shares a codeword of the third; if it differs in three or four, one of the other two is equal."""
    held = np.bincount(np.unique(key, return_inverse=True)[1])
    many = np.isin(key, np.unique(key)[held > DIRECT])
    out_key, out_fp = [key[~many].astype(np.int64) << 24], [fp[~many]]
    key, fp = key[many].astype(np.int64), fp[many]
    u = fp.view(np.uint64)
    for n, pair in enumerate(combinations(range(3), 2)):
        s = np.flatnonzero(key >> 24 == n)
        if not s.size:
            continue
        for kind, segment in enumerate(pair, 1):
            shift, bits = SEGMENTS[segment]
            out_key.append(key[s] << 24 | kind << 22 | ((u[s] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64))
            out_fp.append(fp[s])
        shift, bits = SEGMENTS[3 - sum(pair)]
        for part in np.array_split(s, s.size // 4000 + 1):
            found, again = codewords(((u[part] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64))
            row, _ = np.nonzero(~again)
            out_key.append(key[part][row] << 24 | 3 << 22 | found[~again])
            out_fp.append(fp[part][row])
    return np.concatenate(out_key), np.concatenate(out_fp)


def links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (fingerprint, least fingerprint of its component) of the links among rows with equal keys."""
    key, fp = divided(key, fp)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    all_fps, node = np.unique(fp, return_inverse=True)
    bits, label = fp.view(np.uint64), np.arange(all_fps.size)
    run_end = np.searchsorted(key, key, "right")
    live, step, a, b, held = np.arange(key.size), 1, [], [], 0
    while True:
        live = live[live + step < run_end[live]]
        if not live.size:
            break
        for part in np.array_split(live, live.size // 1_000_000 + 1):
            far = part + step
            near = (np.bitwise_count(bits[part] ^ bits[far]) <= distance) & (label[node[part]] != label[node[far]])
            if near.any():
                a.append(node[part[near]])
                b.append(node[far[near]])
                held += a[-1].size
        if held > 200_000:  # what is joined by now needs no further edges
            label = label[forest(all_fps.size, label[np.concatenate(a)], label[np.concatenate(b)])[label]] if a else label
            a, b, held = [], [], 0
        step += 1
    if a:
        label = forest(all_fps.size, label[np.concatenate(a)], label[np.concatenate(b)])[label]
    out = np.flatnonzero(label != np.arange(all_fps.size))
    return all_fps[out], all_fps[label[out]]


def _verify(distance: int):
    def verify(_, group):
        key, fp, least = merged(group.column("payload").to_pylist())
        known, at = np.unique(fp, return_index=True)
        node = lambda x: pa.StructArray.from_arrays([pa.array(least[at[np.searchsorted(known, x)]], pa.int64()), pa.array(x, pa.int64())], ["least", "fp"])
        return pa.Table.from_arrays([*map(node, links(key, fp, distance))], ["a", "b"])

    return verify


def _row() -> Column:
    """A row's name: two different texts of one id share it only if their hashes collide."""
    return F.struct(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("hash"))


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """Per row: doc_id, row (its name), fp (signed long), component (the least name of its fingerprints: their least id and the
    fingerprint) and component_id."""
    assert 0 <= distance <= 4, "three segments with two errors each find up to four differing bits"
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), "text").mapInArrow(lean(_fingerprints), "doc_id long, row struct<doc:long,hash:long>, fp long"))
    # a fingerprint's name, its least id with it, goes along with its keys: the least name of a component tells its least id,
    # and no join or group gathers a component or the links of its head
    names = rows.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(int(NONE))).alias("least"))
    buckets = max(8, -(-rows.count() * 84 // BUCKET_KEYS))
    found = names.select("fp", "least").mapInArrow(lean(_emit(buckets)), PACKED_DDL).groupBy("bucket").applyInArrow(lean_group(_verify(distance)), EDGE_DDL)
    group = components(found).select(F.col("node.fp").alias("fp"), "component")
    named = names.join(group, "fp", "left").select("fp", F.coalesce("component", F.struct("least", "fp")).alias("component"))
    return rows.join(named, "fp").select("doc_id", "row", "fp", "component", F.nullif(F.col("component.least"), F.lit(int(NONE))).alias("component_id"))


def keep_first(docs: DataFrame, distance: int = 4) -> DataFrame:
    """One row of each component, that of the least doc_id and then of the least hash of its text, with all its columns;
    of repeated rows one."""
    rows = near_duplicates(docs, distance)
    first = rows.filter((F.col("fp") == F.col("component.fp")) & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row").alias("row"))
    name = free_name(docs, "_row")
    kept = first.select(F.col("row").alias(name)).distinct()
    return docs.withColumn(name, _row()).join(kept, name, "left_semi").dropDuplicates([name]).select(*docs.columns)


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
