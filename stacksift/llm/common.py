"""Shared helpers: cutting lineage on shared storage, Arrow text views, packed exchanges."""

from __future__ import annotations

import ctypes
import struct
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

TEST_CHECKPOINT_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or TEST_CHECKPOINT_DIR


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor repeats no earlier step."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts(column: pa.Array) -> list[bytes]:
    """Each text as bytes; null is empty."""
    raw, at = utf8(column)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed payload, byte planes apart so that high zero bytes vanish."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [struct.pack("<2sQ", a.dtype.str[1:].encode(), a.size), np.ascontiguousarray(a.view(np.uint8).reshape(a.size, a.itemsize).T).tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, at)
        at += 10
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(size) if size else np.zeros(0, dtype))
        at += size * dtype.itemsize
    return out


def merged(payloads: list[bytes]) -> list[np.ndarray]:
    """Column-wise concatenation of payloads."""
    return [np.concatenate(x) for x in zip(*map(unpack, payloads), strict=True)]


def give_back() -> None:
    """Freed memory goes back to the system: a worker process outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """A function of batches that gives memory back when its task ends."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run


def lean_group(f: Callable) -> Callable:
    def run(key, group):
        out = f(key, group)
        give_back()
        return out

    return run


def lean_pair(f: Callable) -> Callable:
    def run(key, left, right):
        out = f(key, left, right)
        give_back()
        return out

    return run


MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of any substring of a buffer, from one prefix sum."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray, base: int):
        n = raw.size
        have = self.powers.get(base)
        if have is None or have[0].size < n + 1:
            size = max(n + 1, 1 << 16)
            up = np.full(size, base, np.uint64)
            up[0] = 1
            down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            down[0] = 1
            have = self.powers[base] = np.cumprod(up), np.cumprod(down)
        up, self.down = have
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end) for index arrays."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        """Hashes of every k bytes in a row."""
        n = self.sums.size - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)
