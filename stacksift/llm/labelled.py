"""Bounded samples of labelled rows, chosen by hash and not by order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


#: Characters of the longest text that a fit takes; longer ones are scored like all others.
LONGEST = 100_000


def sample(docs: DataFrame, labels: DataFrame, label: str, aside: Column, caps: tuple[int, int], longest: int = LONGEST) -> tuple[list[bytes], np.ndarray, float]:
    """Texts and labels of at most ``caps`` documents of label 0 and 1 that aren't held out, and the share of label 1.

    A document with several labels counts as 1 if one of them is, one with several texts gives the least of them. Rows
    without doc_id or label and texts of over ``longest`` characters aren't used, so that rows and bytes are bounded.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~aside).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    slot = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    parts = [known.filter((F.col("y") == y) & (slot < int(min(1.0, caps[y] / count[y]) * (1 << 30)))).limit(caps[y] + caps[y] // 8) for y in count]
    if not parts:
        return [], np.zeros(0, np.int64), 0.5
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fine = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= longest)
    found = fine.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # the caps bound it
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    return [r["text"].encode() for r in rows], np.array([r["y"] for r in rows], np.int64), count.get(1, 0) / sum(count.values())
