"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

A window of an item occurs in a document only if its rarest word does, so with containment 1 the necessary prefix of a
window is one token: words are ordered by how many places the corpus has for them. Documents are probed with the
prefix tokens; a probe keeps its place and the words around it. It meets the windows of its token at the offset that the
window fixes, within the document's bounds, and the whole window must agree word for word.

Windows are joined by content: equal windows of several items count once and name all their items.

Defined cases: a null text has no words, and neither have empty ones; such items have no window. Repeated rows get equal
results each. Rows without doc_id are treated like others. An item without id marks words but isn't counted or named.
An empty benchmark leaves every document clean; no documents give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, upper case being lowered before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a token table is broadcast; beyond, the planner chooses.
BROADCAST_ROWS = 200_000


def _key() -> Column:
    """A row's name: two different texts of one id share it only if their hashes collide."""
    return F.struct(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("hash"))


def words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, window): each run of ``size`` words, or all words of a shorter item."""
    w = items.select("item_id", words("text").alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")).distinct()


def small(df: DataFrame) -> DataFrame:
    """Broadcast what has been counted and is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per row: doc_id, key (the row's name: doc_id and a hash of the text), n_words, n_hit, n_items, items_sha256, contaminated."""
    of_items = cut(windows(items, size))
    distinct = of_items.select("window").distinct()
    vocabulary = distinct.select(F.explode("window").alias("word")).distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), "text")

    # how many places the corpus has for each word of the benchmark
    places = docs.select(F.explode(words("text")).alias("word")).join(small(cut(vocabulary)), "word").groupBy("word").agg(F.count("*").alias("places"))
    rarity = cut(vocabulary.join(places, "word", "left").select("word", F.coalesce("places", F.lit(0)).alias("places")))
    spread = distinct.select("window", F.posexplode("window").alias("at", "word")).join(small(rarity), "word")
    prefix = spread.groupBy("window").agg(F.min(F.struct("places", "word", "at")).alias("least")).filter("least.places > 0")
    probes = cut(prefix.select("window", F.col("least.word").alias("word"), F.col("least.at").alias("offset")))
    tokens = probes.select("word").distinct()

    # where the prefix tokens lie
    hits = docs.select("key", F.posexplode(words("text")).alias("at", "word")).join(small(tokens), "word", "left_semi")
    listed = hits.groupBy("key").agg(F.collect_set("at").alias("at"))
    beside = lambda p: F.struct(
        p.alias("at"),
        F.element_at("w", p + 1).alias("word"),
        F.least(p, F.lit(size - 1)).alias("before"),
        F.slice("w", F.greatest(p - size + 2, F.lit(1)), F.least(p, F.lit(size - 1)) + size).alias("around"),
    )
    probed = docs.join(listed, "key", "left").select("doc_id", "key", "at", words("text").alias("w"))
    probed = cut(probed.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.transform(F.coalesce("at", F.array().cast("array<int>")), beside).alias("near")))

    # windows at the place that the token's offset fixes
    near = probed.filter(F.size("near") > 0).select("key", F.inline("near")).distinct()
    met = near.join(small(probes), "word").filter((F.col("offset") <= F.col("before")) & (F.slice("around", F.col("before") - F.col("offset") + 1, F.size("window")) == F.col("window")))
    found = cut(met.select("key", (F.col("at") - F.col("offset")).alias("start"), F.size("window").alias("n"), "window"))
    marked = found.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct()
    counted = marked.groupBy("key").agg(F.count("*").alias("n_hit"))
    named = found.select("key", "window").distinct().join(of_items, "window").filter(F.col("item_id").isNotNull()).select("key", F.col("item_id").cast("string").alias("item")).distinct()
    listed_items = named.groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256"))
    result = probed.select("doc_id", "key", "n_words").join(counted, "key", "left").join(listed_items, "key", "left")
    return result.select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows without a hit, with all their columns and repeats. Null and empty texts stay, and all rows if there are no
    items; no rows give none."""
    name = free_name(docs, "_key")
    hit = contamination(docs, items, size).filter("contaminated").select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, _key()).join(hit, name, "left_anti").select(*docs.columns)
