"""Works of several languages as one: clusters that hold at most one work of a language.

Clusters are rows (node, language, cluster); proposals are rows (source, target) of clusters. Joins are on keys throughout,
a round reads the clusters once and writes them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, saved

#: Rounds of series propagation, members of a group of authors.
ROUNDS, GROUP = 3, 8


def applied(clusters: DataFrame, proposals: DataFrame) -> DataFrame:
    """Clusters after one round: by target, sources that claim one language with another source or with the target refuse,
    the others join it. A source with several targets takes the least; one that is itself a target waits."""
    wish = proposals.filter("source <> target").groupBy("source").agg(F.min("target").alias("target"))
    wish = saved(wish.join(wish.select(F.col("target").alias("source")).distinct(), "source", "left_anti"))
    languages = clusters.select("cluster", "language").distinct()
    claims = wish.join(languages.withColumnRenamed("cluster", "source"), "source")
    twice = claims.groupBy("target", "language").agg(F.count("*").alias("n")).filter("n > 1").select("target", "language")
    held = wish.select("target").distinct().join(languages.withColumnRenamed("cluster", "target"), "target")
    refused = claims.join(twice.unionByName(held).distinct(), ["target", "language"], "left_semi").select("source").distinct()
    moved = wish.join(refused, "source", "left_anti").withColumnRenamed("source", "cluster")
    return saved(clusters.join(moved, "cluster", "left").select("node", "language", F.coalesce("target", "cluster").alias("cluster")))


def merged(clusters: DataFrame, proposals: DataFrame, rounds: int = 8) -> DataFrame:
    """Rounds of ``applied`` until nothing moves: proposals name nodes' first clusters and follow them."""
    for _ in range(rounds):
        now = clusters.select("node", "cluster")
        follow = proposals.join(now.select(F.col("node").alias("source"), F.col("cluster").alias("s")), "source").join(now.select(F.col("node").alias("target"), F.col("cluster").alias("t")), "target")
        new = applied(clusters, follow.select(F.col("s").alias("source"), F.col("t").alias("target")).distinct())
        still = new.join(clusters.select("node", F.col("cluster").alias("old")), "node").filter("cluster <> old").isEmpty()
        clusters = new
        if still:
            break
    return clusters


def by_item(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """Proposals among clusters with one agreed item (node, item) whose languages are disjoint: all join the least. A cluster
    whose members disagree has none."""
    agreed = clusters.join(items.filter("item IS NOT NULL"), "node").groupBy("cluster").agg(F.min("item").alias("item"), F.max("item").alias("other")).filter("item = other").drop("other")
    spoken = agreed.join(clusters, "cluster").select("item", "cluster", "language").distinct()
    fits = spoken.groupBy("item").agg(F.count("*").alias("n"), F.count_distinct("language").alias("d"), F.min("cluster").alias("target")).filter("n = d")
    return agreed.join(fits, "item").filter("cluster <> target").select(F.col("cluster").alias("source"), "target")


def only_target(found: DataFrame) -> DataFrame:
    """Of (source, target) pairs those of sources with one target."""
    one = found.filter("source <> target").groupBy("source").agg(F.min("target").alias("target"), F.max("target").alias("other"))
    return one.filter("target = other").select("source", "target")


def volumes(nodes: DataFrame) -> DataFrame:
    """Numbered volumes by language, series and author; positions that two works hold don't count."""
    key = ["language", "series", "author", "position"]
    return nodes.filter("series <> '' AND position > 0").groupBy(*key).agg(F.min("node").alias("node"), F.count("*").alias("n")).filter("n = 1").drop("n")


def aligned(volumes_: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a_language, a_series, b_language, b_series, author): series of one author in two languages that share a cluster at one
    position and none at different ones, each the other's only partner in its language."""
    placed = volumes_.join(clusters.select("node", "cluster"), "node")
    side = lambda p: placed.select("author", "cluster", F.col("language").alias(f"{p}_language"), F.col("series").alias(f"{p}_series"), F.col("position").alias(f"{p}_position"))
    met = side("a").join(side("b"), ["author", "cluster"]).filter("a_language < b_language")
    agree = (F.col("a_position") == F.col("b_position")).cast("int")
    key = ["a_language", "a_series", "b_language", "b_series", "author"]
    fit = met.groupBy(*key).agg(F.sum(agree).alias("agree"), F.sum(1 - agree).alias("apart")).filter("agree > 0 AND apart = 0")
    left = Window.partitionBy("author", "a_language", "a_series", "b_language")
    right = Window.partitionBy("author", "b_language", "b_series", "a_language")
    return fit.withColumn("l", F.count("*").over(left)).withColumn("r", F.count("*").over(right)).filter("l = 1 AND r = 1").select(*key)


def propagated(nodes: DataFrame, clusters: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Aligned series join their other volumes position by position, while that aligns more, ``rounds`` times at most.
    nodes: (node, language, series, author, position)."""
    books = saved(volumes(nodes))
    for _ in range(rounds):
        pairs = aligned(books, clusters)
        side = lambda p: books.select("author", "position", F.col("language").alias(f"{p}_language"), F.col("series").alias(f"{p}_series"), F.col("node").alias(p))
        met = pairs.join(side("a"), ["author", "a_language", "a_series"]).join(side("b"), ["author", "position", "b_language", "b_series"]).select("a", "b")
        now = clusters.select("node", "cluster")
        apart = met.join(now.select(F.col("node").alias("a"), F.col("cluster").alias("source")), "a").join(now.select(F.col("node").alias("b"), F.col("cluster").alias("target")), "b").filter("source <> target")
        new = applied(clusters, apart.select("source", "target").distinct())
        still = new.join(clusters.select("node", F.col("cluster").alias("old")), "node").filter("cluster <> old").isEmpty()
        clusters = new
        if still:
            break
    return clusters


def author_aliases(credits: DataFrame, catalogue: Column, most: int = GROUP) -> DataFrame:
    """(number, canonical) from (unified, number, name): numbers with one name key in one unified work are one person, groups
    over ``most`` are kept apart; the least number of the catalogue stands for a group, else the least."""
    named = credits.filter("name <> ''").select("unified", "name", "number").distinct()
    first = named.groupBy("unified", "name").agg(F.min("number").alias("first"))
    group = components(named.join(first, ["unified", "name"]).select(F.col("number").alias("a"), F.col("first").alias("b")).distinct())
    rows = group.withColumnRenamed("node", "number").withColumn("own", F.when(catalogue, F.col("number")))
    heads = rows.groupBy("component").agg(F.count("*").alias("n"), F.coalesce(F.min("own"), F.min("number")).alias("canonical")).filter(F.col("n") <= most)
    return rows.join(heads, "component").filter("number <> canonical").select("number", "canonical")
