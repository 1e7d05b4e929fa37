"""Connected components and alias chains on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none."""
    return (spark.conf.get("spark.checkpoint.dir", None) or LOCAL_CHECKPOINTS).rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """A checkpoint on the storage that the session names."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(LOCAL_CHECKPOINTS)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from (a, b): each node takes the least label of its neighbours and jumps along labels until
    nothing changes."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = label.join(near, "a").select("a", F.least("label", "near").alias("label"))
        hop = new.select(F.col("a").alias("label"), F.col("label").alias("hop"))
        jumped = saved(new.join(hop, "label", "left").select("a", F.least("label", F.coalesce("hop", "label")).alias("label")))
        moved = jumped.join(label.withColumnRenamed("label", "old"), "a").filter("label <> old").limit(1).count()
        label = jumped
        if not moved:
            return label.select(F.col("a").alias("node"), F.col("label").alias("component"))


def resolved(aliases: DataFrame, live: DataFrame, hops: int = 8) -> DataFrame:
    """(old, new) after at most ``hops`` steps; only dead ids are followed. Steps are doubled and put together by the digits of
    ``hops``. A cycle ends after ``hops`` steps like any long chain."""

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        further = second.select(F.col("old").alias("new"), F.col("new").alias("next"))
        return saved(first.join(further, "new", "left").select("old", F.coalesce("next", "new").alias("new")))

    power = saved(aliases.join(live.select(F.col("id").alias("old")), "old", "left_anti").select("old", "new"))
    out = None
    while hops:
        if hops & 1:
            out = power if out is None else then(out, power)
        hops >>= 1
        power = then(power, power) if hops else power
    return out
