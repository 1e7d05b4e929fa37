"""Places and running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved


def placed(df: DataFrame, *order: Column | str, place: str = "place", total: str | None = None, running: str = "running") -> DataFrame:
    """``df`` with each row's place from 1 in ``order``, which must be total, and the running sum of ``total`` up to it.

    Rows are dealt by ranges of the order and counted within their range; the ranges' own counts, as many as there are
    partitions, are added up on the driver and sent back as offsets.
    """
    spark = df.sparkSession
    parts = saved(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    sums = [F.count("*").alias("n"), (F.sum(total) if total else F.lit(None).cast("long")).alias("s")]
    offsets, n, s = [], 0, 0
    for r in sorted(parts.groupBy("_part").agg(*sums).collect(), key=lambda r: r["_part"]):
        offsets.append((r["_part"], n, s))
        n, s = n + r["n"], s + (r["s"] or 0)
    kind = parts.schema[total].dataType.simpleString() if total else "long"
    kind = "long" if kind in ("int", "bigint", "long") else kind
    before = spark.createDataFrame(offsets, f"_part int, _n long, _s {kind}")
    within = Window.partitionBy("_part").orderBy(*order)
    out = parts.join(F.broadcast(before), "_part").withColumn(place, (F.row_number().over(within) + F.col("_n")).cast("long"))
    if total:
        out = out.withColumn(running, F.sum(total).over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_s"))
    return out.drop("_part", "_n", "_s")
