"""Event streams in Structured Streaming: windows, deduplication and decaying state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import shared_folder

DECAY, PRUNE, TOP, MARGIN = 0.5, 0.02, 1.0, 0.3


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over event files, with a time that watermarks accept. The path is a folder, or a file in one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = stream.parquet(path) if folder else stream.option("pathGlobFilter", place.getName()).parquet(path.rpartition("/")[0])
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run over all that is there and give back the sink's rows, each once: a batch that is run again replaces what it wrote. In
    update mode the last batch of each of ``keys`` counts."""
    spark = stream.sparkSession
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/rows/batch={0 if mode == 'complete' else number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{top}/rows")
    if mode == "update":
        best = F.max(F.struct("batch", *[c for c in stream.columns if c not in keys])).alias("last")
        return rows.groupBy(*keys).agg(best).select(*keys, "last.*").select(*stream.columns)
    return rows.select(*stream.columns)


def tumbling(stream: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and type; a window's state goes when the watermark has passed it."""
    found = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("window.start").alias("since"), "event_type", "n", "total")


def sliding(stream: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("since"), "n")


def sessions(stream: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Sessions by user. In append mode the watermark ends them; complete mode, which a finite run uses, keeps all."""
    found = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("since"), "n")


def debounced(stream: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Of a user's events that follow each other within the gap only the last counts."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    found = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(last.alias("l"), F.count("*").alias("n"))
    return found.select("user_id", F.col("l.event_id").alias("event_id"), F.col("l.event_type").alias("event_type"), "n")


def deduplicated(stream: DataFrame, late: str = "40 days") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def day_ticks(stream: DataFrame, late: str = "40 days") -> DataFrame:
    """Each day once, when its first event comes."""
    days = stream.select(F.date_trunc("day", "ts").alias("day"))
    return days.withWatermark("day", late).dropDuplicatesWithinWatermark(["day"])


def daily_pages(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Pages by user and day; a day's state goes when the watermark has passed it."""
    by = stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day"))
    return by.agg(F.sum(F.floor("value").cast("long")).alias("pages")).select("user_id", F.to_date("window.start").alias("day"), "pages")


def rate_limited(stream: DataFrame, most: int = 2, size: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Events by user in fixed windows, and whether they are over the limit."""
    found = stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", size)).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("window.start").alias("hour"), "n", (F.col("n") > most).alias("limited"))


def sticky(stream: DataFrame) -> DataFrame:
    """Per user the type of the first event seen, which later batches never change. A few bytes a user are held for good."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        if not state.exists:
            state.update((rows["event_type"].iloc[0], 0))
        pack, seen = state.get
        state.update((pack, seen + len(rows)))
        yield pd.DataFrame({"user_id": [key[0]], "pack": [pack], "seen": [seen + len(rows)]})

    return stream.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(keep, "user_id long, pack string, seen long", "pack string, seen long", "update", GroupStateTimeout.NoTimeout)


def heard(stream: DataFrame, most: int = 5) -> DataFrame:
    """Per user the sum of positive steps of at most ``most`` between successive places; the last place is the state."""

    def add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        place, total = state.get if state.exists else (None, 0)
        places = rows["value"].floordiv(1).astype("int64")
        steps = places.diff()
        if place is not None:
            steps.iloc[0] = places.iloc[0] - place
        total += int(steps[(steps >= 1) & (steps <= most)].sum())
        state.update((int(places.iloc[-1]), total))
        yield pd.DataFrame({"user_id": [key[0]], "heard": [total]})

    return stream.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(add, "user_id long, heard long", "place long, total long", "update", GroupStateTimeout.NoTimeout)


def live_view(stream: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """Rows of a view derived from all that has come, made anew after each batch, and how often it changed: a view that stays
    the same isn't written again."""
    spark = stream.sparkSession
    top, seen = f"{shared_folder(spark)}/view-{uuid.uuid4().hex}", []

    def refresh(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/base/batch={number}")
        view = derive(spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{top}/base").drop("batch"))
        mark = tuple(view.agg(F.count("*"), F.sum(F.xxhash64(*view.columns).cast("decimal(20,0)"))).first())
        if not seen or seen[-1][0] != mark:
            view.write.mode("overwrite").parquet(f"{top}/view-{number}")
            seen.append((mark, number))

    run = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{top}/view-{seen[-1][1]}"), len(seen)


def newest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The table in the folder of the greatest name that has been written to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    if not whole:
        raise FileNotFoundError(f"no finished snapshot under {root}")
    return spark.read.parquet(whole[-1])


def refreshed(stream: DataFrame, root: str, key: str) -> DataFrame:
    """Events with what the newest snapshot says of their key; each batch looks for the snapshot anew."""
    spark = stream.sparkSession
    top = f"{shared_folder(spark)}/refreshed-{uuid.uuid4().hex}"

    def look(batch: DataFrame, number: int) -> None:
        batch.join(newest_snapshot(spark, root), key, "left").write.mode("overwrite").parquet(f"{top}/rows/batch={number}")

    run = stream.writeStream.foreachBatch(look).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{top}/rows").drop("batch")


def decide(totals: dict[str, float], frame: dict[str, float]) -> tuple[dict[str, float], str | None]:
    """Scores halve, the frame's are added, small ones go; a leader that is clear enough is told."""
    new = {k: v * DECAY for k, v in totals.items()}
    for k, v in frame.items():
        new[k] = new.get(k, 0.0) + v
    new = {k: v for k, v in new.items() if v >= PRUNE}
    order = sorted(new.items(), key=lambda x: (-x[1], x[0]))
    second = order[1][1] if len(order) > 1 else 0.0
    return new, order[0][0] if order and order[0][1] >= TOP and order[0][1] - second >= MARGIN else None


def decaying(stream: DataFrame) -> DataFrame:
    """Per user: the event type that leads a decaying score after each batch."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, values = state.get if state.exists else ([], [])
        totals, leader = dict(zip(names, values, strict=True)), None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_type"])
        for row in rows.itertuples():
            totals, leader = decide(totals, {row.event_type: min(1.0, row.value / 50)})
        state.update((list(totals), list(totals.values())))
        yield pd.DataFrame({"user_id": [key[0]], "leader": [leader], "held": [len(totals)]})

    return stream.select("user_id", "ts", "event_type", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, leader string, held long", "names array<string>, values array<double>", "append", GroupStateTimeout.NoTimeout)
