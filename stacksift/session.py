"""Sessions, and the package on the executors."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC."""
    build = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions))
    build = build.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        build = build.config(key, value)
    return build.getOrCreate()


@functools.cache
def _archive() -> str:
    top = tempfile.mkdtemp(prefix="stacksift-")
    shutil.copytree(ROOT / "stacksift", f"{top}/in/stacksift", ignore=shutil.ignore_patterns("__pycache__"))
    for extra in ROOT.glob("corpus_pipeline.py"):
        shutil.copy(extra, f"{top}/in")
    return shutil.make_archive(f"{top}/stacksift", "zip", f"{top}/in")


_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless PYTHONPATH has it there."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or context.applicationId in _sent:
        return
    context.addPyFile(_archive())
    _sent.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


#: Beginnings of the names of intermediate tables in the shared folder.
INTERMEDIATE = ("cut-", "stream-", "view-", "refreshed-", "snapshots-", "works-", "members-", "state-", "requests-")


def clear_intermediate(spark: SparkSession, hours: float = 24.0, folder: str | None = None) -> int:
    """Delete intermediate tables older than ``hours`` from a folder, the session's shared one by default, and say how many. Lazy results read them
    until they are written out, so a job calls this after its last write, or a later one with an age that no job reaches."""
    root = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return 0
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    before, gone = (time.time() - hours * 3600) * 1000, 0
    for status in fs.listStatus(path) if fs.exists(path) else ():
        if status.getPath().getName().startswith(INTERMEDIATE) and status.getModificationTime() <= before:
            gone += bool(fs.delete(status.getPath(), True))
    return gone
