"""Structured Streaming: tailing logs, open intervals, windowed counts.

Logs are folders of JSON-line files; the checkpoint remembers which were read, at file
granularity (rotate a growing log into files), so a restarted query resumes where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship_code


def tail(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the rows of new files; lines that are no JSON are dropped."""
    rows = spark.readStream.schema(f"{schema}, _corrupt_record string").option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def _track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    started = state.get[0] if state.exists else None
    out = []
    for t, ev in sorted((t, ev) for f in frames for t, ev in zip(f["t"], f["ev"], strict=True)):
        if ev == "start":
            started = float(t)
        elif ev == "end" and started is not None:
            out.append((*key, "ended", max(0.0, float(t) - started)))
            started = None
    if started is None:
        state.remove() if state.exists else None
    else:
        state.update((started,))
        out.append((*key, "open", 0.0))
    yield pd.DataFrame(out, columns=["pid", "task", "kernel", "status", "seconds"])


def intervals(events: DataFrame) -> DataFrame:
    """pid, task, kernel, status, seconds: every end with its span, and what is open after each batch.

    The state is one number for each open interval and is removed when it ends.
    """
    ship_code(events.sparkSession)
    return events.select("pid", "task", "kernel", "t", "ev").groupBy("pid", "task", "kernel").applyInPandasWithState(
        _track, "pid long, task string, kernel string, status string, seconds double", "started double", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window with a watermark (not in the reference; for event tables)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def keep_latest(stream: DataFrame, path: str, order: list[str], n: int = 300):
    """A writer that holds the latest n rows of a stream as a table: each batch is merged with what is held (2 n rows at most meet)."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        top = batch.orderBy(*[F.desc(c) for c in order]).limit(n)
        if number and _exists(spark, f"{path}/batch={number - 1}"):
            top = top.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}")).orderBy(*[F.desc(c) for c in order]).limit(n)
        top.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is run again replaces itself

    return stream.writeStream.foreachBatch(merge)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
