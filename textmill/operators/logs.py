"""Append-only logs and stores: last write wins, tombstones, event pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dedup import last_per_key


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return last_per_key(df, keys, order)


def without_erased(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows whose key no tombstone names."""
    return df.join(tombstones.select(key).distinct(), key, "left_anti")


def compact(df: DataFrame, tombstones: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state of a store: the last row of every key that is not erased."""
    return latest(without_erased(df, tombstones, keys[0]), keys, order)


def paired_seconds(events: DataFrame, by: list[str], kind: str, ts: str, order: list[str], start: str, end: str) -> DataFrame:
    """by, seconds of every end that directly follows its start (the latest start counts; negative spans are 0)."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = events.where(F.col(kind).isin(start, end)).select(*by, F.col(kind).alias("_k"), F.col(ts).alias("_t"), F.lag(kind).over(w).alias("_k0"), F.lag(ts).over(w).alias("_t0"))
    span = F.unix_micros("_t") - F.unix_micros("_t0")
    return rows.where((F.col("_k") == end) & (F.col("_k0") == start)).select(*by, (F.greatest(span, F.lit(0)) / 1e6).alias("seconds"))


def still_open(events: DataFrame, by: list[str], kind: str, order: list[str], start: str, end: str) -> DataFrame:
    """Groups whose last event is a start."""
    rows = events.where(F.col(kind).isin(start, end))
    last = rows.groupBy(*by).agg(F.max_by(kind, F.struct(*order)).alias("_k"))
    return last.where(F.col("_k") == start).select(*by)


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return df.join(done.select(key).distinct(), key, "left_anti")
