"""Whitening of embeddings by hierarchical merging of singular value decompositions.

1. Entries c become whole numbers floor(64 c) + 1000000. Each partition keeps, block after block, a sketch: rows,
   mean, all singular values and right vectors of its centred rows, and the exact sums of the dimensions.
2. Two sketches merge by decomposing their scaled vectors once more, with one more row for the
   difference of the means. No dimension is dropped, so the merged sketch has the covariance of all rows.
   Partitions merge FAN at a time in tasks, level by level; a sketch is dimensions x dimensions, whatever the rows.
3. Vectors are centred by the exact sums, projected and scaled, with the model (one sketch) in the closure.
4. The whitened vectors go through the same merge once, which gives the greatest difference of their covariance from the identity.

Nulls and edges: vectors that are null, empty or hold null or non-finite entries take no part; neither do those of
another length than the most frequent one (of equally frequent lengths the least). Rows with a null or
repeated vec_id count each by itself. Entries whose number does not fit 62 bits count as the nearest that does. Directions
without variance (by double precision; all, where there is one vector) have whitened null and explained 0 (null
where nothing varies), and identity_error is over the others (null without any). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

SCALE, BASE = 64, 1_000_000
#: Rows that are decomposed at once (or twice the dimensions, if that is more).
BLOCK = 4096
#: Sketches that one task merges.
FAN = 16
SKETCH = "part long, n long, mean array<double>, s array<double>, vt array<double>, sums array<string>"


class Sketch(NamedTuple):
    n: int
    mean: np.ndarray
    s: np.ndarray
    vt: np.ndarray
    sums: list[int]


class Model(NamedTuple):
    """Exact sums above BASE per dimension, components as rows, standard deviation of each (0: none), share of the variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    deviation: np.ndarray
    explained: np.ndarray | None


# ------------------------------------------------------------------ sketches


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s, vt


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c), as whole numbers of at most 62 bits."""
    return np.clip(np.floor(SCALE * vectors), -(2.0**62), 2.0**62).astype(np.int64)


def exact_sums(x: np.ndarray) -> list[int]:
    if not len(x) or float(np.abs(x).max()) * len(x) < 2.0**62:
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in double precision: the whole part of the mean goes first, exactly."""
    near = np.array([t // n for t in sums], np.int64)
    return (x - near).astype(np.float64) - np.array([t % n / n for t in sums])


def sketch(x: np.ndarray) -> Sketch:
    """The sketch of some rows of whole numbers, or of doubles."""
    if x.dtype == np.int64:
        sums = exact_sums(x)
        return Sketch(len(x), np.array([t / len(x) for t in sums]), *decomposed(centred(x, len(x), sums)), sums)
    mean = x.mean(0)
    return Sketch(len(x), mean, *decomposed(x - mean), [])


def merged(a: Sketch, b: Sketch) -> Sketch:
    n = a.n + b.n
    between = np.sqrt(a.n / n * b.n) * (a.mean - b.mean)
    s, vt = decomposed(np.vstack([a.s[:, None] * a.vt, b.s[:, None] * b.vt, between]))
    return Sketch(n, a.mean + (b.mean - a.mean) * (b.n / n), s, vt, [p + q for p, q in zip(a.sums, b.sums, strict=True)])


def _row(part: int, k: Sketch) -> pa.RecordBatch:
    lists = [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in (k.mean, k.s, k.vt)]
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k.n]), *lists, pa.array([[str(t) for t in k.sums]], pa.list_(pa.string()))], ["part", "n", "mean", "s", "vt", "sums"])


def _sketches(table: pa.Table) -> Iterator[Sketch]:
    for r in table.sort_by("part").to_pylist():
        yield Sketch(r["n"], np.array(r["mean"]), np.array(r["s"]), np.array(r["vt"]).reshape(len(r["s"]), -1), [int(t) for t in r["sums"]])


def _rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at least `size` rows (but the last), each with its vectors as doubles."""
    held, rows = [], 0

    def out() -> tuple[pa.RecordBatch, np.ndarray]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return batch, flat.reshape(batch.num_rows, -1)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= size:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


def _sketched(rows: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One sketch of all rows of a partition."""
    total = None
    for x in rows:
        total = sketch(x) if total is None else merged(total, sketch(x))
    if total is not None:
        yield _row(TaskContext.get().partitionId() if TaskContext.get() else 0, total)


def merged_sketches(parts: DataFrame) -> Sketch | None:
    """The sketch of all rows, from one of each partition (None without rows)."""
    parts = materialize(parts)
    top = parts.agg(F.max("part")).collect()[0][0]
    if top is None:
        return None

    def step(table: pa.Table) -> pa.Table:
        total = None
        for k in _sketches(table):
            total = k if total is None else merged(total, k)
        return pa.Table.from_batches([_row(table["part"][0].as_py() // FAN, total)])

    while top > 0:
        parts, top = parts.groupBy(F.expr(f"part div {FAN}")).applyInArrow(step, SKETCH), top // FAN
    return next(_sketches(parts.toArrow()))


# ------------------------------------------------------------------ model


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, vector: vectors whose entries are all finite numbers, of the most frequent length."""
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where("size(vector) > 0").where(fine)
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("vector") == (size[0]["size"] if size else 0))


def fit(rows: DataFrame, components: int) -> Model | None:
    """The first components of the rows' covariance (None without rows)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sketched(whole(v) for _, v in _rows(batches, BLOCK))

    k = merged_sketches(arrow_map(rows, step, SKETCH))
    if k is None:
        return None
    count, d = min(components, len(k.mean)), len(k.mean)
    axes, s = np.zeros((count, d)), np.zeros(count)
    kept = min(count, len(k.s))
    axes[:kept], s[:kept] = k.vt[:kept], k.s[:kept]
    s[s <= k.s[0] * 4 * max(d, 16) * np.finfo(float).eps] = 0
    share = (k.s / k.s[0]) ** 2 if k.s[0] > 0 else None
    return Model(k.n, k.sums, axes, s / np.sqrt(k.n), None if share is None else np.where(s > 0, (s / k.s[0]) ** 2, 0) / share.sum())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n x - sums)^2 of each row, exactly."""
    if float(np.abs(x).max(initial=0)) * n + max(map(abs, sums)) >= 2.0**62:
        return ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1).tolist()
    y = np.abs(x * n - np.array(sums, np.int64))
    a, b, c = y >> 42, y >> 21 & 0x1FFFFF, y & 0x1FFFFF  # products of 42 bits: sums over up to a million dimensions fit
    dot = lambda p, q: np.einsum("ij,ij->i", p, q).tolist()
    terms = zip(dot(a, a), dot(a, b), dot(a, c), dot(b, b), dot(b, c), dot(c, c), strict=True)
    return [(aa << 84) + (ab << 64) + (2 * ac + bb << 42) + (bc << 22) + cc for aa, ab, ac, bb, bc, cc in terms]


def project(x: np.ndarray, model: Model) -> np.ndarray:
    """Whitened rows over the components that have variance."""
    some = model.deviation > 0
    return centred(x, model.n, model.sums) @ (model.axes[some] / model.deviation[some, None]).T


def identity_error(rows: DataFrame, model: Model) -> float | None:
    """The greatest entry of the whitened rows' covariance minus the identity."""
    if not (model.deviation > 0).any():
        return None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sketched(project(whole(v), model) for _, v in _rows(batches, BLOCK))

    k = merged_sketches(arrow_map(rows, step, SKETCH))
    return float(np.abs((k.vt.T * (k.s**2 / k.n)) @ k.vt - np.eye(len(k.mean))).max())


WHITENED = "vec_id long, n long, deviation string, whitened array<double>, explained array<double>, identity_error double"


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, n, deviation (decimal), whitened and explained (one entry a component), identity_error of each vector that takes part."""
    rows = taking_part(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], WHITENED.replace("deviation string", "deviation decimal(38,0)"))
    error = identity_error(rows, model)
    some = model.deviation > 0

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v in _rows(batches, BLOCK):
            x, n = whole(v), batch.num_rows
            flat = np.zeros((n, len(some)))
            flat[:, some] = project(x, model)
            lists = lambda values, mask=None, n=n: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(some)), pa.array(values.ravel(), mask=mask))
            none = np.broadcast_to(~some, flat.shape).ravel()
            share = lists(np.broadcast_to(0.0 if model.explained is None else model.explained, flat.shape), np.full(flat.size, model.explained is None))
            dev = pa.array([str(t) for t in deviations(x, model.n, model.sums)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.full(n, model.n)), dev, lists(flat, none), share, pa.array([error] * n, pa.float64())], ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return arrow_map(rows, step, WHITENED).withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def by_component(whitened: DataFrame) -> DataFrame:
    """One row for each vector and component, numbered from 1; a deviation beyond a long is null."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = whitened.select("vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "identity_error", pairs)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
