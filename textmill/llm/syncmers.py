"""Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer if the least of its s-mers (by hash) stands at its
first or last place. Whether a k-mer is chosen depends on its own bytes alone, so an edit
changes only the anchors that it touches, and equal passages have equal anchors at equal
distances. The fingerprint keeps every anchor whose hash is below 1/SHARE of all hashes, and
at least the LEAST anchors of the least hashes (all, if fewer), each with its first position, as
8 hex digits of hash and 8 of position. So it grows with the text.

Likeness of two fingerprints: below the smaller of their limits (the hash up to which each
is complete) both have all anchors of their texts. Of the anchors there in either, those in
both whose positions grow together (the longest such chain) count as matched; with j their
share, the likeness is 2j / (1 + j), which estimates the Dice coefficient of the texts'
anchors. Equal fingerprints have likeness 1.

Nulls and edges: a null text is empty; empty texts have the empty fingerprint, like each
other and unlike all else; a text shorter than k bytes is its own one anchor; null doc_ids
sort before all others; rows that repeat a doc_id, or have none, are ordered by the text's hash;
a table of one row is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, materialize, range_hash, text_array

K = 20
S = 8
LEAST, SHARE = 64, 16
#: Documents that are neighbours and are worked through together, about.
RUN = 4000
#: Runs at most; the keys of their first documents are held by every task.
MAX_RUNS = 20_000


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` values in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def syncmers(data: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers of the bytes."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < k:
        return np.zeros(1, np.int64), range_hash(data, np.array([0]), np.array([n]))
    at = np.arange(n - s + 1)
    inner = range_hash(data, at, at + s)
    width = k - s + 1
    least = _least_of(inner, width)
    m = n - k + 1
    chosen = np.flatnonzero((inner[:m] == least) | (inner[width - 1 : width - 1 + m] == least))
    return chosen, range_hash(data, chosen, chosen + k)


def sketch(h: np.ndarray, pos: np.ndarray, least: int = LEAST, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 32 bits in order, first positions) of a text's anchors that its fingerprint keeps."""
    h = h >> np.uint64(32)
    if len(h) > 4 * least:  # the kept ones lie below the limit, or among the least
        low = h < np.uint64((1 << 32) // share)
        if len(np.unique(h[low])) >= least:
            h, pos = h[low], pos[low]
    values, first = np.unique(h, return_index=True)
    keep = max(least, int(np.searchsorted(values, (1 << 32) // share)))
    return values[:keep], pos[first[:keep]]


def written(values: np.ndarray, pos: np.ndarray) -> str:
    """8 hex digits of hash and 8 of position for every anchor."""
    return np.stack([values, pos.astype(np.uint64)], 1).astype(">u4").tobytes().hex()


def fingerprint(text: bytes, k: int = K, s: int = S) -> str:
    pos, h = syncmers(np.frombuffer(text, np.uint8), k, s)
    return written(*sketch(h, pos))


def anchors(mark: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a fingerprint."""
    table = np.frombuffer(bytes.fromhex(mark), ">u4").reshape(-1, 2).astype(np.int64)
    return table[:, 0], table[:, 1]


def likeness(a: str, b: str, least: int = LEAST, share: int = SHARE) -> float:
    if a == b:
        return 1.0
    (x, x_at), (y, y_at) = anchors(a), anchors(b)
    # with fewer than `least` anchors a fingerprint has all of its text's
    limit = min(max(int(v[-1]) + 1, (1 << 32) // share) if len(v) >= least else 1 << 32 for v in (x, y))
    i, j = np.searchsorted(x, limit), np.searchsorted(y, limit)
    _, p, q = np.intersect1d(x[:i], y[:j], assume_unique=True, return_indices=True)
    order = np.lexsort((y_at[q], x_at[p]))
    chain: list[int] = []
    for at in y_at[q][order].tolist():
        k = bisect_left(chain, at)
        chain[k : k + 1] = [at]
    share_ = len(chain) / (i + j - len(p)) if i + j else 0.0
    return 2 * share_ / (1 + share_)


def _singles(docs: DataFrame) -> DataFrame:
    """doc_id, text, ord, tk, copies: rows that repeat a doc_id and a text are one."""
    again = materialize(docs.groupBy("ord", "tk").agg(F.count(F.lit(1)).cast("int").alias("copies")).where("copies > 1"))
    if again.isEmpty():
        return docs.withColumn("copies", F.lit(1))
    once = docs.join(again, ["ord", "tk"], "left_anti").withColumn("copies", F.lit(1))
    more = docs.join(again, ["ord", "tk"], "left_semi").groupBy("ord", "tk").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).cast("int").alias("copies"))
    return once.unionByName(more)


def _runs(docs: DataFrame, rows: int) -> DataFrame:
    """docs in runs of neighbours: run, ahead (the first document of the next run comes along, marked).

    Runs are ranges of (ord, tk) with bounds that are rows, so neither null doc_ids nor one repeated doc_id make a run by
    themselves. The bounds come from the keys alone: the texts are moved once.
    """
    n = max(1, min(MAX_RUNS, rows // RUN))
    keys = docs.select("ord", "tk").repartitionByRange(n, "ord", "tk").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("ord", "tk")).alias("k"))
    table = keys.select("k.ord", "k.tk").toArrow().sort_by([("ord", "ascending"), ("tk", "ascending")])  # at most MAX_RUNS rows
    ords, tks = table["ord"].to_numpy(), table["tk"].to_numpy()

    @F.pandas_udf("int")
    def run_of(ord_: pd.Series, tk_: pd.Series) -> pd.Series:
        o, t = ord_.to_numpy(), tk_.to_numpy()
        low, high = np.zeros(len(o), np.int64), np.full(len(o), len(ords))
        for _ in range(len(ords).bit_length()):  # the last bound that is not above the row
            mid = np.minimum((low + high) // 2, len(ords) - 1)
            under = (ords[mid] < o) | (ords[mid] == o) & (tks[mid] <= t)
            low, high = np.where(under & (low < high), mid + 1, low), np.where(under, high, np.minimum(mid, high))
        return pd.Series(low - 1, dtype="int32")

    placed = docs.withColumn("run", run_of("ord", "tk")).withColumn("ahead", F.lit(0))
    m = len(ords)
    ahead = docs.sparkSession.createDataFrame(pa.table({"run": pa.array(range(m), pa.int32()), "ord": np.roll(ords, -1), "tk": np.roll(tks, -1)})) if m else None
    return placed if ahead is None else placed.unionByName(docs.join(F.broadcast(ahead), ["ord", "tk"]).withColumn("ahead", F.lit(1)))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by run, ahead, order: each document with its successor."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)))

    def told(doc_id, text: str, mark: str, after: str, after_mark: str) -> tuple:
        cut = len(text) // 4
        edited = (text[: len(text) - cut] + after[:cut]).encode()
        edited_mark = fingerprint(edited)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after_mark)

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    last = None  # run, doc_id, text, fingerprint of the document that waits for its successor
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("run", "ahead", "doc_id", "copies")]
        for run, ahead, doc_id, copies, text in zip(*columns, text_array(batch.column("text")).to_pylist(), strict=True):
            mark = fingerprint(text.encode())
            if last is not None and last[0] == run:
                out.append(told(*last[1:], text, mark))
            last = None if ahead else (run, doc_id, text, mark)
            if copies > 1 and not ahead:  # each copy but the last is followed by an equal one
                row = told(doc_id, text, mark, text, mark)
                for k in range(0, copies - 1, 1000):
                    yield sent([row] * min(1000, copies - 1 - k))
        if out:
            yield sent(out)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tk", F.xxhash64("text"))
    rows = docs.count()
    n = max(1, docs.sparkSession.sparkContext.defaultParallelism, min(MAX_RUNS, rows // RUN))
    rows = _runs(_singles(docs), rows).repartition(n, "run").sortWithinPartitions("run", "ahead", "ord", "tk")
    return arrow_map(
        rows.select("run", "ahead", "doc_id", "copies", "text"),
        _walk,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
