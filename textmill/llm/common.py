"""Shared pieces: durable intermediate tables, Arrow text buffers, vectorised word hashing.

Everything here works on whole Arrow batches with numpy, so no Python code runs
once per word. Positions are byte positions in the UTF-8 text.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_code, spread

#: Bytes of text that a numpy step works on at once (a single longer text is one step).
SLICE_BYTES = 1 << 20
#: Ids that may be broadcast for a semi join; above it the join is shuffled.
BROADCAST_IDS = 2_000_000

_U = np.uint64


# ------------------------------------------------------------------ durable tables

#: Bytes of an Arrow batch while a table is written.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local one, and only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or f"file:///tmp/textmill-{os.getuid()}"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as a table is written."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the steps before,
    and steps that need the table twice don't compute it twice. All tables of an application
    lie below <shared folder>/textmill/<application>; `discard` deletes one, `clear` all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textmill/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        if getattr(t, "_table", None):
            _delete(t.sparkSession, t._table)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application, once its results are written."""
    _delete(spark, f"{shared_dir(spark)}/textmill/{spark.sparkContext.applicationId}")


def semi_by_id(df: DataFrame, ids: DataFrame, col: str = "doc_id") -> DataFrame:
    """Rows of df whose id is in ids (distinct, already materialised). Null ids match nothing.

    The id list is broadcast only if counted to at most BROADCAST_IDS (16 MB of longs).
    """
    ids = ids.select(col)
    n = ids.count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, col, "left_semi")


#: Keys that are joined by a broadcast because they are frequent: at most as many, as each has more than 1/HOT_KEYS of all rows.
HOT_KEYS = 50_000
#: Rows of a key that one task may get whatever the size of the table.
KEY_ROWS = 20_000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """rows joined with keyed (materialised, one row per key, `count` at least its rows in `rows`), without a hot task.

    Keys of more than max(KEY_ROWS, total / HOT_KEYS) rows are fewer than HOT_KEYS, so their part of
    `keyed` is broadcast and their rows stay where they are; all others are shuffled.
    """
    total = keyed.agg(F.coalesce(F.sum(count), F.lit(0))).collect()[0][0]
    limit = max(KEY_ROWS, total // HOT_KEYS)
    hot = keyed.where(F.col(count) > limit)
    if hot.isEmpty():
        return rows.join(keyed, keys)
    hot = F.broadcast(hot)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(keyed.where(F.col(count) <= limit), keys)
    return rows.join(hot, keys).unionByName(cold)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What operators hold in this worker, and how it is dropped.
_holders: dict[str, Callable[[], None]] = {}


def claim(name: str, drop: Callable[[], None] | None = None) -> None:
    """This worker now works for the operator `name` (which holds something, if it says how to drop it): what others held goes."""
    others = [n for n in _holders if n != name]
    for other in others:
        _holders.pop(other)()
    if drop is not None:
        _holders[name] = drop
    if others:
        give_back()


def anti_by_id(df: DataFrame, ids: DataFrame, col: str = "doc_id") -> DataFrame:
    """Rows of df whose id is not in ids; rows with a null id stay. Broadcast as in semi_by_id."""
    ids = ids.select(col)
    n = ids.count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, col, "left_anti")


def arrow_map(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in this package's workers; Spark bounds the batches in bytes."""
    ship_code(df.sparkSession)
    name = step.__module__

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # the default pool keeps freed memory
        claim(name)
        yield from step(batches)
        give_back()

    return spread(df).mapInArrow(lean, schema)


def quoted(name: str) -> str:
    """The name as Spark resolves it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from the columns `taken`."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
    return out


# ------------------------------------------------------------------ text buffers


def text_array(col: pa.Array) -> pa.Array:
    """A large_string array without nulls (null texts are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text array: text i is bytes[offsets[i]:offsets[i+1]]."""
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `limit` bytes, or one longer text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets per text) of the words [^\\x20\\x09-\\x0D]+."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = ~WS[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offs[1:-1]
    at = inner[inner < len(buf)]
    first[at] = solid[at]
    at = inner[inner > 0] - 1
    last[at] = solid[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


# ------------------------------------------------------------------ hashing

#: Words of more bytes than this are hashed one by one.
LONG = 64
#: Start, step, two multipliers and the constant of sets for each of two independent hashes (arbitrary odd numbers).
_ODD = [[_U(int(x) | 1) for x in np.random.default_rng(seed).integers(1 << 62, 1 << 63, 6)] for seed in (20240607, 20250711)]
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _stir(h: np.ndarray, x: np.ndarray, which: int) -> np.ndarray:
    """The state h with 64 more bits: multiplied and shifted between inputs, so sums and products of inputs don't cancel."""
    _, step, a, b, c, _ = _ODD[which]
    h = h * a + step
    h ^= h >> _U(31)
    h ^= x
    h *= b
    h ^= h >> _U(32)
    h *= c
    h ^= h >> _U(29)
    return h


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zero bytes follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def range_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges buf[starts:ends], eight bytes at a time; long ranges by blake2b."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * _ODD[which][1] + _ODD[which][0])
    if not len(h):
        return h
    view = eights(buf)
    h = _stir(h, view[starts] & _FIRST_BYTES[np.minimum(size, 8)], which)
    rows = np.flatnonzero((size > 8) & (size <= LONG))
    k = 8
    while len(rows):
        h[rows] = _stir(h[rows], view[starts[rows] + k] & _FIRST_BYTES[np.minimum(size[rows] - k, 8)], which)
        k += 8
        rows = rows[size[rows] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, person=b"%d" % which).digest(), "little")
    return h


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether `size` bytes from a_starts equal those from b_starts, for many ranges at once; a and b as `eights` gives them."""
    same = np.ones(len(size), bool)
    rows, k = np.flatnonzero(size > 0), 0
    while len(rows) and k < LONG:
        differ = (a[a_starts[rows] + k] ^ b[b_starts[rows] + k]) & _FIRST_BYTES[np.minimum(size[rows] - k, 8)] != 0
        same[rows[differ]] = False
        k += 8
        rows = rows[(size[rows] > k) & ~differ]
    for i in rows.tolist():
        n = int(size[i])
        x, y = a[a_starts[i] : a_starts[i] + n : 8], b[b_starts[i] : b_starts[i] + n : 8]
        same[i] = np.array_equal(x[:-1], y[:-1]) and not (x[-1] ^ y[-1]) & _FIRST_BYTES[(n - 1) % 8 + 1]
    return same


def window_hash(values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of every `size` values in a row, put together from halves by doubling."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, width, part = None, 0, 1, values
    while at < size:
        if size & width:
            some = part[at : at + n]
            out = some.copy() if out is None else _stir(out, some, which)
            at += width
        if at < size:
            part = _stir(part[:-width], part[width:], which)
            width *= 2
    return mix(out + _U(size * int(_ODD[which][0]) % (1 << 64)))


def sequence_hash(values: np.ndarray, starts: np.ndarray, size: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of few values in a row: `size` of them (1 or more) from each start."""
    h = mix(values[starts] + size.astype(np.uint64) * _ODD[which][0])
    rows, k = np.flatnonzero(size > 1), 1
    while len(rows):
        h[rows] = _stir(h[rows], values[starts[rows] + k], which)
        k += 1
        rows = rows[size[rows] > k]
    return h


def set_hash(values: np.ndarray, cut: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the sets values[cut[i] : cut[i + 1]] of distinct hashes, whatever their order."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ _ODD[which][5]), out=total[1:])
    return mix(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(np.uint64) * _ODD[which][0])


def hash_windows(words: np.ndarray, offs: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(start positions, hashes) of all windows of `size` words that lie within one text."""
    starts = window_starts(offs, size)
    return starts, window_hash(words, size, which)[starts] if len(starts) else np.zeros(0, np.uint64)


def window_starts(offs: np.ndarray, size: int) -> np.ndarray:
    counts = np.maximum(np.diff(offs) - size + 1, 0)
    return ranges(offs[:-1], counts)


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, … counts[i] of them, for every i, in one array."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    keep = counts > 0
    first, counts = first[keep], counts[keep]
    if not total:
        return out
    at = np.cumsum(counts)
    out[0] = first[0]
    out[at[:-1]] = first[1:] - first[:-1] - counts[:-1] + 1
    return np.cumsum(out)


def list_array(values: np.ndarray, offs: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offs, np.int32)), pa.array(values))


def long_list(values: np.ndarray, offs: np.ndarray) -> pa.ListArray:
    """ARRAY<BIGINT> with one array per text."""
    return list_array(np.ascontiguousarray(values).view(np.int64), offs)


def take_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as a string array."""
    size = ends - starts
    data = buf[ranges(starts, size)]
    offs = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(size, out=offs[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes()))
