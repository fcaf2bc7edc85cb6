"""Counts of characters and of three in a row, summed within tasks before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import flat, steps
from ..session import ship_code, spread

#: Distinct keys that a task holds before it sends them on.
HELD = 2_000_000


def _counted(docs: DataFrame, text: str, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """key, n over all texts; keys_of(code points, their text numbers) gives a long for each place that counts."""
    ship_code(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000]), pa.array(n[i : i + 50_000])], ["key", "n"])

        for batch in batches:
            buf_all, offs_all = flat(batch.column(0))
            for i, j in steps(offs_all):
                buf, offs = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
                points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
                cut = np.searchsorted(np.flatnonzero((buf & 0xC0) != 0x80), offs)
                held.append(np.unique(keys_of(points, np.repeat(np.arange(j - i), np.diff(cut))), return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield from sent()
                    held, size = [], 0
        if held:
            yield from sent()

    return spread(docs.select(text)).mapInArrow(step, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """ch, n of every character."""
    return _counted(docs, text, lambda points, _: points).select(F.decode(F.unhex(F.lpad(F.hex("key"), 8, "0")), "UTF-32").alias("ch"), "n")


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """a, b, c, n: three characters in a row within a text, as code points."""

    def keys(points: np.ndarray, text: np.ndarray) -> np.ndarray:
        k = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
        return k[text[2:] == text[:-2]] if len(points) > 2 else points[:0]

    mask = (1 << 21) - 1
    part = lambda bits: F.shiftright("key", bits).bitwiseAND(mask).cast("int")
    return _counted(docs, text, keys).select(part(42).alias("a"), part(21).alias("b"), part(0).alias("c"), "n")


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row, vocab: character -> id, its rank by code point (as many entries as distinct characters)."""
    chars = counts(docs, text).agg(F.array_sort(F.collect_list(F.struct(F.conv(F.hex(F.encode("ch", "UTF-32")), 16, 10).cast("int").alias("o"), "ch"))).alias("v"))
    return chars.select(F.map_from_entries(F.transform("v", lambda x, i: F.struct(x["ch"], i))).alias("vocab"))


def codes(docs: DataFrame, vocab: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ids: texts by a vocabulary; characters that it lacks are left out."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return docs.crossJoin(F.broadcast(vocab)).select(key, F.array_compact(F.transform(chars, lambda c: F.try_element_at("vocab", c))).alias("ids"))


def decoded(rows: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """key, text from ids."""
    back = F.map_from_entries(F.transform(F.map_entries("vocab"), lambda e: F.struct(e["value"], e["key"])))
    return rows.crossJoin(F.broadcast(vocab.select(back.alias("back")))).select(key, F.array_join(F.transform("ids", lambda i: F.try_element_at("back", i)), "").alias("text"))
