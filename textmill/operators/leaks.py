"""Held-out items in training rows: by keys (stem, program, specification) and by their names, addresses and marks in texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import UNSPACED
from ..session import ship_code, spread
from .ordered import small

#: Characters of needles that one automaton holds (about 100 bytes each in a worker); more are looked for in further passes.
NEEDLE_CHARS = 2_000_000


def row_leaks(rows: DataFrame, held: DataFrame, id: str, keys: dict[str, list[tuple[str, Column]]]) -> DataFrame:
    """id, reason of the rows that share a key with a held-out item; the first reason in the order of `keys`.

    keys: for each reason, (kind, key) pairs; a key meets keys of its own kind alone, and null meets nothing.
    Every row and item is read once: all keys of all reasons go through one semi join.
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("kind"), key.alias("key")) for i, (_, pairs) in enumerate(keys.items()) for kind, key in pairs])
    spread_keys = lambda df, *ids: df.select(*ids, F.explode(kinds).alias("k")).select(*ids, "k.*").where("key is not null")
    met = spread_keys(rows, id).join(small(spread_keys(held).select("kind", "key").distinct()), ["kind", "key"], "left_semi")
    reason = F.get(F.array(*map(F.lit, keys)), F.col("rank"))
    return met.groupBy(id).agg(F.min("rank").alias("rank")).select(id, reason.alias("reason"))


_EDGE = re.compile(rf"[^\W{UNSPACED}]")


def bounded(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] stands as words there: scripts without spaces have no boundaries to respect."""
    left = start > 0 and _EDGE.match(text[start]) and _EDGE.match(text[start - 1])
    right = end < len(text) and _EDGE.match(text[end - 1]) and _EDGE.match(text[end])
    return not (left or right)


def _pass(docs: DataFrame, needles: list[str]) -> DataFrame:
    """One pass over all texts with one automaton: doc_id, needle, anywhere, whole (hits)."""
    shared = docs.sparkSession.sparkContext.broadcast(needles)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, needles = ahocorasick.Automaton(), shared.value
        for i, needle in enumerate(needles):
            automaton.add_word(needle, i)
        automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                hits: dict[int, list[int]] = {}
                for last, i in automaton.iter(text) if text else ():
                    count = hits.setdefault(i, [0, 0])
                    count[0] += 1
                    count[1] += bounded(text, last + 1 - len(needles[i]), last + 1)
                ids += [at] * len(hits)
                found += [(needles[i], *count) for i, count in hits.items()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), *columns], ["doc_id", "needle", "anywhere", "whole"])

    return spread(docs.select("doc_id", "text")).mapInArrow(step, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, needle string, anywhere long, whole long")


def leak_check(docs: DataFrame, items: DataFrame, chars: int = NEEDLE_CHARS) -> DataFrame:
    """doc_id, hits and the columns of `items` (needle, words, and any others) for each item whose needle a text has.

    words: whether the needle has to stand as words, as a name does; addresses and marks may stand anywhere. All
    distinct needles are looked for in one pass over the texts; a list of more than `chars` characters (read
    block by block) takes a pass for each block. Hits of a needle may overlap. Empty and null needles are found nowhere.
    """
    ship_code(docs.sparkSession)
    found, block, size = [], [], 0
    for row in items.where("needle <> ''").select("needle").distinct().orderBy("needle").toLocalIterator():
        if block and size + len(row.needle) > chars:
            found.append(_pass(docs, block))
            block, size = [], 0
        block.append(row.needle)
        size += len(row.needle)
    if block:
        found.append(_pass(docs, block))
    hits = docs.select("doc_id", F.lit("").alias("needle"), F.lit(0).cast("long").alias("anywhere"), F.lit(0).cast("long").alias("whole")).where("false")
    for part in found:
        hits = hits.unionByName(part)
    counted = hits.join(small(items), "needle").withColumn("hits", F.when(F.col("words"), F.col("whole")).otherwise(F.col("anywhere")))
    return counted.where("hits > 0").select("doc_id", *items.columns, "hits")
