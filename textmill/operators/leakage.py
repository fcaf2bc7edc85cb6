"""Overlap between the sides of a split, and decontamination against a protected set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import grams

from ..functions.python_text import python_udf, winnowed
from ..functions.text import PY_SPACE, alnum_words, ngrams, split_lines_py, statement_key, strip_py
from ..session import ship_code, spread
from .ordered import small
from .rows import cap_per_group


def gram_index(protected: DataFrame, n: int = 13, key: str = "item_id") -> DataFrame:
    """gram, owners: the distinct n-grams of the protected texts."""
    grams = protected.select(F.col(key).alias("owner"), F.explode(ngrams(alnum_words("text"), n)).alias("gram"))
    return grams.groupBy("gram").agg(F.array_sort(F.collect_set("owner")).alias("owners"))


#: Protected n-grams whose hashes every worker holds at most (8 bytes each); more are joined by a shuffle.
HELD_GRAMS = 5_000_000


def _rolling(words: DataFrame, n: int) -> Column:
    """xxhash64 of every n words, from hashes of single words."""
    return F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(F.slice("w", i + 1, n)))


def _hashes(index: DataFrame, n: int) -> np.ndarray | None:
    """The sorted hashes of the grams, hashed as texts are; None if there are more than HELD_GRAMS."""
    ship_code(index.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, g in grams(batch.column("gram"), n):
                yield pa.RecordBatch.from_arrays([pa.array(g.h)], ["h"])

    h = index.select("gram").mapInArrow(step, "h long").limit(HELD_GRAMS + 1).toArrow()["h"].to_numpy()
    return None if len(h) > HELD_GRAMS else np.unique(h)


def _held_hits(docs: DataFrame, known: np.ndarray, n: int) -> DataFrame:
    """doc_id, pos, gram: places whose n words hash like a protected n-gram; one pass, nothing but hits leaves it."""
    table = docs.sparkSession.sparkContext.broadcast(known)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches if len(known) else ():
            for i, j, g in grams(batch.column("text"), n):
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, g.h), len(known) - 1)] == g.h)
                text, pos = g.places(hit)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).take(pa.array(text)), pa.array(pos.astype(np.int32)), pa.array(g.said(hit), pa.string())], ["doc_id", "pos", "gram"])

    return spread(docs.select("doc_id", "text")).mapInArrow(step, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pos int, gram string")


def first_matches(docs: DataFrame, protected: DataFrame, n: int = 13) -> DataFrame:
    """doc_id, pos, gram, owners: the first protected n-gram of every document that has one.

    Places are found by 64-bit hashes of their words, rolled over each text in whole batches; the
    few that hit are then joined by the words themselves.
    """
    index = gram_index(protected, n)
    known = _hashes(index, n)
    if known is not None:
        hits = _held_hits(docs, known, n)
    else:
        words = docs.select("doc_id", alnum_words("text").alias("w")).where(F.size("w") >= n)
        places = words.select("doc_id", "w", F.posexplode(_rolling(words, n)).alias("pos", "h")).join(index.select(F.xxhash64(F.split("gram", " ")).alias("h")), "h", "left_semi")
        hits = places.select("doc_id", "pos", F.array_join(F.slice("w", F.col("pos") + 1, n), " ").alias("gram"))
    sure = hits.join(index, "gram")
    return sure.groupBy("doc_id").agg(F.min_by(F.struct("pos", "gram", "owners"), "pos").alias("m")).select("doc_id", F.col("m.pos").alias("pos"), F.col("m.gram").alias("gram"), F.col("m.owners").alias("owners"))


def split_rows(split: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text, split; the texts stay where they are if the split is small enough to be broadcast."""
    return spread(docs.select("doc_id", "text")).join(small(split), "doc_id")


def document_overlap(rows: DataFrame) -> DataFrame:
    """One row: validation documents, and how many have a stripped text of the training side."""
    keyed = rows.select("split", F.sha2(strip_py("text"), 256).alias("h"))
    seen = keyed.where("split = 'train'").select("h").distinct().withColumn("hit", F.lit(1))
    return keyed.where("split = 'val'").join(seen, "h", "left").agg(F.count(F.lit(1)).alias("documents"), F.count("hit").alias("shared"))


def line_overlap(rows: DataFrame) -> DataFrame:
    """One row: validation lines that are not blank, and how many are lines of training (unchanged, with multiplicity); lines meet by digests, their text is not moved."""
    lines = rows.select("split", F.explode(split_lines_py("text")).alias("l")).where(~F.col("l").rlike(f"^[{PY_SPACE}]*+(?![\\s\\S])"))
    counts = lines.groupBy(F.unhex(F.sha2("l", 256)).alias("h")).agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "val").alias("v"))
    return counts.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.when(F.col("t") > 0, F.col("v"))), F.lit(0)).alias("shared"))


def content_overlap(rows: DataFrame, digest: str = "blake2b") -> DataFrame:
    """One row: distinct winnowing fingerprints of the validation side, and those of them that training has."""
    ship_code(rows.sparkSession)
    prints = rows.select("split", F.explode(python_udf(lambda text: winnowed(text, digest=digest), "array<bigint>")("text")).alias("h"))
    sides = prints.groupBy("h").agg(F.bool_or(F.col("split") == "val").alias("v"), F.bool_or(F.col("split") == "train").alias("t"))
    return sides.agg(F.count_if("v").alias("fingerprints"), F.count_if(F.col("v") & F.col("t")).alias("shared"))


#: The shares from which an arm is contaminated or suspect, and the lines that the line arm needs
#: (fewer, if it is decisive).
BARS = {"content": (0.20, 0.05), "document": (0.10, 0.01), "line": (0.90, 0.50)}
LINES, DECISIVE_LINES = 20, 3
CALLS = ("CLEAN", "SUSPECT", "CONTAMINATED")


def verdict(content: DataFrame, documents: DataFrame, lines: DataFrame, aligned: bool = True) -> DataFrame:
    """One row: the three shares, the worst call of the arms that are read, and these arms' names as the reason.

    aligned: whether the split kept documents whole; else the document arm is not read. The line arm is
    read from LINES lines on, or from DECISIVE_LINES on if it is contaminated.
    """
    share = lambda df, n, out: df.select((F.col("shared") / F.greatest(n, F.lit(1))).alias(out), F.col(n).alias(f"{out}_of"))
    row = share(content, "fingerprints", "content").crossJoin(share(documents, "documents", "document")).crossJoin(share(lines, "lines", "line"))
    call = {arm: F.when(F.col(arm) >= high, 2).when(F.col(arm) >= low, 1).otherwise(0) for arm, (high, low) in BARS.items()}
    n = F.col("line_of")
    read = {"content": F.lit(True), "document": F.lit(aligned), "line": (n >= LINES) | (n >= DECISIVE_LINES) & (F.col("line") >= BARS["line"][0])}
    heard = {arm: F.when(read[arm], call[arm]).otherwise(0) for arm in BARS}
    worst = F.greatest(*heard.values())
    names = F.array_compact(F.array(*[F.when((heard[arm] == worst) & (worst > 0), arm) for arm in BARS]))
    return row.select(*[F.round(arm, 6).alias(f"{arm}_share") for arm in BARS], F.get(F.array(*map(F.lit, CALLS)), worst).alias("verdict"), F.array_join(names, ",").alias("reason"))


def statement_contamination(docs: DataFrame, protected: DataFrame, least: int = 24) -> DataFrame:
    """doc_id, item_id of equal normalised statements of at least `least` characters."""
    a = docs.select("doc_id", statement_key("text").alias("k")).where(F.char_length("k") >= least)
    b = protected.select("item_id", statement_key("text").alias("k")).where(F.char_length("k") >= least)
    return a.join(b, "k").select("doc_id", "item_id")


#: Needles that one pass over the texts looks for.
NEEDLES = 5_000


def containing(docs: DataFrame, needles: DataFrame, text: str = "needle") -> DataFrame:
    """doc_id and the needles' columns of plain substring matches; a stated list, in blocks of about NEEDLES."""
    blocks = -(-needles.count() // NEEDLES)
    out = None
    for k in range(max(blocks, 1)):
        block = needles.where(F.pmod(F.xxhash64(text), F.lit(max(blocks, 1))) == k)
        found = docs.select("doc_id", "text").join(F.broadcast(block), F.col("text").contains(F.col(text))).select("doc_id", *needles.columns)
        out = found if out is None else out.unionByName(found)
    return out


def examples(hits: DataFrame, by: str, order: str, most: int = 25, chars: int = 280) -> DataFrame:
    """The first `most` hits of each file, with the beginning of the text, for a reader; ids of hits are not capped elsewhere."""
    return cap_per_group(hits, [by], [F.col(order)], most).withColumn("snippet", F.substring("text", 1, chars)).drop("text")
