"""Removal of repeated passages by level-wise doubling of window lengths.

A window of `window` words is repeated if its word sequence also starts in a document
with a smaller doc_id. Levels of window lengths lead up to `window`, each twice the one
before (13, 26, 50). A longer window can only repeat if the shorter ones in it do, so each
level looks only at windows that hold a survivor of the level below; it ends where none survive.

The lower levels keep anchors alone: a window of length L is an anchor if its hash is the
least among the L-windows of some window of the full length that holds a survivor. Equal full
windows have equal anchors, and each has at least one, so nothing that repeats is lost; of
random text about 2 / (`window` - L + 2) of the windows are anchors. The last level looks at all
windows around survivors and compares hashes of 128 bits.

Documents with equal word sequences meet first: all but the smallest doc_id are wholly
repeated (if they have `window` words) and need no windows at all. Passages and texts that
very many documents share are joined by a broadcast of their few keys, not in one task.

Nulls and edges: a null or empty text has no words, nothing is removed and kept_sha256 is
that of the empty string; a null doc_id is neither smaller nor larger than any, so such
rows lose nothing and cause no removal; rows that repeat a doc_id don't remove each
other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    arrow_map,
    buffers,
    discard,
    hash_windows,
    join_counted,
    long_list,
    materialize,
    range_hash,
    ranges,
    semi_by_id,
    slices,
    text_array,
    window_hash,
    word_spans,
)

def levels(window: int, first: int | None = None) -> list[int]:
    """The window lengths below `window`, each twice the one before (the first about a quarter of it)."""
    out, size = [], min(first or (window + 3) // 4, window)
    while size < window:
        out.append(size)
        size *= 2
    return out


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over values[i : i + width], by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[: len(values) - step], values[step:])
        done += step
    return values


def anchors(hashes: np.ndarray, offs: np.ndarray, length: int, longer: int, allowed: np.ndarray | None = None) -> np.ndarray:
    """Which windows of `length` words are the least in some window of `longer` words of their text.

    hashes: of all windows of all texts, one text after another; offs: word offsets of the texts;
    allowed: which of the windows begin where a longer one counts.
    """
    span = longer - length + 1
    n = len(hashes)
    if n < span:
        return np.zeros(n, bool)
    per_text = np.maximum(np.diff(offs) - length + 1, 0)
    text = np.repeat(np.arange(len(per_text)), per_text)
    counts = text[span - 1 :] == text[: n - span + 1]  # a run may not leave its text
    if allowed is not None:
        counts &= allowed[: n - span + 1]
    least = np.where(counts, _slide(hashes, span, np.minimum), 0)
    # the greatest of the minima over the runs that hold a window is its own hash iff it is least in one
    pad = np.zeros(span - 1, np.uint64)
    return _slide(np.concatenate([pad, least, pad]), span, np.maximum) == hashes


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _joined(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


_TIDY = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _squeezed(raw: bytes) -> bytes:
    """All words of the text joined by one space."""
    return b" ".join(raw.translate(_TIDY).split(b" ")) if b"  " not in (t := raw.translate(_TIDY)) and t[:1] != b" " and t[-1:] != b" " else b" ".join(t.split())


def summarize(window: int):
    """doc_id, text key, n_words, sha of the words, anchors of the first level."""
    first = levels(window)[0]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column("text"))
            buf_all, offs_all = buffers(texts)
            for i, j in slices(offs_all):
                buf, offs = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
                starts, ends, wo = word_spans(buf, offs)
                words = range_hash(buf, starts, ends)
                raw = buf.tobytes()
                shas = [_sha(_squeezed(raw[a:b])) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                at, hashes = hash_windows(words, wo, first)
                keep = anchors(hashes, wo, first, window)
                values, pos = hashes[keep], at[keep]
                cut = np.searchsorted(pos, wo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("tk").slice(i, j - i), pa.array(np.diff(wo)), pa.array(shas), long_list(values, cut)],
                    ["doc_id", "tk", "n_words", "sha", "anchors"],
                )

    return step


def _near(found: np.ndarray, pos: np.ndarray, length: int, longer: int, wo_text: tuple[int, int]) -> np.ndarray:
    """Starts of the windows of `longer` words around windows of `length` words at pos[found]."""
    lo = np.maximum(pos[found] - (longer - length), wo_text[0])
    hi = np.minimum(pos[found], wo_text[1] - longer)
    return np.unique(ranges(lo, np.maximum(hi - lo + 1, 0)))


def extend(window: int, length: int):
    """From surviving hashes of windows of `length` words to the next level's windows.

    Below the last level: their anchors' hashes. At the last: all windows, as two hashes and their word positions.
    """
    longer = min(2 * length, window)
    last = longer == window

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column("text"))
            buf_all, offs_all = buffers(texts)
            alive_all = batch.column("alive")
            for i, j in slices(offs_all):
                buf, offs = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
                starts, ends, wo = word_spans(buf, offs)
                words = range_hash(buf, starts, ends)
                part = alive_all.slice(i, j - i)
                alive = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                alive_off = np.concatenate([[0], np.cumsum(part.value_lengths().fill_null(0).to_numpy())])
                at, hashes = hash_windows(words, wo, length)
                cut = np.searchsorted(at, wo)
                chosen, a_cut = [], [0]
                for t in range(j - i):
                    own = hashes[cut[t] : cut[t + 1]]
                    found = np.flatnonzero(np.isin(own, alive[alive_off[t] : alive_off[t + 1]]))
                    chosen.append(_near(found, at[cut[t] : cut[t + 1]], length, window, (wo[t], wo[t + 1])))
                    a_cut.append(a_cut[-1] + len(chosen[-1]))
                at2 = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
                a_cut = np.asarray(a_cut)
                ids = [batch.column("doc_id").slice(i, j - i), batch.column("tk").slice(i, j - i)]
                if last:
                    h1 = window_hash(words, longer)[at2]
                    words2 = range_hash(buf, starts, ends, 1)
                    h2 = window_hash(words2, longer, 1)[at2]
                    # a window that recurs within its text is one entry with several places
                    text = np.repeat(np.arange(j - i), np.diff(a_cut))
                    pos = at2 - wo[:-1][text]
                    order = np.lexsort((pos, h2, h1, text))
                    h1, h2, text, pos = h1[order], h2[order], text[order], pos[order]
                    new = np.ones(len(h1), bool)
                    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (text[1:] != text[:-1])
                    first = np.flatnonzero(new)
                    cut2 = np.searchsorted(text[first], np.arange(j - i + 1))
                    places = pa.ListArray.from_arrays(pa.array(cut2.astype(np.int32)), long_list(pos, np.append(first, len(pos))))
                    yield pa.RecordBatch.from_arrays([*ids, long_list(h1[first], cut2), long_list(h2[first], cut2), places], ["doc_id", "tk", "h1", "h2", "pos"])
                else:
                    all_at, all_h = hash_windows(words, wo, longer)
                    begins = np.zeros(len(words) + 1, bool)
                    begins[at2] = True
                    keep = anchors(all_h, wo, longer, window, begins[all_at])
                    yield pa.RecordBatch.from_arrays([*ids, long_list(all_h[keep], np.searchsorted(all_at[keep], wo))], ["doc_id", "tk", "anchors"])

    return step


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur under two different doc_ids, with the smallest and the rows, as a written table."""
    counts = rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    return materialize(counts.where("least < most").drop("most"))


def cover(window: int):
    """Per document: what is left when the words of the repeated windows go."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column("text"))
            buf_all, offs_all = buffers(texts)
            where = batch.column("where")
            for i, j in slices(offs_all):
                buf, offs = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
                starts, ends, wo = word_spans(buf, offs)
                raw = buf.tobytes()
                removed, kept = [], []
                for t in range(j - i):
                    n = int(wo[t + 1] - wo[t])
                    edge = np.zeros(n + 1, np.int64)
                    pos = where[i + t].values.to_numpy()
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    s, e = starts[wo[t] : wo[t + 1]][~gone], ends[wo[t] : wo[t + 1]][~gone]
                    removed.append(int(gone.sum()))
                    kept.append(_joined(raw, s, e))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("tk").slice(i, j - i), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([_sha(x) for x in kept])],
                    ["doc_id", "tk", "n_removed", "kept", "kept_sha256"],
                )

    return step


def remove_repeats(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """(a row per document: doc_id, tk, n_words, n_removed, kept_sha256; for the changed ones: doc_id, tk, kept text).

    tk is xxhash64 of the text; it tells rows apart that repeat a doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tk"))
    sums = materialize(arrow_map(docs, summarize(window), "doc_id long, tk long, n_words long, sha string, anchors array<long>"))

    classes = materialize(sums.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)) & (F.col("n_words") >= window)
    whole = join_counted(sums, classes, ["sha"]).withColumn("copy", copy)
    whole = materialize(whole.select("doc_id", "tk", "n_words", "sha", "copy", F.when(~F.col("copy"), F.col("anchors")).alias("anchors")))
    discard(classes, sums)
    seeds = whole.where("doc_id is not null and size(anchors) > 0").select("doc_id", "anchors")

    hits, tables = None, []
    for length in levels(window):
        # candidates are kept by document alone: rows that repeat a doc_id share them, and the last level is exact
        found = seeds.select("doc_id", F.explode(F.array_distinct("anchors")).alias("h"))
        again = repeated(found, ["h"])
        alive = materialize(join_counted(found, again, ["h"]).groupBy("doc_id").agg(F.collect_set("h").alias("alive")))
        discard(again, *tables)
        tables = [alive]
        if alive.isEmpty():
            break
        rows = semi_by_id(docs, alive).join(alive, "doc_id").dropDuplicates(["doc_id", "tk"])
        if min(2 * length, window) == window:
            hits = arrow_map(rows, extend(window, length), "doc_id long, tk long, h1 array<long>, h2 array<long>, pos array<array<long>>")
        else:
            seeds = materialize(arrow_map(rows, extend(window, length), "doc_id long, tk long, anchors array<long>"))
            tables.append(seeds)
    hits = hits if hits is not None else docs.sparkSession.createDataFrame([], "doc_id long, tk long, h1 array<long>, h2 array<long>, pos array<array<long>>")
    hits = materialize(hits)
    discard(*tables)
    flat = hits.select("doc_id", "tk", F.explode(F.arrays_zip("h1", "h2", "pos")).alias("w")).select("doc_id", "tk", "w.h1", "w.h2", "w.pos")
    covered = join_counted(flat, repeated(flat, ["h1", "h2"]), ["h1", "h2"]).where("doc_id > least").groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("pos")).alias("where"))
    covered = materialize(covered)
    changed = semi_by_id(docs, covered.select("doc_id").distinct()).join(covered, ["doc_id", "tk"]).dropDuplicates(["doc_id", "tk"])
    changed = materialize(arrow_map(changed, cover(window), "doc_id long, tk long, n_removed long, kept string, kept_sha256 string"))

    cut = changed.select("doc_id", "tk", F.col("n_removed").alias("cut"), F.col("kept_sha256").alias("cut_sha"))
    result = whole.join(cut, ["doc_id", "tk"], "left").select(
        "doc_id",
        "tk",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(_sha(b""))).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        "copy",
    )
    return result, changed.select("doc_id", "tk", "kept")
