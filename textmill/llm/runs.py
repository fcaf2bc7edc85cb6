"""Periodic runs of words, found through Lyndon words; no suffix array.

A run is a stretch of words with smallest period q (words q apart are the same) and length >= max(24, 3 q) that
neither neighbour extends. Each text by itself:

1. Only words in some 16-gram that stands at least twice in the text can be in a run: two places q apart in a run of
   length L have L - q >= 16 words in common, and the 16-grams of both cover the run. The stretches of
   such words go on (found by hashes for whole batches; a collision only adds words to look at).
2. In each stretch the longest Lyndon word from every place is found from right to left, with a stack of the
   words ahead, once under the order of the words' numbers and once under its reverse. Two neighbouring Lyndon
   words are compared at the end of their longest common extension (LCE).
3. Every run is extended from a Lyndon word of its period that stands twice in a row. LCEs to the right and to the left
   are found by binary search over rolling hashes of prefixes and then verified word by word; what a collision
   made too long is cut at the first different word. Numbers are given to words by hash and verified by bytes.

Memory is a few arrays over one text's words; the work is near n log n in its words.

Nulls and edges: a null or empty text has no words and no runs. Rows with a null or repeated doc_id are each worked
out by themselves; copies give equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, buffers, eights, hash_windows, range_hash, ranges, same_bytes, slices, take_spans, text_array, window_hash, word_spans

#: A run's least length in words and in periods, and the words that two places one period apart surely share.
LEAST, TIMES = 24, 3
SHARED = LEAST - LEAST // TIMES
WORD = r"[\x20\x09-\x0D]+"
MASK = (1 << 64) - 1
#: Words that are compared directly before hashes are asked.
AT_ONCE = 4


class Run(NamedTuple):
    start: int
    length: int
    period: int


# ------------------------------------------------------------------ common extensions


class Extensions:
    """Longest common extensions of a sequence of word numbers: prefix hashes are sums of number x base^place (mod 2^64)."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, word: np.ndarray):
        n = len(word)
        powers = np.full(n + 1, self.BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        total = np.zeros(n + 1, np.uint64)
        noise = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        np.cumsum((noise ^ (noise >> np.uint64(29))) * powers[:-1], out=total[1:])
        self.n, self.word = n, word
        self.values, self.total, self.power = memoryview(word), memoryview(total), memoryview(powers)

    def right(self, i: int, j: int, most: int) -> int:
        """How many of at most `most` words from i and from j > i are the same."""
        v = self.values
        near = min(most, AT_ONCE)
        for k in range(near):
            if v[i + k] != v[j + k]:
                return k
        low = near + self._search(most - near, lambda m: (i + near, j + near, m))
        return self._verified(low, self.word[i : i + low], self.word[j : j + low], False)

    def left(self, i: int, j: int, most: int) -> int:
        """How many of at most `most` words before i and before j > i are the same."""
        v = self.values
        near = min(most, AT_ONCE)
        for k in range(near):
            if v[i - 1 - k] != v[j - 1 - k]:
                return k
        low = near + self._search(most - near, lambda m: (i - near - m, j - near - m, m))
        return self._verified(low, self.word[i - low : i], self.word[j - low : j], True)

    def _search(self, most: int, places) -> int:
        """The most words, up to `most`, whose hashes at both places agree: doubling, then halving."""
        h, p = self.total, self.power
        low, step = 0, 1
        high = most + 1  # the least size known to differ
        while low + 1 < high:
            m = min(low + step, high - 1) if step else (low + high) // 2
            i, j, size = places(m)
            if ((h[i + size] - h[i]) * p[j - i] - h[j + size] + h[j]) & MASK:
                high, step = m, 0
            else:
                low, step = m, step * 2
        return low

    @staticmethod
    def _verified(size: int, a: np.ndarray, b: np.ndarray, backwards: bool) -> int:
        if size <= AT_ONCE or np.array_equal(a, b):
            return size
        differ = np.flatnonzero(a != b)  # a collision
        return int(size - 1 - differ[-1]) if backwards else int(differ[0])


# ------------------------------------------------------------------ Lyndon words


def lyndon_ends(word: np.ndarray, common: Extensions) -> list[int]:
    """The end of the longest Lyndon word from each place, under the order of `word`."""
    n, v = len(word), memoryview(word)
    ends, ahead = [0] * n, []  # ahead: starts of the Lyndon words to the right, nearest last
    for i in range(n - 1, -1, -1):
        end = i + 1
        while ahead:
            j = ahead[-1]  # == end
            if v[i] > v[j]:
                break
            if v[i] == v[j]:
                own, other = end - i, ends[j] - j
                same = common.right(i, j, min(own, other))
                if same == min(own, other):
                    if own >= other:
                        break
                elif v[i + same] > v[j + same]:
                    break
            end = ends[ahead.pop()]
        ends[i] = end
        ahead.append(i)
    return ends


def runs_of(word: np.ndarray) -> set[Run]:
    """All runs of a sequence of numbers."""
    n = len(word)
    found: set[Run] = set()
    if n < LEAST:
        return found
    word = np.ascontiguousarray(word, np.int64)
    common = Extensions(word)
    v, latest = common.values, {}  # the last stretch seen of each period
    for order in (word, -word):
        ends = lyndon_ends(order, common)
        for i in range(n - 1, -1, -1):
            j = ends[i]
            p = j - i
            if j + p > n or v[i] != v[j] or ends[j] != j + p:  # in a run the root stands again
                continue
            seen = latest.get(p)
            if seen and seen[0] <= i and j + p <= seen[1]:
                continue
            begin = i - common.left(i, j, i)
            end = j + common.right(i, j, n - j)
            latest[p] = begin, end
            if end - begin >= max(LEAST, TIMES * p):
                found.add(Run(begin, end - begin, p))
        latest.clear()
    return found


# ------------------------------------------------------------------ texts


def numbered(buf: np.ndarray, view: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes alone."""
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    size, of = ends - starts, first[number]
    if (size == size[of]).all() and same_bytes(view, starts, view, starts[of], size).all():
        return number
    seen: dict[bytes, int] = {}  # two words have one hash
    return np.array([seen.setdefault(buf[s:e].tobytes(), len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])


def stretches(keys: np.ndarray, cut: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the stretches of words within 16-grams that their text has twice, at least LEAST long."""
    at, h = hash_windows(keys, cut, SHARED)
    if not len(at):
        return []
    text = np.searchsorted(cut, at, "right") - 1
    order = np.lexsort((h, text))
    same = (h[order[1:]] == h[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    if not again.any():
        return []
    change = np.zeros(len(keys) + 1, np.int64)
    np.add.at(change, at[again], 1)
    np.add.at(change, at[again] + SHARED, -1)
    inside = np.cumsum(change)[:-1] > 0
    edge = np.zeros(len(keys) + 1, bool)
    edge[0], edge[-1], edge[cut] = True, True, True
    edge[1:-1] |= inside[1:] != inside[:-1]
    bounds = np.flatnonzero(edge)
    keep = inside[bounds[:-1]] & (np.diff(bounds) >= LEAST)
    a, b = bounds[:-1][keep], bounds[1:][keep]
    return list(zip((np.searchsorted(cut, a, "right") - 1).tolist(), a.tolist(), b.tolist(), strict=True))


def text_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[list[list[Run]], np.ndarray, np.ndarray, np.ndarray]:
    """(runs of each text by start and period, word starts, word ends, word offsets per text)."""
    starts, ends, cut = word_spans(buf, offs)
    out: list[list[Run]] = [[] for _ in range(len(offs) - 1)]
    keys, view = range_hash(buf, starts, ends), eights(buf)
    for text, a, b in stretches(keys, cut):
        first = int(cut[text])
        out[text] += [Run(r.start + a - first, r.length, r.period) for r in runs_of(numbered(buf, view, starts[a:b], ends[a:b], keys[a:b]))]
    for runs in out:
        runs.sort(key=lambda r: (r.start, r.period))
    return out, starts, ends, cut


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period alone."""
    change = np.zeros(n + 1, np.int64)
    for r in runs:
        change[r.start + r.period] += 1
        change[r.start + r.length] -= 1
    return np.cumsum(change)[:-1] == 0


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words with one space between them."""
    if not len(starts):
        return b""
    size = ends - starts + 1
    out = np.full(int(size.sum()), 0x20, np.uint8)
    out[ranges(np.cumsum(size) - size, size - 1)] = buf[ranges(starts, size - 1)]
    return out[:-1].tobytes()


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text of every row's whole text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf_all, offs_all = buffers(text_array(batch.column("text")))
            for i, j in slices(offs_all):
                buf = buf_all[offs_all[i] : offs_all[j]]
                found, starts, ends, cut = text_runs(buf, offs_all[i : j + 1] - offs_all[i])
                left = []
                for t, runs in enumerate(found):
                    a, b = starts[cut[t] : cut[t + 1]], ends[cut[t] : cut[t + 1]]
                    stay = collapsed(len(a), runs) if runs else slice(None)
                    left.append(joined(buf, a[stay], b[stay]).decode())
                flat = [r for runs in found for r in runs]
                at = np.concatenate([[0], np.cumsum([len(runs) for runs in found])]).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], ["start", "length", "period"])
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), fields), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, RUNS)


# ------------------------------------------------------------------ the query's rows


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents, chosen by the crc32 of the id, words from some place on repeat a first few; others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", WORD), lambda w: w != ""))
    n = F.when(F.size("w") > 0, F.size("w"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), words.alias("w"))
    rows = rows.withColumn("a", F.col("g") % n).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per document: number of runs, the one of the greatest length / period, and digests of all runs and of the collapsed text."""
    better = lambda x, y: F.when((y["length"] * x["period"] > x["length"] * y["period"]), y).otherwise(x)
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), better)
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    row = found.withColumn("best", best)
    return row.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
