"""Token counts of whole texts by a byte-level BPE, without materialising ids.

1. Every text is cut into pre-tokens (vectorised). Strings of added tokens, which the library
   finds before anything else, count as one token each and bound the stretches around them.
2. Each task sends its distinct pre-tokens with their counts; the distinct pre-tokens of the whole
   corpus meet in a shuffle, and the library counts the pieces of each exactly once. Written as a
   table of (two 64-bit hashes, occurrences, pieces).
3. Each text's pre-token frequencies are joined with that table and summed. The table's frequent part
   (at most DICTIONARY words, the least cut that leaves as many) is broadcast and met where the
   frequencies are made; frequencies of all other words are written as rows beside the text's id and joined by
   a shuffle. A word outside the dictionary has at most 1/DICTIONARY of all occurrences, so no
   key of that join is hot; a word in a third of all texts never leaves its task.

The classes of characters are read from the library's own expressions once on the driver (1.1 MB), so
that they are those of its Unicode version.

Nulls and edges: a null text is empty: no bytes, no tokens. Rows with a null or repeated doc_id are
counted each by itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, NUMBER, OTHER, SPACE, HashIndex, code_points, pre_tokens
from .byte_bpe import distinct_words, least_count
from .common import arrow_map, buffers, claim, materialize, range_hash, slices, text_array

#: Words in the broadcast part of the table at most (about 30 bytes each in a worker).
DICTIONARY = 1_500_000
#: Words that the library counts at once.
WORDS_AT_ONCE = 10_000


def added_tokens(path: str) -> list[str]:
    """The strings that count as one token wherever they stand; refuses files whose rules differ from those used here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
    if not plain or model["type"] != "BPE" or model.get("dropout"):
        raise ValueError(f"{path} is no plain byte-level BPE")
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"{path}: the added token {t['content']!r} takes its surroundings into account")
    return sorted((t["content"] for t in spec["added_tokens"]), key=lambda t: (-len(t), t))


@functools.cache
def library_classes() -> np.ndarray:
    """The class of every code point by the library's own expressions."""
    from tokenizers import Regex, pre_tokenizers

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])  # surrogates are in no text
    chars = "".join(map(chr, points.tolist()))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(chars):
            table[points[a:b]] = kind
    return table


def stretches(texts: pa.Array, buf: np.ndarray, offs: np.ndarray, added: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of the texts and of the added tokens in them, in bytes; starts of the added tokens)."""
    find, marks = re.compile(b"|".join(re.escape(a.encode()) for a in added)) if added else None, []
    some = np.zeros(len(texts), bool)
    for a in added:
        some |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
    for t in np.flatnonzero(some).tolist():
        marks += [(offs[t] + m.start(), offs[t] + m.end()) for m in find.finditer(buf[offs[t] : offs[t + 1]].tobytes())]
    at = np.array(marks, np.int64).reshape(-1, 2)
    return np.unique(np.concatenate([offs, at.ravel()])), at[:, 0]


def ordinary(buf: np.ndarray, bounds: np.ndarray, marks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens outside added tokens."""
    cps, at, char_bounds = code_points(buf, bounds)
    starts, ends, _ = pre_tokens(cps, char_bounds, True, table)
    starts, ends = at[starts], at[ends]
    if len(marks):
        stretch = np.searchsorted(bounds, starts, "right") - 1
        keep = ~np.isin(bounds[stretch], marks)
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """a, b (hashes), n, pieces: the library's number of pieces of each distinct pre-token."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        for batch in batches:
            for i in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(i, WORDS_AT_ONCE)
                word = text_array(part.column("word"))
                pieces = [len(e.ids) for e in library.encode_batch(word.to_pylist(), add_special_tokens=False)]
                buf, offs = buffers(word)
                keys = [pa.array(range_hash(buf, offs[:-1], offs[1:], which).view(np.int64)) for which in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, part.column("n"), pa.array(pieces, pa.int32())], ["a", "b", "n", "pieces"])

    return arrow_map(words, step, "a long, b long, n long, pieces int")


def frequencies(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a and b of the distinct words, and for each word of each text: text, word, frequency)."""
    _, first, word = np.unique(a, return_index=True, return_inverse=True)
    if not np.array_equal(b[first][word], b):  # two words share the first hash
        _, first, word = np.unique(np.stack([a, b], 1), axis=0, return_index=True, return_inverse=True)
        word = word.ravel()
    pair, times = np.unique(doc * max(len(first), 1) + word, return_counts=True)
    return a[first], b[first], pair // max(len(first), 1), pair % max(len(first), 1), times


class Counts:
    """Pieces of the broadcast words, found by both hashes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, pieces: np.ndarray):
        self.index, self.b, self.pieces = HashIndex(a), b, pieces

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pieces of each word, or -1 where the table does not have it."""
        at = self.index.find(a)
        out = np.where(at < 0, -1, self.pieces[at] if len(self.pieces) else -1)
        out[(at >= 0) & (self.b[at] != b if len(self.b) else True)] = -1
        return out


_held: list = []  # the broadcast variable last used by this worker, and its index


def _counts(shared) -> Counts:
    if not _held or _held[0] is not shared:
        claim(__name__, _held.clear)
        _held[:] = [shared, Counts(*shared.value)]
    return _held[1]


def _frequent(table: DataFrame, limit: int) -> tuple[int, tuple[np.ndarray, ...]]:
    """The least count of broadcast words, and their hashes and pieces; of words that share the first hash all but one wait for the join."""
    cut = least_count(table, limit)
    rows = table.where(F.col("n") >= cut).select("a", "b", "pieces").toArrow()
    a, first = np.unique(rows["a"].to_numpy().view(np.uint64), return_index=True)
    return cut, (a, rows["b"].to_numpy().view(np.uint64)[first], rows["pieces"].to_numpy()[first])


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row's whole text."""
    spark = docs.sparkSession
    added, classes = added_tokens(path), spark.sparkContext.broadcast(library_classes())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))
        return ordinary(buf, *stretches(texts, buf, offs, added), classes.value)

    table = materialize(piece_counts(distinct_words(docs, spans), path))
    cut, frequent = _frequent(table, dictionary)
    shared = spark.sparkContext.broadcast(frequent)
    counted = materialize(arrow_map(docs, _per_text(shared, added, classes), "doc_id long, at long, n_bytes long, known long, rest array<struct<a:long,b:long,times:long>>"))
    rest = counted.select("at", F.explode("rest").alias("r")).select("at", "r.*")
    others = table.select("a", "b", "pieces")
    sums = rest.join(others, ["a", "b"]).groupBy("at").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return counted.drop("rest").join(sums, "at", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def _per_text(shared, added: list[str], classes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's bytes, tokens by the broadcast words, and the frequencies of the others."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at = _counts(shared), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            texts = text_array(batch.column("text"))
            buf_all, offs_all = buffers(texts)
            for i, j in slices(offs_all):
                buf, offs, n = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i], j - i
                bounds, marks = stretches(texts.slice(i, n), buf, offs, added)
                starts, ends = ordinary(buf, bounds, marks, classes.value)
                which = lambda places: np.searchsorted(offs, places, "right") - 1
                a, b, doc, word, times = frequencies(which(starts), range_hash(buf, starts, ends, 0), range_hash(buf, starts, ends, 1))
                pieces = words.find(a, b)
                met = pieces[word] >= 0
                known = np.bincount(which(marks), minlength=n) + np.bincount(doc[met], times[met] * pieces[word[met]], n).astype(np.int64)
                cuts = np.zeros(n + 1, np.int32)
                np.cumsum(np.bincount(doc[~met], minlength=n), out=cuts[1:])
                rest = pa.StructArray.from_arrays([pa.array(x) for x in (a[word[~met]].view(np.int64), b[word[~met]].view(np.int64), times[~met])], ["a", "b", "times"])
                columns = [batch.column("doc_id").slice(i, n), pa.array(at + np.arange(n)), pa.array(np.diff(offs)), pa.array(known), pa.ListArray.from_arrays(pa.array(cuts), rest)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "n_bytes", "known", "rest"])
                at += n

    return step
