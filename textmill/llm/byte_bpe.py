"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Every text is cut into pre-tokens with their positions (vectorised, one task a block
   of texts). Each task sends its distinct pre-tokens and their counts, not the
   occurrences, so a word in a third of all texts is one row per task.
2. The distinct words of the whole corpus meet in a shuffle; each is encoded once and
   written as a table (word, ids).
3. The ids are joined back to the occurrences and put together by position. The joined
   table is broadcast and holds the words that occur at least `cut` times, the least
   cut (2 or more) that leaves at most DICTIONARY words, so its size has a fixed bound
   whatever the corpus. Words outside it are encoded where they stand, once per block:
   for a word that occurs once that is the only time.
4. Decoding joins the table of the tokens' bytes (one entry per token of the vocabulary).

Words are looked up by 64-bit hashes; as the decoded bytes are compared with the text
anyway, a text whose decoding differs (a hash collision) is encoded again by itself.
Texts with unassigned code points are left to the tokenizer's own pattern.

Nulls and edges: a null text is empty, an empty text has no ids; ids of rows with a null
or repeated doc_id are computed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import UNASSIGNED, Words, classes, code_points, load_ranks, pre_tokens
from .common import arrow_map, buffers, claim, materialize, range_hash, ranges, slices, take_spans, text_array

#: Words in the broadcast dictionary at most (about 25 bytes each).
DICTIONARY = 1_500_000
#: Distinct words that a task holds before it sends them on.
HELD = 1_500_000

_encodings: dict = {}


def encoding(path: str):
    """(tiktoken encoding, token bytes one after another, their offsets), once per worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        ranks = load_ranks(path)
        enc = tiktoken.Encoding("textmill", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        offs = np.concatenate([[0], np.cumsum([len(t) for t in table])])
        _encodings[path] = enc, np.frombuffer(b"".join(table), np.uint8), offs
    return _encodings[path]


# ------------------------------------------------------------------ distinct words


class Distinct:
    """Distinct words of many blocks with their counts, held as arrays."""

    def __init__(self):
        self.keys, self.counts, self.words = [], [], []
        self.size = 0

    def add(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        keys, first, counts = np.unique(range_hash(buf, starts, ends), return_index=True, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.words.append(take_spans(buf, starts[first], ends[first]))
        self.size += len(keys)

    def merge(self) -> None:
        keys, first, inverse = np.unique(np.concatenate(self.keys), return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.words = [pa.concat_arrays(self.words).take(pa.array(first))]
        self.keys, self.counts, self.size = [keys], [counts], len(keys)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.merge()
            for i in range(0, self.size, 50_000):
                yield pa.RecordBatch.from_arrays([self.words[0].slice(i, 50_000), pa.array(self.counts[0][i : i + 50_000])], ["word", "n"])
        self.__init__()


def distinct_words(docs: DataFrame, spans: Callable) -> DataFrame:
    """word, n over all texts; spans(bytes, offsets) gives byte starts and ends."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tidy = Distinct(), 0
        for batch in batches:
            buf_all, offs_all = buffers(text_array(batch.column("text")))
            for i, j in slices(offs_all):
                buf = buf_all[offs_all[i] : offs_all[j]]
                seen.add(buf, *spans(buf, offs_all[i : j + 1] - offs_all[i]))
                if seen.size > 2 * tidy + 500_000:
                    seen.merge()
                    tidy = seen.size
                if seen.size > HELD:
                    yield from seen.batches()
                    tidy = 0
        yield from seen.batches()

    return arrow_map(docs.select("text"), step, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(words: DataFrame, limit: int, least: int = 2) -> int:
    """The least count of at least `least` such that at most `limit` words have it or more."""
    steps = words.where(F.col("n") >= least).groupBy("n").count().collect()  # counts of words differ in at most sqrt(2 x tokens) values
    total, cut = 0, 1 << 62
    for row in sorted(steps, key=lambda r: -r["n"]):
        total += row["count"]
        if total > limit:
            break
        cut = row["n"]
    return cut


def spans_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cps, at, char_offs = code_points(buf, offs)
    starts, ends, _ = pre_tokens(cps, char_offs, True)
    return at[starts], at[ends]


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """word, n, ids: each distinct word encoded once."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path)[0].encode_ordinary
        for batch in batches:
            ids = [encode(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return arrow_map(words, step, "word string, n long, ids array<int>")


def dictionary(words: DataFrame, limit: int = DICTIONARY) -> dict[str, np.ndarray]:
    """hash, ids and offsets of the words that are frequent enough to be broadcast."""
    table = words.where(F.col("n") >= least_count(words, limit)).select("word", "ids").toArrow()
    buf, offs = buffers(text_array(table["word"]))
    keys, first = np.unique(range_hash(buf, offs[:-1], offs[1:]), return_index=True) if len(offs) > 1 else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    ids = table["ids"].combine_chunks()
    flat = ids.flatten().to_numpy().astype(np.int32) if len(ids) else np.zeros(0, np.int32)
    at = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]) if len(ids) else np.zeros(1, np.int64)
    counts = np.diff(at)[first]
    return {"keys": keys, "ids": flat[ranges(at[:-1][first], counts)], "offs": np.concatenate([[0], np.cumsum(counts)])}


_words: list = []  # the broadcast variable last used by this worker, and its index


def _held(shared) -> Words:
    """The broadcast dictionary's index, built once per worker."""
    if not _words or _words[0] is not shared:
        claim(__name__, _words.clear)
        v = shared.value
        _words[:] = [shared, Words(v["keys"], v["ids"], v["offs"], np.zeros(0, np.uint8), np.zeros(1, np.int64))]  # decoding compares the bytes
    return _words[1]


# ------------------------------------------------------------------ encoding and decoding


def encode_block(buf: np.ndarray, offs: np.ndarray, words: Words, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offset of each text's ids)."""
    enc = encoding(path)[0]
    cps, at, char_offs = code_points(buf, offs)
    starts, ends, _ = pre_tokens(cps, char_offs, True)
    token_offs = np.searchsorted(starts, char_offs)
    starts, ends = at[starts], at[ends]
    keys = range_hash(buf, starts, ends)
    found = words.index.find(keys)
    counts = np.zeros(len(keys), np.int64)
    known = found >= 0
    counts[known] = (words.offs[1:] - words.offs[:-1])[found[known]] if known.any() else 0
    rare_keys, first, inverse = np.unique(keys[~known], return_index=True, return_inverse=True)
    lone = np.flatnonzero(~known)[first]
    rare = [enc.encode_ordinary(w) for w in take_spans(buf, starts[lone], ends[lone]).to_pylist()]
    rare_len = np.array([len(r) for r in rare], np.int64)
    counts[~known] = rare_len[inverse] if len(rare) else 0
    out_offs = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(out_offs[-1], np.int32)
    out[ranges(out_offs[:-1][known], counts[known])] = words.gather(found[known])[0]
    if len(rare):
        flat = np.array([i for r in rare for i in r], np.int32)
        begin = np.concatenate([[0], np.cumsum(rare_len)])[:-1][inverse]
        out[ranges(out_offs[:-1][~known], counts[~known])] = flat[ranges(begin, counts[~known])]
    return out, out_offs[token_offs]


def decode_ids(ids: np.ndarray, path: str) -> np.ndarray:
    """The bytes of the ids' tokens, one after another."""
    _, data, offs = encoding(path)
    return data[ranges(offs[ids], offs[ids + 1] - offs[ids])]


def encode_documents(docs: DataFrame, path: str, keep: str = "ids") -> DataFrame:
    """doc_id and ids (keep='ids'), or doc_id, n_tokens and the digests of ids and decoded bytes (keep='digest')."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = materialize(encode_words(distinct_words(docs, spans_of), path))
    shared = spark.sparkContext.broadcast(dictionary(words))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(shared)
        enc, data, table_offs = encoding(path)
        for batch in batches:
            texts = text_array(batch.column("text"))
            buf_all, offs_all = buffers(texts)
            for i, j in slices(offs_all):
                buf, offs = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
                ids, cut = encode_block(buf, offs, held, path)
                size = table_offs[ids + 1] - table_offs[ids]
                plain = data[ranges(table_offs[ids], size)]
                ends = np.concatenate([[0], np.cumsum(size)])[cut]
                cps, _, char_offs = code_points(buf, offs)
                odd = np.concatenate([[0], np.cumsum(classes()[cps] == UNASSIGNED)])[char_offs]
                lists, decoded = [], []
                for t in range(j - i):
                    own, back, text = ids[cut[t] : cut[t + 1]], plain[ends[t] : ends[t + 1]], buf[offs[t] : offs[t + 1]]
                    if odd[t + 1] > odd[t] or len(back) != len(text) or not np.array_equal(back, text):
                        own = np.array(enc.encode_ordinary(text.tobytes().decode()), np.int32)
                        back = decode_ids(own, path)
                    lists.append(own)
                    decoded.append(back)
                head = batch.column("doc_id").slice(i, j - i)
                if keep == "ids":
                    offs_out = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([head, pa.ListArray.from_arrays(pa.array(offs_out), pa.array(np.concatenate(lists)))], ["doc_id", "ids"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [
                            head,
                            pa.array([len(x) for x in lists], pa.int64()),
                            pa.array([hashlib.sha256(np.ascontiguousarray(x, "<u4")).hexdigest() for x in lists]),
                            pa.array([hashlib.sha256(np.ascontiguousarray(x)).hexdigest() for x in decoded]),
                        ],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )

    schema = "doc_id long, ids array<int>" if keep == "ids" else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(docs, step, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(np.asarray(x, np.int64), path).tobytes().decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), step, "doc_id long, text string")
