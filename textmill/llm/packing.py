"""Packing of token sequences by non-negative least squares.

1. *Tokens.* Each text is encoded with a word-level BPE vocabulary and closed by an end id.
   Distinct words are encoded once per worker (vectorised merges) and kept in a bounded
   cache, found by a hash and compared byte by byte. The first floor(n / window) x window ids of a document fill sequences of their
   own; what is left, its tail, is to be packed. Only lengths and checksums leave the task.
2. *Plan* (driver, size set by the window alone). The histogram of tail lengths has at most
   window-1 bars. Combinations of two or three lengths that fill a window exactly are
   enumerated; non-negative least squares finds how often to use each so that together they
   use up the histogram; the counts are rounded down; what remains is packed greedily,
   largest first, again as combinations with counts.
3. *Places.* The r-th tail of a length takes the r-th place that the plan has for this
   length. Ranks come from bucket counts and a running sum, so a length that a third of
   all documents share is never gathered in one task.

Nulls and edges: a null or empty text is the end id alone; repeated rows and null doc_ids
are packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import UNASSIGNED, Words, classes, code_points, load_merges, pre_tokens
from .common import LOWER, arrow_map, buffers, claim, eights, materialize, range_hash, ranges, slices, text_array
from .sharding import with_slots

WINDOW = 2048
END_ID = 1
#: Words that a worker's cache holds; it starts anew beyond that.
CACHE_WORDS = 500_000
#: Triples enumerated for each greatest length.
TRIPLES = 4
#: Hex digits of the hash by which a length's ranks are dealt (256 buckets).
RANK_DIGITS = 2

# ------------------------------------------------------------------ tokens

_state: dict[str, tuple] = {}


def _tokenizer(path: str):
    """(tokenizer, merges, word cache, its special strings), once per worker."""
    if path not in _state:
        from tokenizers import Tokenizer

        claim(__name__, _state.clear)
        tok = Tokenizer.from_file(path)
        special = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()) or "(?!)")
        _state[path] = tok, load_merges(path), _no_words(), special
    return _state[path]


def _no_words() -> Words:
    return Words(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64))


def _normal(text: str) -> str:
    """NFC and lower case by code point (a final sigma is no exception)."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def encode_block(buf: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts without end ids, offset of each text's ids)."""
    tok, merges, words, special = _tokenizer(path)
    apart: dict[int, list[int]] = {}
    raw = buf.tobytes()
    if special.search(raw.decode("utf-8", "replace")) or (len(buf) and buf.max() >= 128):
        parts = []
        for t, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            part = raw[a:b]
            text = part.decode("utf-8")
            if special.search(text) or (not part.isascii() and (classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == UNASSIGNED).any()):
                apart[t] = tok.encode(text, add_special_tokens=False).ids
                part = b""
            elif not part.isascii():
                part = _normal(text).encode()
            parts.append(part)
        offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        buf = np.frombuffer(b"".join(parts), np.uint8)
    buf = LOWER[buf]
    cps, at, char_offs = code_points(buf, offs)
    starts, ends, _ = pre_tokens(cps, char_offs, False)
    word_offs = np.searchsorted(starts, char_offs)
    starts, ends = at[starts], at[ends]
    keys, size, view = range_hash(buf, starts, ends), ends - starts, eights(buf)
    while True:
        found = words.index.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            if len(words.index.keys) + len(fresh) > CACHE_WORDS and len(words.index.keys):
                words = _no_words()
                _state[path] = tok, merges, words, special
                continue
            at = new[first]
            ids, counts = merges.encode(buf, starts[at], ends[at])
            words.add(fresh, ids, counts, buf[ranges(starts[at], size[at])], size[at])
            found = words.index.find(keys)
        other = ~words.same(found, view, starts, size)
        if not other.any():
            break
        keys[other] += np.uint64(1)  # another word has this hash
    ids, cut = words.gather(found)
    cut = cut[word_offs]
    if apart:
        lists = [np.array(apart[t], np.int32) if t in apart else ids[cut[t] : cut[t + 1]] for t in range(len(offs) - 1)]
        ids, cut = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return ids, cut


def document_tokens(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, doc_tokens, checksums of the full windows, length and checksum of the tail."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf_all, offs_all = buffers(text_array(batch.column("text")))
            for i, j in slices(offs_all):
                ids, cut = encode_block(buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i], path)
                total, full, tail_len, tail_crc = [], [], [], []
                for t in range(j - i):
                    own = np.append(ids[cut[t] : cut[t + 1]], end_id).astype("<u4")
                    whole = len(own) // window * window
                    total.append(len(own))
                    full.append([zlib.crc32(own[k : k + window]) for k in range(0, whole, window)])
                    tail_len.append(len(own) - whole)
                    tail_crc.append(zlib.crc32(own[whole:]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(total, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(tail_len, pa.int32()), pa.array(tail_crc, pa.int64())],
                    ["doc_id", "doc_tokens", "full", "tail_len", "tail_crc"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(docs, step, "doc_id long, doc_tokens long, full array<long>, tail_len int, tail_crc long")


# ------------------------------------------------------------------ the plan


def combinations(have: np.ndarray, window: int) -> np.ndarray:
    """Rows of two or three lengths (0 for none) out of `have` that sum to the window."""
    present = np.zeros(window + 1, bool)
    present[have] = True
    a = have[(have * 2 >= window) & (have < window)]
    a = a[present[window - a]]
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    triples = []
    for big in have[(have * 3 >= window) & (have < window - 1)]:
        rest = window - big
        mid = have[(have * 2 >= rest) & (have <= min(big, rest - 1))]
        mid = mid[present[rest - mid]]
        if len(mid):
            mid = np.unique(mid[np.linspace(0, len(mid) - 1, TRIPLES).astype(int)])
            triples.append(np.stack([np.full(len(mid), big), mid, rest - mid], 1))
    return np.concatenate([pairs, *triples]) if len(pairs) or triples else np.zeros((0, 3), np.int64)


def nnls(combos: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, A's columns the combinations (accelerated projected gradient)."""
    size = len(target)

    def apply(x):
        out = np.zeros(size)
        for k in range(3):
            out += np.bincount(combos[:, k], x, size)
        out[0] = 0
        return out

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[combos].sum(1)

    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'A
        v = back(apply(v))
        norm = np.linalg.norm(v)
        if norm == 0:
            return np.zeros(len(combos))
        v /= norm
    x = y = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(apply(y) - target) / (norm * 1.01), 0)
        later = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = new + (momentum - 1) / later * (new - x)
        x, momentum = new, later
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(count, {length: how often}) combinations that use up the histogram exactly."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[int, dict[int, int]]] = []

    def use(n: int, items: dict[int, int]) -> None:
        for length, m in items.items():
            left[length] -= n * m
        out.append((int(n), items))

    combos = combinations(np.flatnonzero(left), window)
    if len(combos):
        repeat = np.floor(nnls(combos, left.astype(float)) + 1e-6).astype(np.int64)
        for c in np.argsort(-repeat, kind="stable"):
            if repeat[c] <= 0:
                break
            lengths, often = np.unique(combos[c][combos[c] > 0], return_counts=True)
            n = min(int(repeat[c]), int((left[lengths] // often).min()))
            if n > 0:
                use(n, dict(zip(lengths.tolist(), often.tolist(), strict=True)))
    while (have := np.flatnonzero(left)).size:  # greedily: the largest, then always the largest that fits
        items: dict[int, int] = {}
        room = window
        while True:
            fit = have[: np.searchsorted(have, room, "right")]
            if not len(fit):
                break
            length = int(fit[-1])
            n = int(min(room // length, left[length] - items.get(length, 0)))
            if n <= 0:
                have = have[have != length]
                continue
            items[length] = items.get(length, 0) + n
            room -= n * length
            have = have[have != length]
        use(int(min(left[k] // m for k, m in items.items())), items)
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, count, first sequence, offset): the plan by length."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for n, items in patterns:
        at = 0
        for length, m in sorted(items.items(), reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, first + n * m, n, base, at))
            used[length] = first + n * m
            at += length * m
        base += n
    return rows


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece."""
    spark = docs.sparkSession
    docs = materialize(document_tokens(docs, path, window, end_id))
    tails = docs.where("tail_len > 0").select("doc_id", "doc_tokens", "tail_len", "tail_crc")
    histogram = {r["tail_len"]: r["count"] for r in tails.groupBy("tail_len").count().collect()}  # at most window-1 rows
    patterns = plan(histogram, window)
    table = spark.createDataFrame(places(patterns), "tail_len int, first long, stop long, n long, base long, at long")
    ranked = with_slots(tails, "tail_len", ["doc_id", "doc_tokens", "tail_crc"], RANK_DIGITS)
    step = F.col("slot") - F.col("first")
    packed = (
        ranked.join(F.broadcast(table), "tail_len")  # a few rows for each length below the window
        .where("slot >= first and slot < stop")
        .select(
            "doc_id",
            (F.col("doc_tokens") - F.col("tail_len")).alias("start"),
            F.col("tail_len").cast("long").alias("length"),
            F.col("tail_crc").alias("ids_crc32"),
            "doc_tokens",
            (F.col("base") + step % F.col("n")).alias("sequence_id"),
            (F.col("at") + F.floor(step / F.col("n")) * F.col("tail_len")).cast("long").alias("offset"),
        )
    )
    whole = docs.where(F.size("full") > 0).withColumn("b", F.pmod(F.xxhash64("doc_id", "doc_tokens", "tail_crc"), F.lit(4096)))
    sums = whole.groupBy("b").agg(F.sum(F.size("full")).alias("m"))
    before = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))  # at most 4096 rows
    inside = Window.partitionBy("b").orderBy("doc_id", "doc_tokens", "tail_crc").rowsBetween(Window.unboundedPreceding, -1)
    full = (
        whole.withColumn("mine", F.coalesce(F.sum(F.size("full")).over(inside), F.lit(0)))
        .join(F.broadcast(sums), "b")
        .select("doc_id", "doc_tokens", "base", "mine", F.posexplode("full").alias("p", "ids_crc32"))
        .select(
            "doc_id",
            (F.col("p") * window).cast("long").alias("start"),
            F.lit(window).cast("long").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.lit(sum(n for n, _ in patterns)) + F.col("base") + F.col("mine") + F.col("p")).cast("long").alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    return packed.unionByName(full)
