"""Scoring of texts with a probabilistic suffix tree over tokens.

*Symbols.* The COMMON most frequent training tokens are symbols of their own, the end of a
text is one, and all other tokens share CLASSES symbols by a hash of their last two bytes
(endings tell language and word kind). A token's probability is that of its symbol in
its context, times, for a class symbol, the token's share of the class. The share is
(c - d) / C for a token seen c times, and d V / C for the unknown token of the class (C, V: the
class's tokens and distinct tokens, d the discount). So tokens never seen in training
are one symbol a class, as the base formula's V + 1 has one symbol for them.

*Contexts.* A context is the 1 to DEPTH symbols before a token; a text begins with an end
symbol. A context is a candidate if it was seen SEEN times, and is retained if its
next-symbol distribution diverges from its parent's (the context without its first
symbol) by leave-one-out: each sighting's next symbol is foretold from the context's other
sightings, mixed with the parent as in scoring, and once from the parent alone; the log
likelihoods have to differ by DIVERGENCE nats for each distinct next symbol. (The plain
n KL(context | parent) counts a sighting as evidence for itself and retains contexts that
were merely seen a few times.)
Nothing else decides, so the retained contexts grow with the corpus. Those of one symbol are
a square of counts; the others are one table, written once. Workers hold those behind the pairs
that most places need for their size, at most ENTRIES next-symbol counts; the places of texts
behind other pairs are, distinct per text, joined with the table. Scores do not depend on ENTRIES.

*Smoothing.* Each retained distribution is mixed with that of its longest retained suffix by Witten
and Bell's weights, (n + k P_parent) / (N + k) with k distinct next symbols, down to the root,
which is add-one smoothed. A token is scored in the state of the longest retained suffix.

All counts come from all training texts. Tasks send distinct tokens and counts; the
tokens of the corpus are one table, written once, with counts and shares. When a text is
scored, frequent tokens are looked up in a broadcast table of at most LOOKED_UP tokens; the
others, distinct per text, are joined with the whole table.

Nulls and edges: a null or empty text is its end alone; a null doc_id counts as the empty
string (a training text by default); rows that repeat a doc_id are scored one by one; with
no training token every symbol is equally likely; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import HashIndex
from .byte_bpe import Distinct, least_count
from .common import LOWER, arrow_map, buffers, give_back, list_array, long_list, materialize, range_hash, ranges, slices, take_spans, text_array, word_spans

COMMON, CLASSES = 2000, 509
DEPTH = 3
SEEN = 32
DIVERGENCE = 1.0
ENTRIES = 3_000_000
#: Training tokens a bucket of contexts.
BUCKET = 400_000
#: Marks of contexts: 2^MARKS bits.
MARKS = 23
DISCOUNT = 0.75
LOOKED_UP = 250_000
#: Symbols: the end, the classes, the common tokens. BITS hold one, or more bits where symbols are more.
END, BITS = 0, 12


def bits_for(size: int, depth: int = DEPTH) -> int:
    """The bits of each of `size` symbols; a context, its next symbol and a leading 1 have to fit a signed long."""
    bits = max(BITS, (size - 1).bit_length())
    if 1 + (depth + 1) * bits > 63:
        raise ValueError(f"{size} symbols: contexts of {depth} don't fit 64 bits")
    return bits


def held_out(col: str = "doc_id", parts: int = 7, part: int = 2):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % parts == part


# ------------------------------------------------------------------ tokens

#: What a worker holds for its stage: the pair counts, and the tools of scoring.
_square: list = []
_held: list = []


def _forget() -> None:
    """Drop what an earlier call left in this worker."""
    if _square or _held:
        _square.clear()
        _held.clear()
        give_back()



def token_counts(docs: DataFrame) -> DataFrame:
    """word, n, class: every distinct word of all texts with its count in the training texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        sides = {True: Distinct(), False: Distinct()}
        tidy = {True: 0, False: 0}

        def send(held: bool) -> Iterator[pa.RecordBatch]:
            for b in sides[held].batches():
                yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(np.zeros(len(b), np.int64)) if held else b.column("n")], ["word", "n"])
            tidy[held] = 0

        for batch in batches:
            mask = batch.column("held_out")
            for held in (False, True):
                part = batch.filter(mask if held else pa.compute.invert(mask))
                buf_all, offs_all = buffers(text_array(part.column("text")))
                for i, j in slices(offs_all):
                    buf = LOWER[buf_all[offs_all[i] : offs_all[j]]]
                    starts, ends, _ = word_spans(buf, offs_all[i : j + 1] - offs_all[i])
                    side = sides[held]
                    side.add(buf, starts, ends)
                    if side.size > 2 * tidy[held] + 400_000:
                        side.merge()
                        tidy[held] = side.size
                    if side.size > 1_000_000:
                        yield from send(held)
        for held in (False, True):
            yield from send(held)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffers(text_array(batch.column("word")))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(_class(buf, offs[:-1], offs[1:]).astype(np.int32))], ["word", "n", "class"])

    counted = arrow_map(docs.select("held_out", "text"), step, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return arrow_map(counted, classed, "word string, n long, class int")


def _class(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class symbol of every word (of at least one byte)."""
    last = buf[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, buf[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return 1 + (before * 257 + last) * 40503 % 65521 % CLASSES


class Symbols:
    """Maps the words of texts to symbols."""

    def __init__(self, common: np.ndarray):
        self.index = HashIndex(common)
        self.size = 1 + CLASSES + len(common)

    def of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        found = self.index.find(range_hash(buf, starts, ends) if keys is None else keys)
        return np.where(found >= 0, 1 + CLASSES + found, _class(buf, starts, ends) if len(starts) else found)


def sequences(sym: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) with an end symbol before and after every text."""
    offs = np.concatenate([[0], np.cumsum(np.diff(wo) + 2)])
    out = np.full(offs[-1], END, np.uint64)
    out[ranges(offs[:-1] + 1, np.diff(wo))] = sym
    return out, offs


def contexts(sym: np.ndarray, offs: np.ndarray, length: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(positions, codes) of the symbols that have `length` symbols before them; a code packs those below a leading 1."""
    at = np.flatnonzero(np.arange(len(sym)) - np.repeat(offs[:-1], np.diff(offs)) >= max(length, 1))
    code = np.ones(len(at), np.uint64)
    for k in range(length, 0, -1):
        code = code << np.uint64(bits) | sym[at - k]
    return at, code


def shorter(code: np.ndarray, length: int, bits: int = BITS) -> np.ndarray:
    """The codes without their first symbol."""
    return code & np.uint64((1 << bits * (length - 1)) - 1) | np.uint64(1 << bits * (length - 1))


def _mix(code: np.ndarray, nxt: np.ndarray | None = None) -> np.ndarray:
    h = code * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    if nxt is not None:
        h = (h + nxt.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


# ------------------------------------------------------------------ the tree


def pair_counts(docs: DataFrame, common, size: int) -> np.ndarray:
    """How often each symbol (column) follows each other (row) in the training texts: size x size counts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        symbols, n = Symbols(common.value), np.zeros(size * size, np.int64)
        for batch in batches:
            for sym, offs in blocks(batch, symbols):
                at, code = contexts(sym, offs, 1, 31)
                np.add.at(n, (code & np.uint64((1 << 31) - 1)).astype(np.int64) * size + sym[at].astype(np.int64), 1)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(n[at[i : i + 100_000]])], ["pair", "n"])

    rows = arrow_map(docs.where("not held_out").select("text"), step, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most size^2 rows
    n = np.zeros(size * size, np.int64)
    n[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return n.reshape(size, size)


def blocks(batch: pa.RecordBatch, symbols: Symbols) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    buf_all, offs_all = buffers(text_array(batch.column("text")))
    for i, j in slices(offs_all):
        buf = LOWER[buf_all[offs_all[i] : offs_all[j]]]
        starts, ends, wo = word_spans(buf, offs_all[i : j + 1] - offs_all[i])
        yield sequences(symbols.of(buf, starts, ends), wo)


def _pairs(shared) -> tuple[np.ndarray, np.ndarray]:
    """The pair counts and their sums by first symbol, unpacked once per worker: a broadcast is a file in every process, and most counts are 0."""
    if not _square or _square[0] is not shared:
        size, data = shared.value
        n = np.frombuffer(zlib.decompress(data), np.int64).reshape(size, size)
        _square[:] = [shared, (n, n.sum(axis=1))]
    return _square[1]


def gram_counts(docs: DataFrame, common, pairs, bits: int, buckets: int) -> DataFrame:
    """bucket, grams, n: the symbols of training places behind their contexts, packed below a leading 1; a task sends one row for each bucket, its grams in order as differences.

    A gram has three symbols before the last, or two where the first two are a pair (or the text
    begins) that is seen too rarely to be in a context; no gram where the last two before it are.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, often = Symbols(common.value), _pairs(pairs)[0] >= SEEN
        keys, counts, size, tidy = [], [], 0, 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)

        def send(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = (_mix(k >> np.uint64(bits) & np.uint64((1 << 2 * bits) - 1)) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            bucket, k, n = bucket[order], k[order].view(np.int64), n[order]
            names, first = np.unique(bucket, return_index=True)
            steps = np.diff(k, prepend=0)
            steps[first] = k[first]
            cut = np.append(first, len(k))
            for i in range(0, len(names), 200):
                j = min(i + 200, len(names))
                rows = slice(cut[i], cut[j])
                yield pa.RecordBatch.from_arrays([pa.array(names[i:j].astype(np.int32)), long_list(steps[rows], cut[i : j + 1] - cut[i]), list_array(n[rows].astype(np.int32), cut[i : j + 1] - cut[i])], ["bucket", "grams", "n"])

        for batch in batches:
            for sym, offs in blocks(batch, symbols):
                at, code = contexts(sym, offs, 2, bits)
                s = sym.astype(np.int64)
                keep = often[s[at - 2], s[at - 1]]
                at, code = at[keep], code[keep]
                first = s[at - 3]
                whole = (at - np.repeat(offs[:-1], np.diff(offs))[at] >= 3) & often[first, s[at - 2]]
                wide = code & np.uint64((1 << 2 * bits) - 1) | first.astype(np.uint64) << np.uint64(2 * bits) | np.uint64(1 << 3 * bits)
                k, n = np.unique(np.where(whole, wide, code) << np.uint64(bits) | sym[at], return_counts=True)
                keys.append(k)
                counts.append(n)
                size += len(k)
                if size > 2 * tidy + 500_000:
                    k, n = merge()
                    keys, counts, size, tidy = [k], [n], len(k), len(k)
                if size > 1_500_000:
                    yield from send(k, n)
                    keys, counts, size, tidy = [], [], 0, 0
        if size:
            yield from send(*merge())

    return arrow_map(docs.where("not held_out").select("text"), step, "bucket int, grams array<long>, n array<int>")


def diverging(code: np.ndarray, n: np.ndarray, up_n: np.ndarray, up_total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by context: whether the context is retained, and its total."""
    if not len(code):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    lead = np.ones(len(code), bool)
    lead[1:] = code[1:] != code[:-1]
    at = np.flatnonzero(lead)
    kinds = np.diff(np.append(at, len(code)))
    total = np.repeat(np.add.reduceat(n, at), kinds)
    # each sighting is foretold by the others, mixed with the parent as in scoring
    others, parent = np.repeat(kinds, kinds) - (n == 1), up_n / up_total
    with np.errstate(divide="ignore", invalid="ignore"):  # one sighting alone has no others; it is no candidate
        gain = np.add.reduceat(n * np.log((n - 1 + others * parent) / ((total - 1 + others) * parent)), at)
    return (total >= SEEN) & np.repeat(gain >= DIVERGENCE * kinds, kinds), total


def _bucket(middle, tokens: int):
    """Contexts of two and three symbols meet by their last two, in buckets whose number grows with the corpus."""
    return F.pmod(F.xxhash64(middle), F.lit(1 + tokens // BUCKET)).cast("int")


def grow(docs: DataFrame, common, root: np.ndarray) -> tuple[tuple[int, bytes], np.ndarray, DataFrame]:
    """The pair counts (size, compressed), which single symbols are retained, and code, next, n of all longer retained contexts as a written table, with `worth`: the places that need the pair behind a context, over the counts behind it."""
    spark, size, bits = docs.sparkSession, len(root), bits_for(len(root))
    pairs = pair_counts(docs, common, size)
    single, total = np.zeros(size, bool), max(int(root.sum()), 1)
    for c in range(size):
        nxt = np.flatnonzero(pairs[c])
        if len(nxt):
            single[c] = diverging(np.full(len(nxt), c), pairs[c, nxt], root[nxt], total)[0][0]
    packed = (size, zlib.compress(pairs.tobytes(), 1))
    del pairs
    give_back()
    shared = spark.sparkContext.broadcast(packed)
    mask = (1 << bits) - 1

    def step(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())  # as in arrow_map
        give_back()
        held, sums = _pairs(shared)
        lists = table["grams"].combine_chunks()
        steps, size_of = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        begin = np.cumsum(size_of) - size_of
        total_ = np.cumsum(steps)  # differences, and whole grams where a row begins
        gram = total_ - np.repeat(total_[begin] - steps[begin], size_of)
        gram, inverse = np.unique(gram, return_inverse=True)
        n = np.bincount(inverse, table["n"].combine_chunks().flatten().to_numpy(), len(gram)).astype(np.int64)
        wide = gram >= 1 << 4 * bits
        low, inverse = np.unique(np.where(wide, gram & (1 << 3 * bits) - 1 | 1 << 3 * bits, gram), return_inverse=True)
        low_n = np.bincount(inverse, n, len(low)).astype(np.int64)
        last = low >> bits & mask
        keep, low_total = diverging(low >> bits, low_n, held[last, low & mask], sums[last])
        inverse, gram, n = inverse[wide], gram[wide], n[wide]
        keep3, _ = diverging(gram >> bits, n, low_n[inverse], low_total[inverse])
        gram, n = np.concatenate([low[keep], gram[keep3]]), np.concatenate([low_n[keep], n[keep3]])
        freq = held[gram >> 2 * bits & mask, gram >> bits & mask]
        _, of, size = np.unique(gram >> bits & (1 << 2 * bits) - 1, return_inverse=True, return_counts=True)  # all counts behind a pair are in one bucket
        return pa.table([gram >> bits, (gram & mask).astype(np.int16), n, freq / size[of]], ["code", "next", "n", "worth"])

    grams = gram_counts(docs, common, shared, bits, 1 + total // BUCKET)  # summed by tasks, and again in the buckets
    kept = materialize(grams.groupBy("bucket").applyInArrow(step, "code long, next short, n long, worth double"))
    shared.destroy()
    return packed, single, kept


class Table:
    """Places of 64-bit hashes: buckets by their first bits, and 32 bits of each in its bucket. About five bytes a hash.

    Hashes that share these 50 bits or more are one: a hash that the table does not have is taken for one of its own with a
    chance of entries / 2^50, at 5 million entries about 4 in 10^9 lookups.
    """

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.low, self.first = low, first
        self.shift = np.uint64(64 - (len(first) - 1).bit_length() + 1)

    @classmethod
    def of(cls, keys: np.ndarray) -> tuple[Table, np.ndarray]:
        """(the table, the order of the keys in it)"""
        bits = max(1, (len(keys) // 4).bit_length())
        order = np.argsort(keys)
        keys = keys[order]
        first = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return cls(keys.astype(np.uint32), first), order

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted hash, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        bucket, low = (wanted >> self.shift).astype(np.int64), wanted.astype(np.uint32)
        at, end = self.first[bucket].astype(np.int64), self.first[bucket + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.low[at[todo]] == low[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


class Tree:
    """Retained contexts with smoothed next-symbol probabilities."""

    def __init__(self, root: np.ndarray, code: np.ndarray, nxt: np.ndarray, n: np.ndarray, depth: int = DEPTH, first: np.ndarray | None = None):
        """first: what follows each symbol, with the probabilities of the contexts of one symbol (which are then not among the codes)."""
        if len(code) and not (code[1:] >= code[:-1]).all():
            order = np.argsort(code, kind="stable")
            code, nxt, n = code[order], nxt[order], n[order]
            del order
        n = n.astype(np.float64)
        lead = np.ones(len(code), bool)
        lead[1:] = code[1:] != code[:-1]
        at = np.flatnonzero(lead)
        kinds = np.diff(np.append(at, len(code)))
        total = np.add.reduceat(n, at) if len(at) else np.zeros(0)
        state, state_order = Table.of(_mix(code[at]))
        edge, edge_order = Table.of(_mix(code, nxt))
        share, value = (kinds / (total + kinds))[state_order], (n / np.repeat(total + kinds, kinds))[edge_order]
        self._hold(root, depth, first, (state.low, state.first, share, edge.low, edge.first, value))

    def _hold(self, root: np.ndarray, depth: int, first: np.ndarray | None, parts: tuple) -> None:
        self.root, self.depth, self.bits = (root + 1.0) / (root.sum() + len(root)), depth, bits_for(len(root), depth)
        self.first, self.parts = first, parts
        self.state, self.share, self.edge, self.value = Table(*parts[:2]), parts[2], Table(*parts[3:5]), parts[5]

    @classmethod
    def of_parts(cls, root: np.ndarray, parts: tuple, first: np.ndarray) -> Tree:
        """A tree that another process has built: its arrays as they came."""
        tree = cls.__new__(cls)
        tree._hold(root, DEPTH, first, parts)
        return tree

    def refine(self, p: np.ndarray, at: np.ndarray, code: np.ndarray, nxt: np.ndarray) -> None:
        """What the retained ones of the contexts `code` say of the next symbols, mixed into p[at]."""
        s = self.state.find(_mix(code))
        known = s >= 0
        at, code, s = at[known], code[known], s[known]
        e = self.edge.find(_mix(code, nxt[known]))
        own = np.where(e >= 0, self.value[e], 0.0) if len(self.value) else np.zeros(len(at))
        p[at] = own + self.share[s] * p[at]

    def begin(self, sym: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Every symbol's probability after at most one symbol, as far as `first` has it."""
        p = self.root[sym.astype(np.int64)]
        if self.first is not None:
            at, _ = contexts(sym, offs, 1, self.bits)
            p[at] = self.first[sym[at - 1].astype(np.int64), sym[at].astype(np.int64)]
        return p

    def log10(self, sym: np.ndarray, offs: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
        """log10 of every symbol's probability in its place (0 for the end symbols that begin texts)."""
        p = self.begin(sym, offs) if p is None else p
        for length in range(1 if self.first is None else 2, self.depth + 1):  # each longer retained context refines what the shorter ones say
            at, code = contexts(sym, offs, length, self.bits)
            self.refine(p, at, code, sym[at])
        p[offs[:-1]] = 1.0
        return np.log10(p)


# ------------------------------------------------------------------ scores

def after_one(root: np.ndarray, packed: tuple[int, bytes], single: np.ndarray) -> np.ndarray:
    """Each symbol's (column's) probability after each other one (row)."""
    pairs = np.frombuffer(zlib.decompress(packed[1]), np.int64).reshape(packed[0], packed[0])
    p = np.tile((root + 1.0) / (root.sum() + len(root)), (len(root), 1))
    for c in np.flatnonzero(single):
        kinds = np.count_nonzero(pairs[c])
        p[c] = (pairs[c] + kinds * p[c]) / (pairs[c].sum() + kinds)
    return p


def _per_text(keys: np.ndarray, text: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each text's each distinct key, how often it is in the text, offsets of m texts)."""
    order = np.lexsort((keys, text))
    lead = np.ones(len(order), bool)
    lead[1:] = (keys[order[1:]] != keys[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    first = np.flatnonzero(lead)
    return order[first], np.diff(np.append(first, len(order))), np.searchsorted(text[order[first]], np.arange(m + 1)).astype(np.int32)


def _tools(shared) -> tuple[Symbols, Tree, HashIndex, HashIndex]:
    """Built once per worker."""
    if not _held or _held[0] is not shared:
        common, tree, far, table = shared.value
        root, packed, single, parts = tree
        _square.clear()
        _held.clear()
        first = after_one(root, packed, single)
        give_back()
        tree = Tree.of_parts(root, parts, first)
        _held[:] = [shared, (Symbols(common), tree, HashIndex(_mix(far[0])), HashIndex(table[0]))]
    return _held[1]


def _mark(code: np.ndarray) -> np.ndarray:
    return (_mix(code) >> np.uint64(64 - MARKS)).astype(np.int64)


def marks_of(kept: DataFrame) -> np.ndarray:
    """2^MARKS bits: those of the contexts in the table are set. Others may share a bit; then a place is joined in vain, no more."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_mark(batch.column("code").to_numpy().view(np.uint64))))], ["mark"])

    bits = np.zeros(1 << MARKS, bool)
    bits[arrow_map(kept.select("code").distinct(), step, "mark long").distinct().toArrow()["mark"].to_numpy()] = True
    return np.packbits(bits)


def _kept_in(marks: np.ndarray, sym: np.ndarray, offs: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    """Which of the places may have a context in the table."""
    near = np.zeros(len(sym), bool)
    for length in (2, 3):
        at, code = contexts(sym, offs, length, bits)
        m = _mark(code)
        near[at] |= (marks[m >> 3] >> (7 - (m & 7)).astype(np.uint8) & 1).astype(bool)
    return near[places]


def _answers(asked: DataFrame, kept: DataFrame, shared, root: np.ndarray, bits: int) -> DataFrame:
    """row, log: of the places asked (row, gram, times), the log10 of the last symbols' probabilities by the contexts in the table `kept`, summed by row and bucket."""

    def step(asked: pa.Table, table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())  # as in arrow_map
        give_back()
        gram, inverse = np.unique(asked["gram"].to_numpy().view(np.uint64), return_inverse=True)
        tree = Tree(root, table["code"].to_numpy().view(np.uint64), table["next"].to_numpy().astype(np.int64), table["n"].to_numpy())
        nxt, code = gram & np.uint64((1 << bits) - 1), gram >> np.uint64(bits)
        p = _tools(shared)[1].first[(code & np.uint64((1 << bits) - 1)).astype(np.int64), nxt.astype(np.int64)]
        tree.refine(p, np.arange(len(p)), code & np.uint64((1 << 2 * bits) - 1) | np.uint64(1 << 2 * bits), nxt)
        at = np.flatnonzero(code >= np.uint64(1 << 3 * bits))
        tree.refine(p, at, code[at], nxt[at])
        rows, inverse_row = np.unique(asked["row"].to_numpy(), return_inverse=True)
        return pa.table([pa.array(rows), pa.array(np.bincount(inverse_row, np.log10(p)[inverse] * asked["times"].to_numpy(), len(rows)))], ["row", "log"])

    middle, tokens = (1 << 2 * bits) - 1, int(root.sum())
    asked = asked.withColumn("bucket", _bucket(F.shiftright("gram", bits).bitwiseAND(middle), tokens))
    kept = kept.withColumn("bucket", _bucket(F.col("code").bitwiseAND(middle), tokens))
    return asked.groupBy("bucket").cogroup(kept.groupBy("bucket")).applyInArrow(step, "row long, log double")


def score_documents(docs: DataFrame, parts: int = 7, part: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", parts, part).alias("held_out"), "text")
    words = materialize(token_counts(docs))
    ends = docs.where("not held_out").count()
    row = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).collect()[0]
    total, kinds = row[0] + ends, row[1] + (ends > 0)

    # the symbols and their counts
    top = words.where(F.col("n") >= least_count(words, COMMON)).select("word", "n").toArrow().sort_by("word")
    buf, offs = buffers(text_array(top["word"]))
    common = range_hash(buf, offs[:-1], offs[1:]) if len(top) else np.zeros(0, np.uint64)
    named = F.col("n") >= (int(min(top["n"].to_pylist())) if len(top) else 1 << 62)
    root = np.zeros(1 + CLASSES + len(common), np.int64)
    root[END] = ends
    root[1 + CLASSES :] = top["n"].to_numpy()
    size, types = np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64)
    for r in words.where(~named & (F.col("n") > 0)).groupBy("class").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # at most CLASSES rows
        root[r["class"]] = size[r["class"]] = r["c"]
        types[r["class"]] = r["v"]
    pairs, single, kept = grow(docs, spark.sparkContext.broadcast(common), root)
    bits = bits_for(len(root))
    middle = (1 << 2 * bits) - 1
    # the contexts behind some pairs are held by every worker, those that most places need for their size; the others stay in their table, and grams are joined with it
    pair = F.col("code").bitwiseAND(middle)
    behind = kept.groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("m"), F.first("worth").alias("worth")).toArrow()  # at most symbols^2 rows
    pairs_, m, worth = (behind[c].to_numpy() for c in ("pair", "m", "worth"))
    order = np.lexsort((pairs_, -worth))
    fits = int(np.searchsorted(np.cumsum(m[order]), ENTRIES, "right"))
    far = pairs_[order[fits:]].view(np.uint64)
    least = (float(worth[order[fits - 1]]), int(pairs_[order[fits - 1]])) if fits else (float("inf"), 0)
    held = (F.col("worth") > least[0]) | (F.col("worth") == least[0]) & (pair <= least[1])
    near = kept.where(held).select("code", "next", "n").toArrow()  # at most ENTRIES rows
    held_tree = Tree(root, near["code"].to_numpy().view(np.uint64), near["next"].to_numpy().astype(np.int64), near["n"].to_numpy())
    tree = (root, pairs, single, held_tree.parts)  # built once; workers hold its arrays as they are
    del near, held_tree, behind, pairs_, m, worth, order
    pa.default_memory_pool().release_unused()
    give_back()
    kept = kept.where(~held).select("code", "next", "n")
    marks = marks_of(kept)

    # each token's base term and its share of its symbol
    classes = spark.createDataFrame([(c, float(max(size[c], 1)), float(DISCOUNT * types[c] / size[c]) if size[c] else 1.0) for c in range(1, CLASSES + 1)], "class int, size double, unknown double")
    base = F.log10((F.col("n") + 1) / F.lit(float(total + kinds + 1)))
    share = F.when(named, 1.0).when(F.col("n") > 0, (F.col("n") - DISCOUNT) / F.col("size")).otherwise(F.col("unknown"))
    words = materialize(words.join(F.broadcast(classes), "class").select("word", "n", base.alias("base"), F.log10(share).alias("own")))
    end_base = float(np.log10((ends + 1.0) / (total + kinds + 1)))

    table = words.where(F.col("n") >= least_count(words, LOOKED_UP, 1)).toArrow()
    buf, offs = buffers(text_array(table["word"]))
    keys = range_hash(buf, offs[:-1], offs[1:]) if len(table) else np.zeros(0, np.uint64)
    shared = spark.sparkContext.broadcast((common, tree, (far, marks), (keys, table["base"].to_numpy(), table["own"].to_numpy(), table["n"].to_numpy() > 0)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, tree, away, index = _tools(shared)
        marks = shared.value[2][1]
        _, base_of, own_of, known_of = shared.value[3]
        row = TaskContext.get().partitionId() << 40  # the rows are written before they are used
        for batch in batches:
            buf_all, offs_all = buffers(text_array(batch.column("text")))
            for i, j in slices(offs_all):
                buf = LOWER[buf_all[offs_all[i] : offs_all[j]]]
                starts, ends_, wo = word_spans(buf, offs_all[i : j + 1] - offs_all[i])
                keys = range_hash(buf, starts, ends_)
                sym, offs = sequences(symbols.of(buf, starts, ends_, keys), wo)
                m = j - i
                logs = tree.log10(sym, offs)
                # the places whose contexts are not held here, distinct per text
                grams, gram_times, gram_cut = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(m + 1, np.int32)
                if len(away.keys):
                    at, code = contexts(sym, offs, 2, bits)
                    at = at[away.find(_mix(code & np.uint64(middle))) >= 0]
                    at = at[_kept_in(marks, sym, offs, at, bits)]
                    logs[at] = 0.0
                    text = np.repeat(np.arange(m), np.diff(offs))[at]
                    whole = at - offs[text] >= 3
                    gram = np.where(whole, np.uint64(1) << np.uint64(bits) | sym[at - 3], np.uint64(1))
                    for k in (2, 1, 0):
                        gram = gram << np.uint64(bits) | sym[at - k]
                    pick, gram_times, gram_cut = _per_text(gram, text, m)
                    grams = gram[pick].view(np.int64)
                placed = np.concatenate([[0.0], np.cumsum(logs)])
                found = index.find(keys)
                hit = found >= 0
                sums = []
                for values in (base_of, own_of, known_of):
                    v = np.zeros(len(keys))
                    if len(values):
                        v[hit] = values[found[hit]]
                    run = np.concatenate([[0.0], np.cumsum(v)])
                    sums.append(run[wo[1:]] - run[wo[:-1]])
                # the other words, distinct per text
                at = np.flatnonzero(~hit)
                text = np.searchsorted(wo, at, "right") - 1
                pick, times, cut = _per_text(keys[at], text, m)
                at = at[pick]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + m), pa.int64()),
                        batch.column("doc_id").slice(i, m),
                        batch.column("held_out").slice(i, m),
                        pa.array(np.diff(wo) + 1),
                        pa.array(sums[2].astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1] + placed[offs[1:]] - placed[offs[:-1]]),
                        pa.ListArray.from_arrays(pa.array(cut), take_spans(buf, starts[at], ends_[at])),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(times)),
                        pa.ListArray.from_arrays(pa.array(gram_cut), pa.array(grams)),
                        pa.ListArray.from_arrays(pa.array(gram_cut), pa.array(gram_times)),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "own", "words", "times", "grams", "gram_times"],
                )
                row += m

    rows = materialize(arrow_map(docs, step, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, own double, words array<string>, times array<long>, grams array<long>, gram_times array<long>"))
    rare = (
        rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
        .select("row", "w.times", F.col("w.words").alias("word"))
        .join(words, "word")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k2"), F.sum(F.col("times") * F.col("base")).alias("b2"), F.sum(F.col("times") * F.col("own")).alias("o2"))
    )
    more = rare.select("row", "k2", "b2", "o2")
    if len(far):
        asked = rows.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.gram_times").alias("times"))
        told = _answers(asked, kept, shared, root, bits)
        more = more.unionByName(told.groupBy("row").agg(F.lit(0).cast("long").alias("k2"), F.lit(0.0).alias("b2"), F.sum("log").alias("o2")))
        more = more.groupBy("row").agg(F.sum("k2").alias("k2"), F.sum("b2").alias("b2"), F.sum("o2").alias("o2"))
    zero = F.lit(0.0)
    return rows.drop("words", "times", "grams", "gram_times").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k2", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", zero) + F.lit(end_base)).alias("base_score"),
        (F.col("own") + F.coalesce("o2", zero)).alias("score"),
    )
