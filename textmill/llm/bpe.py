"""Vectorised pieces of byte-pair encoding: character classes, pre-tokens, hash tables, merges."""

from __future__ import annotations

import base64
import json
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np

from .common import ranges, same_bytes

LETTER, NUMBER, OTHER, SPACE, UNASSIGNED = range(5)
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((UNASSIGNED if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, byte position of each and of the end, char offsets of the texts)."""
    if not len(buf) or buf.max() < 128:
        return buf.astype(np.uint32), np.arange(len(buf) + 1), offs
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    cps = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return cps, np.append(lead, len(buf)), np.searchsorted(lead, offs)


def _contractions(cps: np.ndarray, at: np.ndarray, text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes at `at`, those that open 's 't 'm 'd 're 've 'll, and the lengths of these."""
    n = len(cps)
    get = lambda i: np.where(i < text_end, cps[np.minimum(i, n - 1)], 0)
    a, b = get(at + 1), get(at + 2)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    hit = one | two
    return at[hit], np.where(one, 2, 3)[hit]


def pre_tokens(cps: np.ndarray, offs: np.ndarray, attach_space: bool, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, classes): the matches of the split pattern, in characters; table has the class of every code point (else `classes`).

    attach_space True: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    attach_space False: 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+ (spaces dropped)
    """
    n = len(cps)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    cls = (classes() if table is None else table)[cps]
    cls[cls == UNASSIGNED] = OTHER
    begin = np.zeros(n, bool)
    begin[1:] = cls[1:] != cls[:-1]
    text_start = offs[:-1][offs[:-1] < offs[1:]]
    begin[text_start] = True
    first_of_text = np.zeros(n + 1, bool)
    first_of_text[text_start] = True
    first_of_text[n] = True
    quotes = np.flatnonzero(cps == 39)
    if attach_space:
        space = cls == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first_of_text[1:n])
        begin[last] = True
        begin[last + 1] = cps[last] != 32
    else:
        begin |= cls == NUMBER
    quotes = quotes[begin[quotes]]
    if len(quotes):
        end = offs[np.searchsorted(offs, quotes, "right")]
        at, size = _contractions(cps, quotes, end)
        begin[at + 1] = False
        after = at + size
        after = after[after < n]
        begin[after] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    kinds = cls[starts]
    if not attach_space:
        keep = kinds != SPACE
        starts, ends, kinds = starts[keep], ends[keep], kinds[keep]
    return starts, ends, kinds


class HashIndex:
    """Positions of distinct uint64 keys, with linear probing; grows by rebuilding."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        size = 1 << max(10, int(2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        self._place(np.arange(len(keys)))

    def _place(self, todo: np.ndarray) -> None:
        at = (self.keys[todo] & self.mask).astype(np.int64)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & int(self.mask)

    def extend(self, keys: np.ndarray) -> None:
        n = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        if 2 * len(self.keys) > len(self.slots):
            self.__init__(self.keys)
        else:
            self._place(np.arange(n, len(self.keys)))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The position of each wanted key, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        at = (wanted & self.mask).astype(np.int64)
        slot = self.slots[at]
        hit = (slot >= 0) & (self.keys[slot] == wanted)
        out[hit] = slot[hit]
        todo = np.flatnonzero(~hit & (slot >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & int(self.mask)
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[slot] == wanted[todo])
            out[todo[hit]] = slot[hit]
            go = ~hit & (slot >= 0)
            todo, at = todo[go], at[go]
        return out


class Pile:
    """An array that grows at its end."""

    def __init__(self, values: np.ndarray):
        self.held, self.n = values, len(values)

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(end, 1024), self.held.dtype)])
        self.held[self.n : end] = values
        self.n = end

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


class Words:
    """Token ids of distinct words: hash -> ids, as one flat array with offsets, and the words themselves."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, offs: np.ndarray, data: np.ndarray, cuts: np.ndarray):
        self.index, self.id_pile, self.off_pile = HashIndex(keys), Pile(ids), Pile(offs)
        self.data, self.cut_pile = Pile(np.append(data, np.zeros(8, np.uint8))), Pile(cuts)  # eight more bytes for `eights`

    @property
    def offs(self) -> np.ndarray:
        return self.off_pile.values

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> None:
        self.index.extend(keys)
        self.id_pile.add(ids)
        self.off_pile.add(self.offs[-1] + np.cumsum(counts))
        self.data.n -= 8
        self.data.add(np.append(data, np.zeros(8, np.uint8)))
        self.cut_pile.add(self.cut_pile.values[-1] + np.cumsum(sizes))

    def same(self, which: np.ndarray, view: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the words found are these: `sizes` bytes from `starts` of view (see `eights`)."""
        data, cuts = self.data.values, self.cut_pile.values
        held = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        out = cuts[which + 1] - cuts[which] == sizes
        rows = np.flatnonzero(out)
        out[rows] = same_bytes(held, cuts[which[rows]], view, starts[rows], sizes[rows])
        return out

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, offset of each word's ids)."""
        offs = self.offs
        counts = offs[which + 1] - offs[which]
        out = np.zeros(len(which) + 1, np.int64)
        np.cumsum(counts, out=out[1:])
        return self.id_pile.values[ranges(offs[which], counts)], out


# ------------------------------------------------------------------ merges


class MergeTable:
    """Byte-level BPE with word ends, applied to many words at once.

    Each round merges, in every unfinished word, the leftmost pair of the lowest rank. Words of
    more than WIDE bytes take their pairs from a heap instead, one word after another.
    """

    WIDE = 64

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.index = HashIndex(self._spread(keys))
        self.pairs = keys
        self.rank_of: dict[int, int] | None = None

    @staticmethod
    def _spread(keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) ^ (keys >> np.uint64(17))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.index.find(self._spread(left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)))
        return np.where(found < 0, 1 << 30, found)

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count per word) for words of at least one byte."""
        size = ends - starts
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        at, short = 0, int((size <= self.WIDE).sum())
        for row in order[short:].tolist():
            ids = self._encode_long(buf[starts[row] : ends[row]])
            parts.append((np.array([row]), ids, np.array([len(ids)])))
        while at < short:  # words of alike length together
            wide = int(size[order[at]])
            wide = max(8, -(-wide // 4) * 4)
            stop = int(np.searchsorted(size[order[:short]], wide, "right"))
            stop = min(stop, at + max(1, (1 << 20) // wide))
            rows = order[at:stop]
            ids, counts = self._encode(buf, starts[rows], size[rows], wide)
            parts.append((rows, ids, counts))
            at = stop
        counts = np.zeros(len(size), np.int64)
        for rows, _, c in parts:
            counts[rows] = c
        offs = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(offs[-1], np.int32)
        for rows, ids, c in parts:
            out[ranges(offs[rows], c)] = ids
        return out, counts

    def _encode(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(starts)
        col = np.arange(wide)
        inside = col < size[:, None]
        raw = buf[np.minimum(starts[:, None] + col, len(buf) - 1)]
        sym = np.where(inside, self.first[raw], -1)
        sym[np.arange(n), size - 1] = self.final[raw[np.arange(n), size - 1]]
        counts = size.copy()
        rank = np.full((n, wide), 1 << 30, np.int64)
        pair = inside[:, 1:]
        rank[:, :-1][pair] = self._ranks(sym[:, :-1][pair], sym[:, 1:][pair])
        live = np.arange(n)
        s, r = sym, rank
        while len(live):
            p = r.argmin(1)
            k = np.arange(len(live))
            best = r[k, p]
            go = best < 1 << 30
            if not go.all():
                done = ~go
                sym[live[done], : s.shape[1]] = s[done]
                live, s, r, p, best = live[go], s[go], r[go], p[go], best[go]
                k = np.arange(len(live))
                if not len(live):
                    break
            s[k, p] = self.made[best]
            src = col + (col > p[:, None])
            src[:, -1] = np.minimum(src[:, -1], wide - 1)
            s = np.take_along_axis(s, np.minimum(src, wide - 1), 1)
            r = np.take_along_axis(r, np.minimum(src, wide - 1), 1)
            s[:, -1] = -1
            r[:, -1] = 1 << 30
            counts[live] -= 1
            nxt = s[k, np.minimum(p + 1, wide - 1)]
            ok = (p + 1 < wide) & (nxt >= 0)
            new = np.full(len(live), 1 << 30, np.int64)
            new[ok] = self._ranks(s[k, p][ok], nxt[ok])
            r[k, p] = new
            ok = p > 0
            r[k[ok], p[ok] - 1] = self._ranks(s[k[ok], p[ok] - 1], s[k[ok], p[ok]])
        return sym[col < counts[:, None]], counts


    def _encode_long(self, raw: np.ndarray) -> np.ndarray:
        """The ids of one long word: pairs wait in a heap by rank and place, symbols are a linked list."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.pairs.tolist(), range(len(self.pairs)), strict=True))
        ranks, made, n = self.rank_of, self.made, len(raw)
        sym = [*self.first[raw[:-1]].tolist(), int(self.final[raw[-1]])]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get(sym[i] << 20 | sym[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:  # one of them has merged with another
                continue
            sym[i], sym[j] = int(made[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := ranks.get(sym[i] << 20 | sym[k])) is not None:
                    heappush(heap, (q, i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (q := ranks.get(sym[h] << 20 | sym[i])) is not None:
                heappush(heap, (q, h, sym[h], sym[i]))
        return np.array([s for s in sym if s >= 0], np.int32)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the letters from U+0100.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def load_merges(path: str) -> MergeTable:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return MergeTable(model["vocab"], model["merges"], model["end_of_word_suffix"])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
