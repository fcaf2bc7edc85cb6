"""Words and characters of whole Arrow batches as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a single longer text is one step).
STEP = 1 << 20
#: Bytes that words consist of (ASCII letters and digits), and lower case.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null texts are empty."""
    col = col.cast(pa.large_string())
    col = col.fill_null("") if col.null_count else col
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def steps(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(max(int(np.searchsorted(offs, offs[i] + STEP, "right")) - 1, i + 1), n)
        yield i, j
        i = j


def stir(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The states h with 64 more bits."""
    h = h * _A + _B
    h ^= h >> _U(31)
    h ^= x
    h *= _B
    h ^= h >> _U(29)
    return h


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, eight bytes at a time."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    view = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    first = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h, rows, k = size.astype(np.uint64), np.arange(len(size)), 0
    while len(rows):
        h[rows] = stir(h[rows], view[starts[rows] + k] & first[np.minimum(size[rows] - k, 8)])
        k += 8
        rows = rows[size[rows] > k]
    return h


class Grams:
    """The n-grams of lower-cased words [a-z0-9]+ of some texts, with 64-bit hashes `h`."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, n: int):
        self.buf, self.n = LOWER[buf], n
        solid = ALNUM[self.buf]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offs[1:-1]
        first[inner[inner < len(buf)]] = solid[inner[inner < len(buf)]]
        last[inner[inner > 0] - 1] = solid[inner[inner > 0] - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.cut = np.searchsorted(self.starts, offs)
        m = max(len(self.starts) - n + 1, 0)
        words, h = word_hashes(self.buf, self.starts, self.ends), np.zeros(m, np.uint64)
        for k in range(n if m else 0):
            h = stir(h, words[k : k + m])
        of = np.repeat(np.arange(len(offs) - 1), np.diff(self.cut))
        self.at = np.flatnonzero(of[n - 1 :] == of[:m]) if m else np.zeros(0, np.int64)  # a gram may not leave its text
        self.of, self.h = of, h[self.at].view(np.int64)

    def places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, position in it) of some grams."""
        at = self.at[k]
        return self.of[at], at - self.cut[self.of[at]]

    def said(self, k: np.ndarray) -> list[str]:
        """The words of some grams, joined by blanks."""
        raw = self.buf.tobytes()
        spans = zip(self.starts, self.ends, strict=True)
        spans = [(int(a), int(b)) for a, b in spans] if len(k) > len(self.starts) // 50 else None
        word = (lambda i: raw[spans[i][0] : spans[i][1]]) if spans else (lambda i: raw[int(self.starts[i]) : int(self.ends[i])])
        return [b" ".join([word(i) for i in range(at, at + self.n)]).decode() for at in self.at[k].tolist()]


def grams(col: pa.Array, n: int) -> Iterator[tuple[int, int, Grams]]:
    """For steps of texts i..j their n-grams."""
    buf, offs = flat(col)
    for i, j in steps(offs):
        yield i, j, Grams(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
