
import collections
import math
import random
import zlib

import numpy as np
import pytest

from textmill.llm import byte_bpe, components, suffix_tree


def test_least_count_holds_above_100000(spark):
    words = spark.createDataFrame([(f"w{i}", 100_000 + i) for i in range(10)] + [("rare", 5)], "word string, n long")
    assert [byte_bpe.least_count(words, k) for k in (3, 10, 11)] == [100_007, 100_000, 5]
    assert words.where(f"n >= {byte_bpe.least_count(words, 0)}").count() == 0


def test_codes_hold_more_symbols_than_4096():
    root = np.ones(5000, np.int64)
    bits = suffix_tree.bits_for(len(root))
    sym, offs = np.array([0, 10, 0, 1, 4106, 0], np.uint64), np.array([0, 3, 6])
    at, code = suffix_tree.contexts(sym, offs, 1, bits)
    assert dict(zip(at.tolist(), (code - np.uint64(1 << bits)).tolist())) == {1: 0, 2: 10, 4: 1, 5: 4106}
    with pytest.raises(ValueError):
        suffix_tree.bits_for(1 << 16)
    # the distribution after symbol 4106 is its own, not that of symbol 10
    tree = suffix_tree.Tree(root, np.array([1 << bits | 4106], np.uint64), np.array([3]), np.array([50]))
    p = [10 ** tree.log10(np.array([0, s, 3], np.uint64), np.array([0, 3]))[2] for s in (10, 4106)]
    assert p[0] == pytest.approx(2 / 10000) and p[1] > 0.9


def brute_scores(rows):
    """Scores by the module's text where every word is a symbol of its own: all contexts seen SEEN times that diverge."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    seqs = {i: [None, *t.split(), None] for i, t in rows}
    root, after = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, s in seqs.items():
        if not held[i]:
            root.update(s[1:])
            for at in range(1, len(s)):
                for k in range(1, min(3, at) + 1):
                    after[tuple(s[at - k : at])][s[at]] += 1
    kept = {}
    for c, nexts in after.items():
        up, n = (after[c[1:]] if len(c) > 1 else root), sum(nexts.values())
        up_n = sum(up.values())
        if n < 32:
            continue
        gain = 0.0
        for x, m in nexts.items():
            kinds = len(nexts) - (m == 1)  # without the one sighting that is foretold
            gain += m * math.log(((m - 1) + kinds * up[x] / up_n) / (n - 1 + kinds) / (up[x] / up_n))
        if gain >= len(nexts):
            kept[c] = n
    symbols = 1 + suffix_tree.CLASSES + len(root) - 1

    def p(c, x):
        if not c:
            return (root[x] + 1) / (sum(root.values()) + symbols)
        if c not in kept:
            return p(c[1:], x)
        k = len(after[c])
        return (after[c][x] + k * p(c[1:], x)) / (kept[c] + k)

    return {i: sum(math.log10(p(tuple(s[max(0, at - 3) : at]), s[at])) for at in range(1, len(s))) for i, s in seqs.items()}, kept, sum(root.values())


def test_tree_grows_with_the_corpus(spark, monkeypatch):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(700):
        t = [r.choice(vocab) for _ in range(250)]
        if i % 14 == 0:  # about 50 places of 175,000: less than one of 2,500
            t[100:104] = ["w1", "w2", "w3", r.choice(["w4", "w5"])]
            t[150:153] = ["rare", r.choice("xy"), "z"]
        rows.append((i, " ".join(t)))
    want, kept, total = brute_scores(rows)
    assert total > 80_000 and {len(c) for c, n in kept.items() if n < total / 2500} == {1, 2, 3}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for entries in (suffix_tree.ENTRIES, 2000, 0):  # what workers hold changes nothing
        monkeypatch.setattr(suffix_tree, "ENTRIES", entries)
        got = {x.doc_id: x.score for x in suffix_tree.score_documents(df).collect()}
        assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_components_are_never_split(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "x long, y long")
    with pytest.raises(RuntimeError):
        components.components(chain, rounds=1)
    assert {r.component for r in components.components(chain).collect()} == {0}
