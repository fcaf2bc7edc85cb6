"""Periodic runs against their definition, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_operators_llm import DOCS, corpus

from textmill.llm import common, runs


def brute_runs(words, least=24, times=3):
    """Every period's maximal stretches; those whose smallest period is another are left out."""
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, q) if q % p == 0):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def changed(doc_id, words):
    """The words of the contract's document."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest_row(doc_id, words):
    found = brute_runs(words)
    best = (None,) * 4
    if found:
        s, n, q = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
        best = (s, n, q, 1000 * n // q)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def sequences():
    r = random.Random(3)
    yield from ([], [0], [0] * 23, [0] * 24, [0] * 200, [0, 1] * 12, [0, 1] * 11 + [0], [0, 1, 2] * 30 + [0], [0] * 40 + [1] + [0] * 40)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield [bin(i).count("1") % 2 for i in range(600)]
    for _ in range(150):
        seq = []
        while len(seq) < 250:
            unit = [r.randrange(r.choice([1, 2, 3, 40])) for _ in range(r.choice([1, 2, 3, 5, 8, 13, 30]))]
            seq += (unit * r.choice([1, 1, 2, 3, 4, 9, 30]))[: r.choice([40, 90, 300])]
        yield seq


def test_runs_of_sequences():
    for seq in sequences():
        assert sorted(runs.runs_of(np.array(seq, np.int64)), key=lambda r: (r.start, r.period)) == brute_runs(seq), seq


def test_runs_of_texts_by_stretches():
    texts = [" ".join(f"w{k}" for k in seq) for seq in sequences()]
    buf, offs = common.buffers(common.text_array(pa.array(texts)))
    assert [list(map(tuple, found)) for found in runs.text_runs(buf, offs)[0]] == [brute_runs(split(t)) for t in texts]


def test_extensions_are_verified(monkeypatch):
    """With a base that makes every place weigh the same, hashes collide; the words decide."""
    monkeypatch.setattr(runs.Extensions, "BASE", 1)
    for seq in list(sequences())[:60]:
        assert sorted(runs.runs_of(np.array(seq, np.int64)), key=lambda r: (r.start, r.period)) == brute_runs(seq)


def test_words_with_one_hash_are_told_apart():
    buf, offs = common.buffers(common.text_array(pa.array(["ab cd ab", "cd"])))
    starts, ends, _ = common.word_spans(buf, offs)
    got = runs.numbered(buf, common.eights(buf), starts, ends, np.zeros(4, np.uint64))
    assert got[0] == got[2] != got[1] == got[3]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    unit = lambda n: [f"u{r.randrange(1000)}" for _ in range(n)]
    extra = [" ".join((unit(r.randint(0, 30)) + unit(q) * k + unit(r.randint(0, 9)))) for q, k in [(1, 60), (7, 4), (8, 3), (9, 3), (40, 5), (200, 3), (5, 30)] for _ in range(4)]
    extra += ["x\ny\tz " * 20, "a " * 24, "a " * 23, "Ä ä\x0bÄ ä\x0c" * 12, "a\x1ca a\x1ca " * 24]
    return [r[:2] for r in corpus(13)] + [(2000 + i, t) for i, t in enumerate(extra)] + [(2001, extra[0])]


def test_query(spark, rows):
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS).withColumnsRenamed({"lang": "w", "source": "g", "n_chars": "runs"}).repartition(4)
    got = runs.digests(runs.periodic_runs(runs.planted(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted((digest_row(i, changed(i, split(t))) for i, t in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(w[1] > 0 for w in want) > 20


def test_operator_keeps_its_own_results(spark):
    text = "start " + "one two three\n" * 12 + "end"
    r = runs.periodic_runs(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0].n_words, [tuple(x) for x in r[0].runs], r[0].collapsed) == (38, [(1, 36, 3)], "start one two three end")
    assert (r[1].n_words, r[1].runs, r[1].collapsed) == (0, [], "")


def test_empty_table(spark):
    assert runs.digests(runs.periodic_runs(runs.planted(spark.createDataFrame([], DOCS)))).collect() == []


def test_long_texts_take_near_linear_time():
    import time

    r = np.random.default_rng(1)
    for seq in (np.zeros(300_000, np.int64), np.tile(r.integers(0, 50_000, 40_000), 5), np.tile(np.array([0, 0, 1, 0, 1]), 40_000)):
        begin = time.time()
        assert len(runs.runs_of(seq)) >= 1
        assert time.time() - begin < 60
