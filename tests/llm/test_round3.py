"""What round 3 changed in earlier operators."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textmill.llm import boosting, common, syncmers, toxicity


def test_toxicity_learns_one_text_of_a_doc_id(spark):
    words = ["calm", "river", "stone", "idiot", "you", "moron", "leaf", "sky"]
    rows = [(i, " ".join(words[(i * k) % 8] for k in range(1, 30)) + f" w{i}", i % 3 == 0) for i in range(120)]
    once = spark.createDataFrame([(i, f"{t} {'you idiot ' * 5 if bad else ''}") for i, t, bad in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bad)) for i, _, bad in rows], "doc_id long, toxic int")
    # the same documents, and of some ids many more texts whose hashes are greater
    more = once.crossJoin(spark.range(300).select(F.col("id").alias("k"))).where("doc_id < 4").select("doc_id", F.concat("text", F.lit(" and "), "k").alias("text"))
    least = once.select("doc_id", F.xxhash64("text").alias("least"))
    more = more.join(least, "doc_id").where(F.xxhash64("text") > F.col("least")).select("doc_id", "text")
    assert more.count() > 100
    a, b = toxicity.train(once, labels), toxicity.train(once.unionByName(more), labels)
    assert a["prior"] == b["prior"]
    for x, y in zip(a["lexicon"], b["lexicon"], strict=True):
        assert np.array_equal(x, y)
    assert np.array_equal(a["calibration"][0], b["calibration"][0])


# ------------------------------------------------------------------ op4 by hand

ALNUM = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
LETTERS = ALNUM - {*range(48, 58)}
LEET = {ord(a): ord(b) for a, b in toxicity.LOOKALIKE.items()}


def plain_features(text, learnt):
    """The features of one text, word by word. learnt: (kind, unit) -> log odds; kind 0 is a word, k a beginning of k bytes."""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    rows, kinds = [], set()
    for w in words:
        inner = [i for i, b in enumerate(w) if b in ALNUM]
        core = w[inner[0] : inner[-1] + 1] if inner else b""
        low = core.lower()
        units = [(0, low), *[(k, low[:k]) for k in toxicity.BEGINNINGS if len(core) > k]] if inner else []
        hits = [u for u in units if u in learnt]
        kinds.update(hits)
        n = sum(b in LETTERS for b in core)
        odd = 0 < n < len(core)
        seen = bytes(c for c in (LEET.get(b, b) for b in core.lower()) if c in LETTERS)
        fixed = low.decode("utf-8", "replace") in toxicity.INSULTS
        hidden = odd and (seen.decode("utf-8", "replace") in toxicity.INSULTS or (0, seen) in learnt)
        weight = max((learnt[u] for u in hits), default=0.0)
        rows.append((fixed, weight, hidden, low.decode("utf-8", "replace") in toxicity.SECOND_PERSON, odd, core.isalpha() and core.isascii() and core.isupper() and len(core) > 1))
    bad = [f or w > 0 or h for f, w, h, *_ in rows]
    near = sum(b and any(rows[j][3] for j in range(max(0, i - 5), min(len(rows), i + 6)) if j != i) for i, b in enumerate(bad))
    n_words, n_bytes, n_letters = max(len(words), 1), max(len(raw), 1), max(sum(b in LETTERS for b in raw), 1)
    punct = [b not in ALNUM and b not in b" \t\n\x0b\x0c\r" for b in raw]
    share = lambda k: sum(bool(r[k]) for r in rows) / n_words
    return [
        share(0), share(1), math.log1p(sum(bad)), len(kinds), max((r[1] for r in rows), default=0.0), sum(r[1] for r in rows) / n_words, near / n_words, share(3),
        sum(65 <= b <= 90 for b in raw) / n_letters, share(5), sum(b in b"!?" for b in raw) / n_bytes, sum(punct) / n_bytes, sum(punct[i] and raw[i] == raw[i - 1] for i in range(1, len(raw))) / n_bytes, share(4), share(2), math.log1p(n_words),
    ]


def test_toxicity_features():
    r = random.Random(3)
    learnt = {(0, b"rotter"): 2.5, (4, b"blor"): 1.7, (6, b"blorbi"): 3.0, (0, b"grum"): 1.9}
    bits = ["idiot", "1d10t", "ID!OT", "you", "YOU,", "Dich", "rotter", "r0tter!", "R0TTER", "blorbing", "blor", "blorx", "grum", "gr-um", "über", "Ö", "!!", "??", "--", "x", "AB", "A1", "don't", "(tú)", "3", "calm", "so.", "\n", "\t"]
    texts = ["", " ", "!!!", *[" ".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(150)]]
    units, odds = [], []
    for (kind, unit), weight in learnt.items():
        h = toxicity._hash_words([unit.decode()])
        units.append(int((toxicity._mix_unit(h, kind) if kind else h)[0]))
        odds.append(weight)
    buf, offs = common.buffers(common.text_array(pa.array(texts)))
    got = toxicity.Featurizer(np.array(units, np.uint64), np.array(odds)).features(buf, offs)
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain_features(text, learnt)), (text, dict(zip(toxicity.FEATURES, zip(row, plain_features(text, learnt), strict=True), strict=True)))


def test_toxicity_lexicon_is_a_likelihood_ratio_test():
    n1, n0, t1, t0 = np.array([40.0, 9, 3, 60, 12]), np.array([2.0, 9, 0, 700, 0]), 100, 900
    units = np.arange(5, dtype=np.uint64)

    def g(a, b):
        p, out = t1 / (t1 + t0), 0.0
        for k, q in ((a, p), (b, 1 - p)):
            out += k * math.log(k / ((a + b) * q)) if k else 0.0
        return out

    odds = [math.log((a + 0.5) / (t1 + 1)) - math.log((b + 0.5) / (t0 + 1)) for a, b in zip(n1, n0, strict=True)]
    want = sorted((i for i in range(5) if g(n1[i], n0[i]) >= toxicity.RATIO and odds[i] > 1.5 and n1[i] >= toxicity.SUPPORT), key=lambda i: -g(n1[i], n0[i]))
    got, weights = toxicity._lexicon(units, n1, n0, t1, t0)
    assert got.tolist() == want == [0, 4] and np.allclose(weights, [odds[i] for i in want])


def test_calibration_is_the_isotonic_fit():
    r = np.random.default_rng(4)
    for _ in range(30):
        score, y = r.integers(0, 12, 40) / 4, r.integers(0, 2, 40).astype(float)
        xs, fit = boosting.isotonic(score, y)
        places = np.unique(score)
        mean = lambda a, b: y[(score >= places[a]) & (score <= places[b])].mean()
        n = len(places)
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]  # the min-max formula
        assert np.allclose(np.interp(places, xs, fit), want)


# ------------------------------------------------------------------ op5 by hand


def one_hash(data):
    return int(common.range_hash(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def plain_fingerprint(data):
    """Anchors by their definition: hash (upper 32 bits) -> first position."""
    k, s = syncmers.K, syncmers.S
    if not data:
        return {}
    if len(data) < k:
        return {one_hash(data) >> 32: 0}
    found = {}
    for i in range(len(data) - k + 1):
        inner = [one_hash(data[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(one_hash(data[i : i + k]) >> 32, i)
    keep = max(syncmers.LEAST, sum(h < (1 << 32) // syncmers.SHARE for h in found))
    return {h: found[h] for h in sorted(found)[:keep]}


def plain_likeness(a, b):
    if a == b:
        return 1.0
    limit = min(max(max(x) + 1, (1 << 32) // syncmers.SHARE) if len(x) >= syncmers.LEAST else 1 << 32 for x in (a, b))
    a, b = ({h: p for h, p in x.items() if h < limit} for x in (a, b))
    pairs = sorted((a[h], b[h]) for h in a.keys() & b.keys())
    longest = []
    for i, (_, y) in enumerate(pairs):
        longest.append(1 + max((longest[j] for j in range(i) if pairs[j][1] < y), default=0))
    either = len(a.keys() | b.keys())
    j = max(longest, default=0) / either if either else 0.0
    return 2 * j / (1 + j)


def test_syncmer_fingerprints_and_likeness():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    base = [word() for _ in range(400)]
    edited = [w if r.random() > 0.05 else word() for w in base]
    moved = base[200:] + base[:200]
    texts = ["", "x", "a" * 19, "a" * 20, "ab" * 200, " ".join(base), " ".join(edited), " ".join(moved), " ".join(base[:60]), " ".join(word() for _ in range(300))]
    plain = [plain_fingerprint(t.encode()) for t in texts]
    marks = [syncmers.fingerprint(t.encode()) for t in texts]
    assert marks == ["".join(f"{h:08x}{p:08x}" for h, p in x.items()) for x in plain]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert abs(syncmers.likeness(marks[i], marks[j]) - plain_likeness(plain[i], plain[j])) < 1e-12
    assert 0.5 < syncmers.likeness(marks[5], marks[6]) < 1
