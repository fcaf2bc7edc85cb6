"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textmill.llm import ann, boosting, byte_bpe, chat, components, dedup_substring, jaccard_join, packing, sharding, suffix_tree, syncmers, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def corpus(seed=5):
    """Texts with copies, near copies, shared passages, nulls, empty, very long and odd ones, and a repeated row."""
    r = random.Random(seed)
    vocab = ["the", "of", "and", "Über", "naïve", "東京", "it's", "1999", "x.y", "You", "idiot!", "St*pid"] + ["".join(r.choice("abdeginorstu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, base = text(60), text(150)
    docs = [(i, text(r.randint(1, 120))) for i in range(40)]
    docs += [(100 + i, base if i < 3 else " ".join(w if r.random() > 0.01 * i else "edit" for w in base.split())) for i in range(14)]
    docs += [(200 + i, f"{text(20)}\n{passage}\t{text(30)}") for i in range(6)]
    docs += [(300, None), (301, ""), (302, " \n "), (303, "a " * 3000), (304, text(15000)), (305, "one"), (306, "one"), (307, "don't'd \n\n  x 😀 ͸ <|endoftext|> Σ"), (None, base), (None, None), (3, docs[3][1]), (308, "word " * 49 + "end"), (309, "x " + "word " * 49 + "end")]
    return [(i, t, "en", "s", 0) for i, t in docs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score int")


def exact(rows, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            out[q] = sorted(((-float(x @ y), i) for i, y in ok if i != q))[:k]
    return out


def test_ann_recall_and_scores(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[7].tolist()) for i in range(30)]
    df = vectors(spark, [(i, v, 0, 1) for i, v in rows])
    got = collections.defaultdict(list)
    for r_ in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r_.query_id].append((r_.vec_id, r_.score))
    want = exact(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    table = dict(rows)
    for q, found in got.items():
        assert q not in [v for v, _ in found]
        for v, s in found:
            assert s == pytest.approx(float(np.array(table[q], np.float64) @ np.array(table[v], np.float64)), abs=1e-9)
        assert [(-s, v) for v, s in found] == sorted((-s, v) for v, s in found)
    assert np.mean([len({v for v, _ in got[q]} & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9


def test_ann_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [2.0, 1.0]), (7, [2.0, 1.0]), (8, [-1.0, 3.0]), (None, [1.0, 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (20, [5.0, 5.0])]
    df = vectors(spark, [(i, v, 0, 1) for i, v in rows] + [(6, [2.0, 1.0], 0, 1)])
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 5.0), (0, 2, 6, 2.0), (0, 3, 7, 2.0), (0, 4, 8, -1.0), (20, 1, 6, 15.0), (20, 2, 7, 15.0), (20, 3, 8, 10.0), (20, 4, 0, 5.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_pigeonhole_is_complete():
    r = np.random.default_rng(2)
    codes = r.integers(0, 1 << 16, (300, 4), dtype=np.uint16)
    near = codes[:40].copy()
    for row in near:
        for _ in range(r.integers(0, 12)):
            row[r.integers(4)] ^= np.uint16(1 << r.integers(16))
    codes = np.concatenate([codes, near])
    block = ann.Block(codes)
    for radius in (0, 1, 3, 7, 12, 30):
        for q in codes[:40]:
            assert set(block.within(q, radius)) == set(np.flatnonzero(ann.hamming(q, codes) <= radius))


# ------------------------------------------------------------------ 2


def test_sharding_law(spark, docs, nothing):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"key"}
    for r in rows:
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = collections.Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in corpus())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert sharding.shard_documents(nothing).count() == 0


def test_sharding_confines_movement(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    before = sharding.grown_tree(8)
    after = sharding.grown_tree(8, {5: 3.0})
    rows = sharding.assign(sharding.assign(ids, before, "doc_id", "a"), after, "doc_id", "b").groupBy("a", "b").count().collect()
    region = lambda s: s // 4
    moved = [r for r in rows if r.a != r.b]
    assert moved and all(region(r.b) == 1 for r in moved)  # only into, or within, the region whose weight rose
    share = sum(r["count"] for r in rows if r.b == 5) / 20000
    assert share == pytest.approx(3 / 10, abs=0.02)


# ------------------------------------------------------------------ 3


def brute_repeats(rows, w):
    first = {}
    for i, t in rows:
        ws = words(t)
        for k in range(len(ws) - w + 1):
            key = tuple(ws[k : k + w])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = collections.Counter()
    for i, t in rows:
        ws = words(t)
        gone = set()
        for k in range(len(ws) - w + 1):
            if i is not None and first[tuple(ws[k : k + w])] < i:
                gone.update(range(k, k + w))
        kept = " ".join(x for k, x in enumerate(ws) if k not in gone)
        out[i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("w", [50, 26, 7])
def test_substring_dedup(spark, docs, nothing, w):
    got, changed = dedup_substring.remove_repeats(docs, w)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect())
    assert got == brute_repeats([d[:2] for d in corpus()], w)
    assert dedup_substring.remove_repeats(nothing, w)[0].count() == 0


# ------------------------------------------------------------------ 4


def test_toxicity(spark, nothing):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        bad = r.random() < 0.15
        ws = [r.choice(vocab) for _ in range(r.randint(20, 80))]
        if bad:
            for _ in range(4):
                ws[r.randrange(len(ws))] = r.choice(["idiot", "grobble", "grobbling", "you", "SCUM!"])
        rows.append((i, " ".join(ws), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, None, None, None), (5001, "", "", "", 0), (None, "idiot scum", "", "", 0), (5002, "grobble " * 30000, "", "", 0)]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (5001, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(df, lab).collect()
    truth = {i: t for i, _, t in labels}
    held = [(x.score, truth[x.doc_id]) for x in got if x.held_out and x.doc_id in truth]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert len(got) == len(rows) and auc > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got if x.doc_id is not None)
    assert toxicity.score_documents(nothing, lab).count() == 0
    none = toxicity.score_documents(df, lab.limit(0)).collect()
    assert {x.score for x in none} == {0.0}


def test_isotonic():
    x, p = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], x, p).tolist() == [0, 0.5, 0.5, 1]


# ------------------------------------------------------------------ 5


def test_syncmers(spark, docs, nothing):
    rows = [d[:2] for d in corpus()]
    got = syncmers.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    marks = collections.defaultdict(set)
    for i, t in rows:
        marks[i].add(syncmers.fingerprint((t or "").encode()))
    assert all(r.fingerprint in marks[r.doc_id] for r in got)
    ids = [i for i, _ in rows]
    alone = sorted(i for i in ids if i is not None and ids.count(i) == 1)
    text = dict(rows)
    by = {r.doc_id: r for r in got if r.doc_id in alone}
    for a, b in zip(alone, alone[1:], strict=False):
        if ids.count(3) == 2 and a < 3 < b:
            continue
        x, y = text[a] or "", text[b] or ""
        cut = len(x) // 4
        edited = x[: len(x) - cut] + y[:cut]
        assert by[a].n_chars == len(x) and by[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by[a].edited_fingerprint == syncmers.fingerprint(edited.encode())
        assert by[a].near_next == pytest.approx(syncmers.likeness(syncmers.fingerprint(x.encode()), syncmers.fingerprint(y.encode())))
    assert syncmers.fingerprint_documents(nothing).count() == 0
    one = syncmers.fingerprint_documents(spark.createDataFrame([(1, "abcd" * 30, "", "", 0)], DOCS)).first()
    assert one.near_next == 1.0


def test_syncmers_are_context_free():
    r = random.Random(0)
    a, b, mid = ("".join(r.choice("abcdefg ") for _ in range(300)).encode() for _ in range(3))
    for text, at in ((a + mid + b, 300), (mid, 0)):
        pos, h = syncmers.syncmers(np.frombuffer(text, np.uint8))
        inside = {(p - at, x) for p, x in zip(pos.tolist(), h.tolist(), strict=True) if at <= p <= at + 300 - syncmers.K}
        if at:
            first = inside
    assert inside == first and len(inside) > 20
    data = np.frombuffer(a, np.uint8)
    pos, _ = syncmers.syncmers(data)
    inner = [int(x) for x in syncmers.range_hash(data, np.arange(len(a) - syncmers.S + 1), np.arange(syncmers.S, len(a) + 1))]
    width = syncmers.K - syncmers.S + 1
    assert pos.tolist() == [i for i in range(len(a) - syncmers.K + 1) if min(inner[i : i + width]) in (inner[i], inner[i + width - 1])]


# ------------------------------------------------------------------ 6


def test_suffix_tree(spark, docs, nothing):
    rows = [d[:2] for d in corpus()]
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
    counts = collections.Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*words(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in rows:
        ts = [*words(lower(t)), None]
        want[i, held(i), len(ts), sum(counts[x] > 0 for x in ts), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts), 3)] += 1
    got = suffix_tree.score_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert suffix_tree.score_documents(nothing).count() == 0


def test_tree_is_a_distribution_and_learns(spark):
    r = random.Random(2)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = []
    for i in range(700):
        side = a if r.random() < 0.5 else b
        rows.append((i, " ".join(r.choice(side) for _ in range(60)), "", "", 0))
    got = suffix_tree.score_documents(spark.createDataFrame(rows, DOCS)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1]  # the previous token tells the side; knowing it for sure would give log 40 / log 80 = 0.84
    root = np.array([5, 3, 2, 0])
    code = np.array([1 << 12 | 1] * 2, np.uint64)
    tree = suffix_tree.Tree(root, code, np.array([0, 2]), np.array([3, 1]), 1)
    total = 0.0
    for s in range(4):
        sym, offs = np.array([1, s], np.uint64), np.array([0, 2])
        total += 10 ** tree.log10(sym, offs)[1]
    assert total == pytest.approx(1.0)


# ------------------------------------------------------------------ 7


def brute_components(rows, n=5, percent=75):
    sets = []
    for i, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(range(len(rows)), 2):
        if rows[x][0] is None or rows[y][0] is None or not sets[x] or not sets[y]:
            continue
        s = len(sets[x] & sets[y])
        if 100 * s >= percent * (len(sets[x]) + len(sets[y]) - s):
            parent[root(y)] = root(x)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None and sets[x]:
            least[root(x)] = min(least.get(root(x), i), i)
    return collections.Counter((i, len(sets[x]), least[root(x)] if i is not None and sets[x] else i) for x, (i, _) in enumerate(rows))


@pytest.mark.parametrize("percent", [75, 90])
def test_jaccard_join(spark, docs, nothing, percent):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, 5, percent).collect())
    assert got == brute_components([d[:2] for d in corpus()], 5, percent)
    assert jaccard_join.near_duplicates(nothing).count() == 0


def test_jaccard_full_columns(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == brute_components([d[:2] for d in corpus()])


def test_jaccard_chain_of_edits(spark):
    """A chain whose ends don't link directly, and texts at exactly the threshold."""
    base = [f"w{i}" for i in range(104)]
    rows, cur = [], base[:]
    for i in range(12):
        rows.append((50 - i, " ".join(cur)))
        cur[(i * 9) % 100 : (i * 9) % 100 + 4] = [f"e{i}{k}" for k in range(4)]
    rows += [(100, " ".join(f"q{i}" for i in range(11))), (101, " ".join(f"q{i}" for i in range(11)) + " z1 z2"), (102, " ".join(f"q{i}" for i in range(10)))]
    df = spark.createDataFrame([(*r, "", "", 0) for r in rows], DOCS)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect())
    assert got == brute_components(rows)


def test_components(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for e in links if e[0] != e[1] for x in e}
    assert got == want


# ------------------------------------------------------------------ 8


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack_documents(docs, WORD_BPE).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    want, seen = collections.Counter(), collections.Counter()
    for i, t, *_ in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[i, k, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    for r in rows:
        seen[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert seen == want
    at = collections.defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= 2048
    assert packing.pack_documents(nothing, WORD_BPE).count() == 0


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(0)
    for lengths in (r.integers(1, 2048, 5000), np.full(3000, 700), r.integers(1, 20, 4000), np.array([2047])):
        hist = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = packing.plan(hist)
        used = collections.Counter()
        for n, items in plan:
            assert sum(k * m for k, m in items.items()) <= 2048
            for k, m in items.items():
                used[k] += n * m
        assert used == hist
    full = sum(n for n, _ in packing.plan(dict(zip(*(x.tolist() for x in np.unique(r.integers(1, 2048, 20000), return_counts=True)), strict=True))))
    assert full > 0


# ------------------------------------------------------------------ 9


def test_byte_bpe_round_trip(spark, docs, nothing):
    enc = byte_bpe.encoding(BYTE_BPE)[0]
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode_documents(docs, BYTE_BPE, "digest").collect())
    want = collections.Counter()
    for i, t, *_ in corpus():
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    encoded = byte_bpe.encode_documents(docs, BYTE_BPE)
    back = collections.Counter((r.doc_id, r.text) for r in byte_bpe.decode_documents(encoded, BYTE_BPE).collect())
    assert back == collections.Counter((i, t or "") for i, t, *_ in corpus())
    assert byte_bpe.encode_documents(nothing, BYTE_BPE).count() == 0


def test_pre_tokens_match_the_pattern():
    import pyarrow as pa
    import regex

    from textmill.llm import bpe
    from textmill.llm.common import buffers, text_array

    r = random.Random(9)
    alphabet = list("ab's'tdrevlmLS  \n\t \u00851½.,!é日\U0001f600́ ")
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    buf, offs = buffers(text_array(pa.array(texts)))
    cps, at, char_offs = bpe.code_points(buf, offs)
    for attach, pattern in ((True, public_tokenizers.PATTERN), (False, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")):
        rx = regex.compile(pattern)
        starts, ends, _ = bpe.pre_tokens(cps, char_offs, attach)
        cut = np.searchsorted(starts, char_offs)
        for t, text in enumerate(texts):
            got = [text[a - char_offs[t] : b - char_offs[t]] for a, b in zip(starts[cut[t] : cut[t + 1]], ends[cut[t] : cut[t + 1]], strict=True)]
            assert got == rx.findall(text), text


# ------------------------------------------------------------------ 10


def cheapest(roles):
    """The least repair cost by search over all ways."""
    best = {chat.BEGIN: 0}
    for role in roles:
        new = {}
        for a, cost in best.items():
            options = [(a, chat.MERGE + (0 if role == a else chat.RELABEL))] if a != chat.BEGIN else []
            frontier = [(a, 0)]
            for _ in range(3):
                step = []
                for s, c in frontier:
                    for b in chat.NEXT[s]:
                        options.append((b, c + (0 if role == b else chat.RELABEL)))
                        step.append((b, c + chat.INSERT))
                frontier = step
            for b, c in options:
                new[b] = min(new.get(b, 1 << 30), cost + c)
        best = new
    return min(c + chat.closing(s)[0] for s, c in best.items())


def legal(rendered):
    roles = re.findall(r"<\|(system|user|assistant)\|>\n", rendered)
    assert rendered.count("<|end|>\n") == len(roles)
    rest = roles[1:] if roles[0] == "system" else roles
    return len(rest) % 2 == 0 and all(x == ("user", "assistant")[k % 2] for k, x in enumerate(rest)) and rest


@pytest.mark.parametrize("stretch", [50_000, 4])
def test_chat_repair(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    r = random.Random(3)
    kinds = ["system", "user", "assistant", "tool", None]
    convs = {i: [r.choice(kinds) for _ in range(r.randint(1, 9))] for i in range(60)}
    convs[999] = [r.choice(kinds) for _ in range(300)]
    rows = [(c, t, role, f"<|x {c}.{t}" if t % 3 else None, "extra") for c, roles in convs.items() for t, role in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string").repartition(5)
    got = chat.format_conversations(df).orderBy("conv_id", "turn").collect()
    by = collections.defaultdict(list)
    for x in got:
        by[x.conv_id].append(x)
    assert set(by) == set(convs)
    for c, turns in by.items():
        assert [x.role for x in turns] == convs[c]
        assert legal("".join(x.rendered for x in turns))
        want = cheapest([chat.ROLES.index(x) + 1 if x in chat.ROLES else 0 for x in convs[c]])
        paid = sum(chat.INSERT * x.inserted + (chat.MERGE if x.action == "merge" else 0) + (chat.RELABEL if x.role != x.new_role else 0) for x in turns)
        assert paid == want == turns[0].conversation_cost
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_ties_and_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "b"), (None, 1, "user", "c"), (2, 5, "user", "only")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 5
    only = [x for x in got if x.conv_id == 2][0]
    assert only.rendered == "<|user|>\nonly<|end|>\n<|assistant|>\n<|end|>\n" and only.inserted == 1
