"""Structured words, clashing names, hot keys, long texts, repeated rows."""

import collections
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators_llm import DOCS, brute_components, brute_repeats, corpus

from textmill.llm import ann, bpe, chat, common, components, dedup_substring, jaccard_join, packing, suffix_tree, syncmers, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


PAIRS = [(thue_morse(1 << k), thue_morse(1 << k, "b", "a")) for k in range(3, 14)]


@pytest.mark.parametrize("which", [0, 1])
def test_hashes_tell_structured_values_apart(which):
    for pair in PAIRS:
        buf, offs = common.buffers(common.text_array(pa.array(pair)))
        assert len(set(common.range_hash(buf, offs[:-1], offs[1:], which).tolist())) == 2
        values = [np.array([7 if c == "a" else 9 for c in t], np.uint64) for t in pair]
        assert common.window_hash(values[0], len(values[0]), which)[0] != common.window_hash(values[1], len(values[1]), which)[0]


def test_window_hashes_depend_on_the_window_alone():
    r = np.random.default_rng(3)
    values = r.integers(0, 1 << 62, 200).astype(np.uint64)
    for size in (1, 2, 5, 13, 26, 50):
        h = common.window_hash(values, size)
        assert len(h) == 201 - size and len(set(h.tolist())) == len(h)
        assert all(common.window_hash(values[i : i + size], size)[0] == h[i] for i in range(0, len(h), 17))
    swapped = values[[1, 0]]
    assert common.window_hash(values[:2], 2)[0] != common.window_hash(swapped, 2)[0]


def test_same_bytes():
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(r.choice([0, 1, 7, 8, 9, 63, 64, 65, 72, 73, 200]))) for _ in range(60)]
    buf, offs = common.buffers(common.text_array(pa.array(texts)))
    view, size = common.eights(buf), np.diff(offs)
    for i, t in enumerate(texts):
        like = np.flatnonzero(size == size[i])
        got = common.same_bytes(view, np.full(len(like), offs[i]), view, offs[:-1][like], size[like])
        assert got.tolist() == [texts[k] == t for k in like]
        if len(t):
            other = common.eights(np.frombuffer((t[:-1] + "c").encode(), np.uint8))
            assert not common.same_bytes(view, np.array([offs[i]]), other, np.array([0]), size[[i]])[0]


def test_structured_words_in_the_operators(spark):
    rows = []
    for k, (a, b) in enumerate(PAIRS):
        rows += [(4 * k, a, "", "", 0), (4 * k + 1, b, "", "", 0), (4 * k + 2, f"{a} {b} " * 30, "", "", 0), (4 * k + 3, f"{b} {a} " * 30 + "end", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = jaccard_join.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(brute_components([r[:2] for r in rows]))
    out, _ = dedup_substring.remove_repeats(docs, 50)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == brute_repeats([r[:2] for r in rows], 50)
    scores = {r.doc_id: r for r in suffix_tree.score_documents(docs).collect()}
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    counts = collections.Counter(w for r in rows if not held[r[0]] for w in r[1].split())
    assert all(scores[r[0]].n_known == sum(counts[w] > 0 for w in r[1].split()) + 1 for r in rows)


@pytest.mark.parametrize("blind", [False, True])
def test_packing_ids_with_colliding_hashes(blind, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    texts = [t for p in PAIRS for t in p] + ["the cat's 12 café ΑΣ _x " * 5, "z" * 65 + " " + "z" * 66, "", "的" * 300]
    packing._state.clear()
    if blind:
        monkeypatch.setattr(packing, "range_hash", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    buf, offs = common.buffers(common.text_array(pa.array(texts)))
    for _ in range(2):
        ids, cut = packing.encode_block(buf, offs, WORDS)
        for i, t in enumerate(texts):
            assert ids[cut[i] : cut[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids
    packing._state.clear()


def test_long_words_merge_like_short_ones(monkeypatch):
    table, r = bpe.load_merges(WORDS), random.Random(2)
    words = ["".join(r.choice("abcdeinrst") for _ in range(r.randint(1, 60))).encode() for _ in range(200)]
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    ids, counts = table.encode(buf, starts, ends)
    monkeypatch.setattr(bpe.MergeTable, "WIDE", 0)
    again, counts2 = table.encode(buf, starts, ends)
    assert ids.tolist() == again.tolist() and counts.tolist() == counts2.tolist()


CLASHES = ["kept", "_id", "_tk", "_score", "_predicted", "_text", "tk", "of", "of_tk", "left", "chance", "flag", "a.b", "hash", "Copy"]


def test_stages_keep_further_columns(spark, tmp_path):
    rows = corpus(8)
    d = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows, DOCS)
    for k, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs = docs.withColumn("more", F.struct(F.col("doc_id").alias("x y"), F.lit(1).alias("z")))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 9 == 0)) for r in rows[:40]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = common.materialize(stage(spark, docs, d))
        assert got.columns == docs.columns and got.schema["more"].dataType == docs.schema["more"].dataType
        for r in got.collect():
            assert all(r[c] == f"{k}:{r.doc_id if r.doc_id is not None else 'none'}" for k, c in enumerate(CLASHES)), name
        bare = stage(spark, plain, d).collect()
        assert collections.Counter((r.doc_id, r.text) for r in bare) == collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() > 0


def test_toxicity_stage_and_whole_run(spark, tmp_path):
    rows = corpus(8)
    bad = [(500 + k, f"you are a stupid worthless idiot number {k} and you know it", "en", "s", 0) for k in range(40)]
    good = [(600 + k, f"the river runs by the old mill near town {k} every day", "en", "s", 0) for k in range(40)]
    d = str(tmp_path / "sf")
    spark.createDataFrame(rows + bad + good, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 600)) for i in range(500, 640) if i % 3 and (i < 540 or i >= 600)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.score_documents(docs, labels).collect()
    goes = collections.Counter(r.doc_id for r in scored if r.score >= 0.3)
    assert {500 + k for k in range(40)} <= set(goes) and not set(goes) & {600 + k for k in range(40)}
    kept = common.materialize(corpus_pipeline.toxicity_filter(spark, docs, d))
    everything = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert collections.Counter(r.doc_id for r in kept.select("doc_id").collect()) == everything - goes

    for _, stage in corpus_pipeline.STAGES[1:-1]:
        kept = common.materialize(stage(spark, kept, d))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    want = collections.Counter((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in kept.collect())
    pieces = corpus_pipeline.run(spark, d).collect()
    assert collections.Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    assert sum(p.length for p in pieces) == sum(n * m for (_, n), m in want.items())
    taken = collections.defaultdict(list)
    for p in pieces:
        taken[p.sequence_id].append((p.offset, p.length))
    for spans in taken.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_join_counted_with_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "KEY_ROWS", 3)
    rows = spark.createDataFrame([(k % 5 if k % 2 else 7, k) for k in range(60)], "h long, doc_id long")
    keyed = common.materialize(rows.groupBy("h").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    got = common.join_counted(rows, keyed, ["h"]).select("h", "doc_id", "least").collect()
    want = rows.join(keyed, "h").select("h", "doc_id", "least").collect()
    assert sorted(got) == sorted(want) and len(got) == 60


def test_components_of_a_hub(spark):
    edges = [(0, k) for k in range(1, 400)] + [(500, 501), (501, 502), (502, 399)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**dict.fromkeys(range(400), 0), 500: 0, 501: 0, 502: 0}


def test_full_columns_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    monkeypatch.setattr(jaccard_join, "TILE_ENTRIES", 40)
    r = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(base[: r.randint(8, 80)])) for k in range(60)]
    got = jaccard_join.near_duplicates(spark.createDataFrame([(*x, "", "", 0) for x in rows], DOCS)).collect()
    assert collections.Counter((g.doc_id, g.n_shingles, g.component_id) for g in got) == collections.Counter(brute_components(rows))


def brute_walk(rows):
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
    out = collections.Counter()
    for (i, t, _), (_, u, _) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + u[:cut]
        out[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("run", [4000, 3, 1])
def test_runs_of_null_and_repeated_ids(spark, monkeypatch, run):
    monkeypatch.setattr(syncmers, "RUN", run)
    r = random.Random(run)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(0, 90))) for _ in range(40)]
    rows = [(None if k % 3 == 0 else k // 5, t) for k, t in enumerate(texts)] + [(None, "same again")] * 5 + [(3, "")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = [(x.doc_id, x.text, x.tk) for x in df.withColumn("tk", F.xxhash64("text")).collect()]
    got = syncmers.fingerprint_documents(df).collect()
    assert collections.Counter((g.doc_id, g.n_chars, g.edited_sha256) for g in got) == brute_walk(keyed)


def test_positions_beyond_16_mib():
    r = np.random.default_rng(0)
    passage = r.integers(97, 122, 4000).astype(np.uint8).tobytes()
    mark = syncmers.fingerprint(b"\0" * ((1 << 24) + 5) + passage)
    h, at = syncmers.anchors(mark)
    own, own_at = syncmers.anchors(syncmers.fingerprint(passage))
    shared = set(h.tolist()) & set(own.tolist())
    where, there = dict(zip(h.tolist(), at.tolist(), strict=True)), dict(zip(own.tolist(), own_at.tolist(), strict=True))
    assert len(shared) > 50 and all(where[x] - there[x] == (1 << 24) + 5 for x in shared)


def test_fingerprints_of_long_texts_estimate_their_likeness():
    r = np.random.default_rng(5)
    a = r.integers(97, 122, 200_000).astype(np.uint8)
    for share in (0.1, 0.5, 0.9):
        b = np.concatenate([a[: int(len(a) * share)], r.integers(97, 122, len(a) - int(len(a) * share)).astype(np.uint8)])
        assert syncmers.likeness(syncmers.fingerprint(a.tobytes()), syncmers.fingerprint(b.tobytes())) == pytest.approx(share, abs=0.03)


@pytest.mark.parametrize("stretch", [2, 7, 5000])
def test_conversations_across_partitions(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    r = random.Random(stretch)
    rows = [(c if c else None, t, r.choice(["user", "assistant", "system", "tool", None]), r.choice(["hi", "", None, "<|x"])) for c in range(12) for t in range(r.choice([1, 2, 5, 40]))]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "turn").collect()
    assert len(got) == len(rows)
    whole = collections.defaultdict(str)
    paid = collections.Counter()
    for g in got:
        whole[g.conv_id] += g.rendered
        paid[g.conv_id] += chat.INSERT * g.inserted + (chat.MERGE if g.action == "merge" else 0) + (chat.RELABEL if g.role != g.new_role else 0)
    assert all(paid[g.conv_id] == g.conversation_cost for g in got)
    assert all(t.endswith("<|end|>\n") and t.count("<|end|>") == t.count("<|user|>") + t.count("<|assistant|>") + t.count("<|system|>") for t in whole.values())


def test_ids_with_several_vectors(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=8).tolist()) for i in range(60)]
    rows += [(i, r.normal(size=8).tolist()) for i in (20, 20, 3, 40, 7, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=12).collect()
    by = collections.defaultdict(list)
    for i, v in rows:
        by[i].append(v)
    found = collections.defaultdict(dict)
    for g in got:
        assert g.vec_id not in found[g.query_id].values()
        found[g.query_id][g.rank] = g.vec_id
    for q in (0, 20, 40):
        vec = min(by[q])
        scores = {i: max(np.dot(vec, v) for v in vs) for i, vs in by.items() if i != q}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:12]
        mine = [found[q][k] for k in range(1, 13)]
        assert len(set(mine) & set(want)) >= 10
        assert all(g.score == pytest.approx(scores[g.vec_id]) for g in got if g.query_id == q)
