"""Budgets, reachable sums, number conventions and the record store against plain Python."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from textmill.functions import spans
from textmill.operators import retrieval, subset
from textmill.sources.store import Conflict, RecordStore


def plain_recall(records, budget, header):
    notes = sorted((r for r in records if r["kind"] == "note"), key=lambda r: (r["created"], r["id"]))
    others = sorted((r for r in records if r["kind"] != "note"), key=lambda r: (-r["score"], r["id"]))
    lines, ids = [header], []
    if len(header.encode()) + 3 <= budget:
        for r in notes + others:
            if len("\n".join([*lines, r["line"]]).encode()) + 3 <= budget:
                lines.append(r["line"])
                ids.append(r["id"])
    return ids


@pytest.mark.parametrize("budget", [5, 12, 60, 333])
def test_memory_recall(spark, budget):
    r = random.Random(budget)
    rows = [{"g": r.randrange(4), "id": i, "kind": r.choice(["note", "x", "x"]), "created": float(r.randrange(9)), "score": r.random(), "line": "é" * r.randrange(3) + "a" * r.choice([0, 1, 2, 9, 30, 400])} for i in range(300)]
    df = spark.createDataFrame(rows, "g int, id int, kind string, created double, score double, line string")
    got = retrieval.memory_recall(df, "g", "id", "kind", "created", "score", "line", "# head", budget).orderBy("g", "place").collect()
    for g in range(4):
        assert [x.id for x in got if x.g == g] == plain_recall([x for x in rows if x["g"] == g], budget, "# head")


def test_few_rows_of_a_group_are_candidates(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), "id", (F.col("id") % 50 + 1).alias("size"))
    some = retrieval.within_budget(df, ["g"], [F.col("id")], "size", 100)
    assert some.count() == sum(100 // s for s in range(1, 51))
    assert retrieval.within_budget(df.withColumn("size", F.lit(0)), ["g"], [F.col("id")], "size", 100).count() == 100  # empty rows


def plain_pick(paras, scores, limit):
    chosen, size = [], 0
    for score, i in sorted(((s, i) for i, s in scores.items()), key=lambda x: (-x[0], x[1])):
        if score <= 0:
            break
        n = len(paras[i][:limit])
        if size + n > limit and chosen:
            continue
        chosen.append(i)
        size += n
        if size >= limit * 0.9:
            break
    return sorted(chosen)


def test_page_pick(spark):
    r = random.Random(5)
    pages = {p: ["x" * r.choice([1, 5, 20, 60, 300]) for _ in range(r.randint(1, 30))] for p in range(12)}
    scores = {p: {i: round(r.choice([-1.0, 0.5, r.random()]), 3) for i in range(len(v)) if r.random() < 0.8} for p, v in pages.items()}
    s = spark.createDataFrame([(p, i, v) for p, d in scores.items() for i, v in d.items()], "page int, para int, score double")
    t = spark.createDataFrame([(p, i, x) for p, v in pages.items() for i, x in enumerate(v)], "page int, para int, text string")
    got = retrieval.page_pick(s, t, "page", "para", 100).orderBy("page", "given").collect()
    for p in pages:
        assert [x.para for x in got if x.page == p] == plain_pick(pages[p], scores[p], 100)


def plain_share(lengths, share, steps):
    total = sum(lengths)
    if not total:
        return 0.0
    scale = max(1, total // steps)
    most = int(total * share) // scale
    bits = 1
    for n in lengths:
        bits |= bits << max(1, n // scale)
        bits &= (1 << most + 1) - 1
    return (bits.bit_length() - 1) * scale / total


@pytest.mark.parametrize("lengths,share", [([], 0.1), ([0], 0.5), ([10], 0.1), ([10, 10, 10], 0.7), ([7, 11, 13, 500], 0.06), ([3] * 1000 + [1000, 999], 0.3)])
def test_reachable_share(spark, lengths, share):
    df = spark.createDataFrame([(n,) for n in lengths] + [(None,)], "n long")
    for steps in (200_000, 50):
        row = subset.best_share(df, "n", share, steps, 5).first()
        assert row.reached == plain_share(lengths, share, steps) and row.total == sum(lengths)


def test_many_lengths(spark):
    r = random.Random(6)
    lengths = [r.choice([6, 10, 15, r.randint(50_000, 90_000)]) * 1000 for _ in range(400)]
    row = subset.best_share(spark.createDataFrame([(n,) for n in lengths], "n long"), "n", 0.1, 5000, 16).first()
    assert row.reached == plain_share(lengths, 0.1, 5000)


def test_adding_sets_of_sums():
    r = random.Random(7)
    for n in (1, 3, 70, 900):
        a, b = (sum(1 << r.randrange(2000) for _ in range(n)) & ((1 << 1501) - 1) | 1 for _ in range(2))
        want = 0
        for i in range(1501):
            if a >> i & 1:
                want |= b << i
        assert subset.added(a, b, 1500) == want & ((1 << 1501) - 1)


def plain_numbers(text):
    found = [p for p in re.findall(r"\w+(?:[.,'’:/-]\w+)*", text) if re.fullmatch(r"\d(?:[\d.,]*\d)?", p)]
    sure = lambda pattern: any(re.fullmatch(pattern, p) for p in found)
    e, c = sure(r"\d{1,3}(,\d{3})+\.\d+|\d+\.\d{1,2}"), sure(r"\d{1,3}(\.\d{3})+,\d+|\d+,\d{2}")
    how = "mixed" if e and c else "continental" if c else "english"
    out = []
    for p in found:
        a = Fraction(p.replace(",", "")) if re.fullmatch(r"(\d{1,3}(,\d{3})+|\d+)(\.\d+)?", p) else None
        b = Fraction(p.replace(".", "").replace(",", ".")) if re.fullmatch(r"(\d{1,3}(\.\d{3})+|\d+)(,\d+)?", p) else None
        if a is None and b is None:
            out.append("unreadable")
        elif a is not None and b is not None and a != b and how == "mixed":
            out.append("two readings")
        else:
            out.append(b if a is None or how == "continental" and b is not None else a)
    return how, out


def test_number_conventions(spark):
    bits = ["1,250.00", "1.250,00", "1.250", "1,250", "12,5", "12.50", "12,50", "1,2,3", "v1.2", "7", "3:45", "2024-01-02", "99.", "(5)", "1.234.567", "0.125", "x"]
    r = random.Random(3)
    texts = ["", "no"] + [" ".join(r.choice(bits) for _ in range(r.randint(1, 5))) for _ in range(200)]
    pieces = spans.number_pieces("t")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", pieces).withColumn("how", spans.number_convention(F.col("p")))
    for row in df.select("t", "how", F.transform("p", lambda x: spans.read_number(x, F.col("how"))).alias("r")).collect():
        how, values = plain_numbers(row.t)
        assert row.how == how and [x.refused if x.value is None else Fraction(x.value) for x in row.r] == values


RECORDS = "id long, text string"


@pytest.fixture
def store(spark, tmp_path):
    return RecordStore(spark, str(tmp_path / "store"), "id", RECORDS)


def held(df):
    return sorted(map(tuple, df.collect()))


def files(store):
    return [n for n in store._names(r"segment-.*")]


def test_store(spark, store):
    rows = lambda *r: spark.createDataFrame(r, RECORDS)
    keys = lambda *k: spark.createDataFrame([(i,) for i in k], "id long")
    assert store.version() == 0 and held(store.read()) == [] and store.compact() == 0
    assert store.put(rows((1, "a"), (2, "b"), (2, "c"))) == 1 and held(store.read()) == [(1, "a"), (2, "c")]
    store.put(rows((2, "d"), (3, None)))
    store.forget(keys(1, 9))
    assert held(store.read()) == [(2, "d"), (3, None)] and held(store.read(1)) == [(1, "a"), (2, "c")]
    store.put(rows((1, "again")))
    assert held(store.export(keys(1, 2, 7))) == [(1, "again"), (2, "d")]
    assert store.compact() == 5 and held(store.read()) == [(1, "again"), (2, "d"), (3, None)]
    store.erase(keys(2))
    assert held(store.read()) == [(1, "again"), (3, None)] and store.versions() == [6] and len(files(store)) == 1
    assert spark.read.parquet(f"{store.path}/{files(store)[0]}").where("id = 2").isEmpty()  # nothing of it is left
    with pytest.raises(Exception, match="without a key"):
        store.put(rows((None, "x")))


def test_a_reader_keeps_its_version_during_compaction(spark, store):
    store.put(spark.range(100).select("id", F.lit("x").alias("text")))
    store.forget(spark.range(50).select("id"))
    reader = store.read()  # begun, not yet run
    store.compact()
    store.put(spark.range(50, 60).select("id", F.lit("new").alias("text")))
    assert reader.count() == 50 and reader.where("text = 'x'").count() == 50 and store.read().where("text = 'new'").count() == 10
    store.vacuum(1)
    assert store.read().count() == 50 and len(store.versions()) == 1


def test_two_writers(spark, store):
    store.put(spark.createDataFrame([(1, "a")], RECORDS))
    with pytest.raises(Conflict):
        store._commit(0, [])
    assert store.version() == 1 and held(store.read()) == [(1, "a")]


@pytest.mark.parametrize("block", [2000, 3])
def test_dense_in_blocks(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    r = np.random.default_rng(2)
    x = r.normal(size=(120, 8)).round(1)
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [None, *[1.0] * 7])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    got = retrieval.nearest(df, df.where("id % 10 = 0").withColumnRenamed("id", "q"), "id", "q", 6).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 120, 10):
        want = sorted(((-round(float(u[q] @ u[i]), 6) + 0.0, str(i)) for i in range(120)))[:6]
        assert [(-g.score + 0.0, str(g.id)) for g in sorted((g for g in got if g.q == q), key=lambda g: g.rank)] == want
    assert {g.q for g in got} == set(range(0, 120, 10))


@pytest.mark.parametrize("rounds", [10_000, 2])
def test_filled_split(spark, rounds):
    import hashlib

    from textmill.operators import dedup

    r = random.Random(rounds)
    for lengths in ([r.choice([0, 1, 2, 3, 50, 400, 3000]) for _ in range(300)], [5000, *[1] * 40], [10], [0, 0], []):
        rows = [(i, n) for i, n in enumerate(lengths)]
        got = {x.doc_id: x.split for x in dedup.filled_split(spark.createDataFrame(rows, "doc_id long, n long"), 0.1, 7, rounds).collect()}
        used, want = 0, {}
        for i, n in sorted(rows, key=lambda x: hashlib.sha256(f"7:{x[0]}".encode()).hexdigest()):
            fits = used + n <= sum(lengths) * 0.1
            used += n if fits else 0
            want[i] = "val" if fits else "train"
        if "train" not in want.values():
            want = dict.fromkeys(want, "train")
        assert got == want


def test_cited_passages(spark, tmp_path):
    import collections
    import math

    from textmill.functions import python_text as p
    from textmill.plans import registry

    r = random.Random(12)
    words = ["river", "東京都", "Straße", "stone", "über", "leaf", "sky", "12", "known", "far"]
    docs = [(i, " ".join(f"{' '.join(r.choice(words) for _ in range(r.randint(1, 9))).capitalize()}." for _ in range(r.randint(1, 30)))) for i in range(12)]
    items = [(1, "the RIVER 東京都 stone"), (2, "strasse leaf"), (3, "nothing here")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    index = {f"{i}:{k}": p.tokens_any(t) for i, text in docs for k, t in enumerate(p.passages(text), 1)}
    mean = sum(map(len, index.values())) / len(index)
    df = collections.Counter(w for ws in index.values() for w in set(ws))
    got = registry.QUERIES["cited_passages"](spark, str(tmp_path)).orderBy("item_id", "rank").collect()
    for item, text in items:
        scores = {}
        for key, ws in index.items():
            tf = collections.Counter(ws)
            shared = set(p.tokens_any(text)) & set(ws)
            if shared:
                scores[key] = round(sum(math.log((len(index) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in shared), 6)
        want = sorted(scores, key=lambda k: (-scores[k], k))[:5]
        assert [(g.passage, pytest.approx(scores[g.passage], abs=2e-6)) for g in got if g.item_id == item] == [(g, scores[g]) for g in want]


def test_error_rates(spark):
    from textmill.operators import transcripts

    def far(a, b):
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (x != y))
        return table[-1][-1]

    r = random.Random(4)
    text = lambda: " ".join(r.choice(["a", "B", "b", "cé", "D."]) for _ in range(r.randint(0, 12)))
    rows = [(r.randrange(3), text(), r.choice([text(), None])) for _ in range(80)] + [(0, None, "x"), (7, "", ""), (1, "same", "same")]
    df = spark.createDataFrame(rows, "g int, ref string, hyp string")
    for unit, cut in (("words", str.split), ("chars", list)):
        for name, norm, plain in (("none", None, lambda x: x), ("lower", lambda x: F.regexp_replace(F.lower(x), r"\.", ""), lambda x: x.lower().replace(".", ""))):
            got = {x.g: x for x in transcripts.error_rate(df, "ref", "hyp", norm, unit, ["g"]).collect()}
            for g in (0, 1, 2, 7):
                own = [(plain(a), plain(b or ""), b is None) for k, a, b in rows if k == g and a is not None]
                units, edits = sum(len(cut(a)) for a, _, _ in own), sum(far(cut(a), cut(b)) for a, b, _ in own)
                x = got[g]
                assert (x.pairs, x.missing, x.units, x.edits, x.rate) == (len(own), sum(m for *_, m in own), units, edits, edits / units if units else None), name
    whole = transcripts.error_rate(df.where("g > 99"), "ref", "hyp").collect()
    assert [(x.pairs, x.units, x.edits, x.rate) for x in whole] == [(0, 0, 0, None)]
