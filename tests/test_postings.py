"""BM25 and shared terms from one row a document: blocks and steps of any size, ties, and no shuffle of pairs."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import retrieval
from textmill.plans import registry

K1, B = {"index": 1.5, "memory": 1.2, "page": 1.5}, 0.75


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [False, True])
def test_postings_in_blocks_and_steps(spark, monkeypatch, small):
    if small:
        for name, n in (("QUERY_BLOCK", 2), ("TERM_BLOCK", 5), ("CELLS", 7), ("STEP_TERMS", 9), ("BROADCAST_ROWS", 3)):
            monkeypatch.setattr(retrieval, name, n)
    r = random.Random(5)
    texts = {i: " ".join(r.choice("a b c d e f".split()) for _ in range(r.choice([1, 2, 2, 9]))) for i in range(60)} | {90: "", 91: None}
    asked = {1: "a b", 2: "A a c", 3: "", 4: "zzz", 5: "f", 6: "a b c d e f", 7: None}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "q long, text string")
    words, terms = {i: (t or "").split() for i, t in texts.items()}, {q: set((t or "").lower().split()) for q, t in asked.items()}
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    n, mean = len(words), sum(map(len, words.values())) / (len(words) - 1)  # the null text has no length
    p = retrieval.Postings(docs, queries, "id", "q")
    for kind in ("index", "memory", "page", "overlap", "hits"):
        want = {}
        for q, ts in terms.items():
            for i, ws in words.items():
                shared = ts & set(ws)
                if not shared:
                    continue
                tf = collections.Counter(ws)
                if kind in K1:
                    idf = lambda w: math.log((kind != "index") + (n - df[w] + 0.5) / (df[w] + 0.5))  # noqa: B023, E731
                    k1 = K1[kind]
                    want[q, i] = sum(idf(w) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - B + B * len(ws) / mean)) for w in shared)
                else:
                    want[q, i] = float(len(shared) if kind == "overlap" else sum(tf[w] for w in shared))
        best = {(x.q, x.rank): (x.id, x.score) for x in p.best(kind, 4).collect()}
        for q in terms:
            first = sorted((-round(s, 6), str(i)) for (o, i), s in want.items() if o == q)[:4]
            assert [(str(best[q, k][0]), pytest.approx(-best[q, k][1], abs=1e-9)) for k in range(1, len(first) + 1)] == [(i, s) for s, i in first] and (q, len(first) + 1) not in best
        if kind == "memory":
            every = p.bm25(kind, every=True)
            assert {(x.q, x.id): x.score for x in every.collect()} == pytest.approx({(q, i): want.get((q, i), 0.0) for q in asked for i in texts})
        if kind in K1:
            pairs = p.bm25(kind)
            assert {(x.q, x.id): x.score for x in pairs.collect()} == pytest.approx(want) and "Exchange" not in plan(pairs)


@pytest.mark.parametrize("name", ["bm25_topk", "overlap_topk", "bm25_page_topk", "rrf_fusion", "few_shot", "fixture_search", "passage_pick", "cited_passages", "bm25_memory_scores"])
def test_pairs_are_not_aggregated_in_a_shuffle(spark, name):
    got = plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Join" not in got and ("HashAggregate" not in got or name == "rrf_fusion")
    assert name != "bm25_memory_scores" or "Exchange" not in got


def task_memory(spark, run):
    """Bytes of execution memory of the task that took most while `run` ran."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    store = sc.statusStore()
    rows = lambda seq: [seq.apply(i) for i in range(seq.size())]
    stages = lambda: {(s.stageId(), s.attemptId()) for s in rows(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()))}
    before = stages()
    run()
    sc.listenerBus().waitUntilEmpty()
    tasks = [t for key in stages() - before for t in rows(store.taskList(*key, 1000))]
    return max(t.taskMetrics().get().peakExecutionMemory() for t in tasks if t.taskMetrics().isDefined())


@pytest.mark.parametrize("name", ["bm25_topk", "few_shot"])
def test_memory_of_a_task_does_not_grow_with_the_documents(spark, tmp_path, name):
    most = []
    for n in (2_000, 20_000):
        spark.range(n).selectExpr("id AS doc_id", "concat('a w', id % 7, ' v', id % 3) AS text").coalesce(1).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        spark.range(200).selectExpr("id AS item_id", "concat('a b w', id % 7) AS text").coalesce(1).write.parquet(f"{tmp_path}/{n}/benchmark.parquet")
        most.append(task_memory(spark, lambda: registry.QUERIES[name](spark, f"{tmp_path}/{n}").write.format("noop").mode("overwrite").save()))  # noqa: B023
    assert 0 < most[1] < 1.2 * most[0]  # every document meets every query: 4 million pairs


def test_several_keys_order_ties_by_value(spark):
    docs = spark.createDataFrame([(i, s, ["a"]) for i in (10, 9, 2) for s in (1, 0)], "d long, s long, w array<string>")
    queries = spark.createDataFrame([(1, "a b")], "q long, text string")
    got = retrieval.Postings(docs, queries, ["d", "s"], "q", words=F.col("w")).best("overlap", 3).orderBy("rank").collect()
    assert [(g.d, g.s, g.score) for g in got] == [(2, 0, 1.0), (2, 1, 1.0), (9, 0, 1.0)]


def test_lines_meet_by_digests(spark):
    from textmill.operators import leakage

    rows = [("train", "a\n\n b \n　\nlong line"), ("train", "a\na"), ("val", "a\r\nlong line\n \t\n\x0b\nb\nnew\na"), ("val", None), ("val", ""), ("val", "\x85  b ")]
    df = spark.createDataFrame(rows, "split string, text string")
    got = leakage.line_overlap(df)
    assert tuple(got.first()) == (6, 4)
    shuffled = [line for line in plan(got).splitlines() if "hashpartitioning" in line]
    assert shuffled and all("hashpartitioning(h#" in line or "hashpartitioning(_groupingexpression" in line for line in shuffled)


@pytest.mark.parametrize("name", ["split_overlap_lines", "split_overlap_docs", "leakage_verdict", "winnow_fingerprint_overlap"])
def test_split_texts_are_not_joined(spark, monkeypatch, name):
    from textmill.operators import ordered

    monkeypatch.setattr(ordered.small, "__defaults__", (10,))  # as if there were too many documents for a broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [doc_id" not in got and "hashpartitioning(doc_id" not in got
