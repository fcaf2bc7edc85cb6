"""Operators on the edge rows that every suite must hold."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import dedup, evals, leakage, logs, retrieval, rows
from textmill.sources import files, sinks


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), (None, 3, "z")], "k string, o int, v string")
    assert {tuple(r) for r in dedup.first_per_key(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 1, None), (None, 3, "z")}
    assert {tuple(r) for r in dedup.last_per_key(df, ["k"], ["o"]).collect()} == {("a", 2, "x"), ("b", 1, None), (None, 3, "z")}


def test_copies_by_surroundings(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "a\nb"), (3, "\n\na\nb\n"), (4, "a  \nb"), (5, "c")], "doc_id long, text string")
    got = {tuple(r) for r in dedup.duplicate_of(df).collect()}
    assert got == {(2, 1, "exact"), (3, 1, "normalized"), (4, 1, "normalized")}


def judged(spark, sides, aligned=True):
    df = spark.createDataFrame(sides, "split string, text string")
    return leakage.verdict(leakage.content_overlap(df), leakage.document_overlap(df), leakage.line_overlap(df), aligned).first()


@pytest.mark.parametrize("n,level", [(2, "CLEAN"), (3, "CONTAMINATED"), (19, "CONTAMINATED"), (20, "CONTAMINATED")])
def test_line_floor(spark, n, level):
    lines = [f"line {i * 7919}" for i in range(n)]
    got = judged(spark, [("train", "\n".join(lines) + "\nmore"), ("val", "\n".join(lines[::-1]))])
    assert got.verdict == level and got.reason == ("line" if level != "CLEAN" else "")


def test_line_arm_between_bars(spark):
    sides = lambda n, shared: [("train", "\n".join(f"t{i * 7919}" for i in range(40))), ("val", "\n".join([f"t{i * 7919}" for i in range(shared)][::-1] + [f"v{i * 104729}" for i in range(n - shared)]))]
    assert judged(spark, sides(20, 10)).verdict == "SUSPECT" and judged(spark, sides(19, 16)).verdict == "CLEAN"
    assert judged(spark, [("train", "  a"), ("val", "a")]).line_share == 0.0  # lines count unchanged


def test_content_arm_alone(spark):
    passage = " ".join(f"word{i * 31 % 97}" for i in range(40))
    sides = [("train", "an opening of its own, then " + passage + " and another end"), ("val", "elsewhere: " + passage + ", as they say")]
    got = judged(spark, sides)
    assert (got.document_share, got.line_share) == (0.0, 0.0) and got.content_share > 0.5 and (got.verdict, got.reason) == ("CONTAMINATED", "content")


def test_document_arm_needs_whole_documents(spark):
    sides = [("train", "short one"), ("train", "x"), ("val", "short one"), *[("val", f"other {k}") for k in range(20)]]
    assert judged(spark, sides).verdict == "SUSPECT" and judged(spark, sides).reason == "document"
    assert judged(spark, sides, aligned=False).verdict == "CLEAN"


def test_membership_does_not_depend_on_other_rows(spark):
    r = random.Random(1)
    data = [(i, "w" * r.randint(1, 50) + str(i)) for i in range(120)]
    whole = {x.doc_id: x.split for x in dedup.hash_split(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    part = {x.doc_id: x.split for x in dedup.hash_split(spark.createDataFrame(data[:40], "doc_id long, text string")).collect()}
    assert part.items() <= whole.items()


def test_more_contaminated_documents_than_any_report_shows(spark):
    gram = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(i, f"x{i} {gram} y") for i in range(60)] + [(99, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, gram), (8, gram + " tail")], "item_id long, text string")
    got = leakage.first_matches(docs, bench).collect()
    assert len(got) == 60 and all(r.owners == [7, 8] and r.pos == 1 for r in got)


def test_bm25_negative_idf_and_empty_query(spark):
    docs = spark.createDataFrame([(i, "common rare" if i == 0 else "common other") for i in range(4)], "id long, text string")
    q = spark.createDataFrame([(1, "common"), (2, ""), (3, "absent")], "q long, text string")
    got = retrieval.top_k(retrieval.bm25(docs, q, "id", "q"), "q", "id", 2).collect()
    assert {r.q for r in got} == {1} and all(r.score < 0 for r in got) and len(got) == 2


def test_min_max_flat_and_zero_vector(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0)], "g int, k int, v double")
    got = retrieval.memory_rank(df, "g", "k", F.lit(3.0), F.col("v"), F.col("v")).collect()
    assert [r.score for r in got] == [0.0, 0.0]
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "k int, embedding array<double>")
    q = v.where("k = 2").withColumnRenamed("k", "q")
    assert {r.k: r.score for r in retrieval.dense(v, q, "k", "q").collect()} == {1: 0.0, 2: 1.0}


def test_copies_do_not_use_up_a_cap(spark):
    df = spark.createDataFrame([(1, "g", "a"), (2, "g", "a"), (3, "g", "b"), (4, "g", "c")], "o int, g string, v string")
    unique = dedup.first_per_key(df, ["g", "v"], ["o"])
    assert sorted(r.o for r in rows.cap_per_group(unique, ["g"], [F.col("o")], 2).collect()) == [1, 3]


def test_event_pairs(spark):
    ev = [(1, "end", 5), (2, "start", 1), (2, "start", 3), (2, "end", 7), (3, "start", 9), (3, "end", 4), (4, "start", 2)]
    df = spark.createDataFrame([(k, e, t, i) for i, (k, e, t) in enumerate(ev)], "k int, ev string, s int, o int").withColumn("t", F.timestamp_seconds("s"))
    got = {(r.k, r.seconds) for r in logs.paired_seconds(df, ["k"], "ev", "t", ["o"], "start", "end").collect()}
    assert got == {(2, 4.0), (3, 0.0)}
    assert {r.k for r in logs.still_open(df, ["k"], "ev", ["o"], "start", "end").collect()} == {4}


def test_first_fit(spark):
    a = F.array(*[F.lit(x) for x in (5, 4, 3, 2, 1)])
    assert spark.range(1).select(retrieval.first_fit(a, lambda x: x, 8)).first()[0] == [5, 3]


def test_auroc_one_class_and_calibration(spark):
    df = spark.createDataFrame([(1, 0.2, 1), (2, 0.2, 1)], "k int, s double, y int")
    assert evals.auroc(df, "s", "y").first()[0] is None
    both = spark.createDataFrame([(1, 0.1, 0), (2, 0.9, 1), (3, 0.5, 1), (4, 0.5, 0)], "k int, s double, y int")
    assert evals.auroc(both, "s", "y").first()[0] == 0.875


def test_json_policies(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": \n{"a": 2, "b": " "}\n{"a": 3')
    assert sorted(r.a for r in files.json_lines(spark, str(p), "a int").collect()) == [1, 2]
    assert files.json_lines(spark, str(p), "a int", "report").where("_corrupt_record is not null").count() == 2
    with pytest.raises(Exception):
        files.json_lines(spark, str(p), "a int", "fail").collect()
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    assert [r.line for r in files.numbered_lines(spark, str(p)).orderBy("line").collect()] == [1, 3, 4, 5]
    q = tmp_path / "y.jsonl"
    q.write_text('{"a": 1, "b": "new"}\n')
    got = files.merged_json(spark, [str(p), str(q)], "a int, b string", "a").where("a = 1").first()
    assert got.b == "new"


def test_folder_reasons(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_bytes(b"a\0b")
    (tmp_path / "c.png").write_bytes(b"x")
    got = {r.path.split("/")[-1]: r.reason for r in files.folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": None, "b.txt": "binary", "c.png": "suffix"}
    assert files.search(files.folder(spark, str(tmp_path)), "HELL", True).count() == 1


def test_markdown_cells(spark, tmp_path):
    (tmp_path / "t.md").write_text("intro\n\n| task | k1 | k2 |\n|---|---|---|\n| a | ok / bad | ok |\n\n| task | k3 |\n|:-|-:|\n| b | x / y |\n")
    got = {tuple(r)[1:] for r in files.markdown_cells(spark, str(tmp_path)).collect()}
    assert got == {("a", "k1", "ok", "bad"), ("a", "k2", "ok", None), ("b", "k3", "x", "y")}


def test_token_shards_round_trip(spark, tmp_path):
    docs = [(i, [i % 7] * (i % 5 + 1)) for i in range(50)]
    shards = sinks.shard_bytes(spark.createDataFrame(docs, "k long, ids array<int>"), "k", "ids", 40)
    sinks.write_shards(shards, str(tmp_path / "s"))
    got = files.token_shards(spark, str(tmp_path / "s")).orderBy("file").collect()
    assert sum((r.ids for r in got), []) == sum((d[1] for d in docs), []) and len(got) > 1


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    sinks.write_json_lines(df, str(tmp_path / "o"), ["k"])
    assert [r.k for r in spark.read.json(str(tmp_path / "o")).orderBy("k").collect()] == [1, 2]
    with pytest.raises(Exception):
        sinks.write_json_lines(df, str(tmp_path / "o"), ["k"])


def test_streaming_intervals(spark, tmp_path):
    from textmill.streaming import tail

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text('{"ev":"start","t":1.0,"pid":1,"task":"a","kernel":"k"}\n{"ev":"start","t":2.0,"pid":2,"task":"b","kernel":"k"}\ntorn')
    stream = tail.intervals(tail.tail(spark, str(log), "ev string, t double, pid long, task string, kernel string"))

    def run():
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {(r.pid, r.status, r.seconds) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert run() == {(1, "open", 0.0), (2, "open", 0.0)}
    (log / "2.json").write_text('{"ev":"end","t":4.5,"pid":1,"task":"a","kernel":"k"}\n')
    assert (1, "ended", 3.5) in run()
