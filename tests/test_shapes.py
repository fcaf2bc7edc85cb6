"""Table functions, drawn inputs and twins against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from textmill.functions.udtfs import Elements, lateral
from textmill.operators import draws, twins
from textmill.plans import registry


def test_lateral_with_chosen_columns(spark):
    rows = [(1, "<p>a</p><h1 id=x>b\nc</h1><p class='y'>d<b>e</b></p><px>no</px>"), (2, None), (3, ""), (4, "<p>open")]
    df = spark.createDataFrame(rows, "id int, html string")
    got = lateral(df, Elements, "html", F.lit("p,h1"), F.lit("place,name,text,begin,chars"), keep=["id"])
    assert got.columns == ["id", "place", "name", "text", "begin", "chars"]
    assert [tuple(r) for r in got.orderBy("place").collect()] == [(1, 1, "p", "a", 3, 1), (1, 2, "h1", "b\nc", 17, 3), (1, 3, "p", "d<b>e</b>", 38, 9)]


@pytest.mark.parametrize("names,fields", [("p", "size"), ("", "text")])
def test_wrong_arguments_are_refused_when_planned(spark, names, fields):
    with pytest.raises(Exception, match="no such fields|constant text"):
        lateral(spark.createDataFrame([("x",)], "html string"), Elements, "html", F.lit(names), F.lit(fields)).columns


def test_any_class_can_be_joined(spark):
    class Halves:
        @staticmethod
        def analyze(n):
            from pyspark.sql.types import LongType, StructType
            from pyspark.sql.udtf import AnalyzeResult

            return AnalyzeResult(StructType().add("half", LongType()))

        def eval(self, n):
            while n:
                yield (n,)
                n //= 2

    got = lateral(spark.range(6), Halves, "id")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 3), (4, 1), (4, 2), (4, 4), (5, 1), (5, 2), (5, 5)]


def at(seed, key, draw, *slot):
    return int(hashlib.sha256(":".join(map(str, (seed, key, draw, *slot))).encode()).hexdigest()[:13], 16)


def test_ints_keep_sign_and_size(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([0, 5, -7, 100, None])], "k long, v long")
    got = draws.drawn(rows, "k", "v", "int", 200, 3).collect()
    by = {k: [r.value for r in got if r.k == k] for k in range(5)}
    assert by[4] == [] and all(len(by[k]) == 200 for k in range(4))
    assert set(by[0]) == {0, 1, 2} and min(by[1]) == 0 and max(by[1]) == 10 and min(by[2]) == -14 and max(by[2]) == 0 and 100 < max(by[3]) <= 200
    assert by[1] == [at(3, 1, d, "size") % 11 for d in range(1, 201)]
    larger = [r.value for r in draws.drawn(rows, "k", "v", "int", 400, 3, True).where("k = 1").collect()]
    assert 0.55 < sum(x > 10 for x in larger) / 400 < 0.85 and 40 <= max(larger) <= 200 and any(10 < x <= 30 for x in larger)


def test_sequences_keep_their_shape(spark):
    rows = spark.createDataFrame([(1, [3, 5, 9]), (2, [9, 3]), (3, []), (4, [4])], "k long, v array<long>")
    got = draws.drawn(rows, "k", "v", "seq", 300, 3).collect()
    for k, lo, hi, most, ordered in ((1, 1, 11, 5, True), (2, 1, 11, 4, False), (3, -6, 6, 3, False), (4, 2, 6, 3, True)):
        vals = [r.value for r in got if r.k == k]
        flat = [x for v in vals for x in v]
        assert {len(v) for v in vals} == set(range(most + 1)) and min(flat) == lo and max(flat) == hi
        assert all(v == sorted(v) for v in vals) is ordered
    d = next(r for r in got if r.k == 2 and len(r.value) == 4)
    assert d.value == [1 + at(3, 2, d.draw, i) % 11 for i in range(1, 5)]
    sizes = [len(r.value) for r in draws.drawn(rows, "k", "v", "seq", 300, 3, True).where("k = 1").collect()]
    assert max(sizes) >= 28 and 0.5 < sum(n > 5 for n in sizes) / 300 < 0.9


def test_rows_keep_their_shape(spark):
    rows = spark.createDataFrame([(1, [[97, 99], [98]]), (2, [])], "k long, v array<array<long>>")
    got = draws.drawn(rows, "k", "v", "rows", 200, 3).collect()
    first = [r.value for r in got if r.k == 1]
    assert {len(v) for v in first} == set(range(5)) and {len(x) for v in first for x in v} == set(range(5)) and {c for v in first for x in v for c in x} == set(range(95, 102))
    assert any(x != sorted(x) for v in first for x in v)
    assert {len(r.value) for r in got if r.k == 2} == {0, 1, 2}


def test_twins(spark):
    mine, theirs = [], []
    for key, answers in {
        "agrees": [("1", "1"), ("2", "2"), (None, "3"), ("4", None)],
        "near": [(str(i), str(i) if i else "x") for i in range(20)],
        "differs": [("1", "2"), ("1", "1")],
        "silent": [(None, "1"), ("1", None)],
    }.items():
        for d, (a, b) in enumerate(answers):
            mine += [(key, d, a)] if a is not None or key == "silent" else []
            theirs += [(key, d, b)] if b is not None else []
    frame = lambda rows: spark.createDataFrame(rows, "key string, draw int, answer string")
    got = {r.key: r for r in twins.verdicts(twins.pair_answers(frame(mine), frame(theirs), ["key"], "draw", "answer"), ["key"], "draw").collect()}
    assert {k: (r.verdict, r.twin) for k, r in got.items()} == {"agrees": ("agrees", True), "near": ("near twin", True), "differs": ("differs", False), "silent": ("no draw answered by both", True)}
    a = got["agrees"]
    assert (a.draws, a.answered_by_both, a.agreed, a.differed, a.program_silent, a.reference_silent, a.witness, a.differ_fraction) == (4, 2, 2, 0, 1, 1, None, None)
    assert (got["near"].witness, got["near"].differ_fraction) == (0, 0.05)


def test_signatures(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("b", 2, None), ("b", 1, "x"), ("c", 1, "x"), ("c", 2, "y"), ("d", 1, "!"), ("d", 2, None)]
    got = {r.key: r.signature for r in twins.signatures(spark.createDataFrame(rows, "key string, draw int, answer string"), ["key"], "draw", "answer").collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 3 and re.fullmatch("[0-9a-f]{64}", got["a"])


def test_quote_check_tests_the_whole_claim(spark, tmp_path):
    head = "these are the first twenty characters"
    turns = {1: [f"  {head}\n and more ", f"so: {head} and  more, he said"], 2: [f"{head} and more", f"{head} but less"], 3: [" \n", "anything"]}
    spark.createDataFrame([(c, i, x) for c, xs in turns.items() for i, x in enumerate(xs)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.quoted for r in registry.QUERIES["quote_check"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False, 3: False}
