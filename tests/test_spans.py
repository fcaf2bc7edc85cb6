"""Small text functions, sources, sinks and resampling against plain values."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from textmill.functions import spans
from textmill.operators import assembly, chars, leakage, ordered, review, rows
from textmill.sources import files, sinks
from textmill.streaming import tail


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value,sentence,found",
    [
        ("art", "the party", False), ("art", "an art.", True), ("12", "in 2012", False), ("12", "12 men", True), ("東京", "今日東京都", True), ("é", "café", False),
        ("a.b", "axb a.b", True), ("a.b", "axb", False), ("", "x", False), ("\\E(", "so \\E( it", True), ("x東", "ax東京", False),
    ],
)
def test_stated_in(spark, value, sentence, found):
    assert one(spark, spans.stated_in(F.col("v"), F.col("s")), v=value, s=sentence) is found


def test_numbers_and_agreement(spark):
    found = one(spark, spans.numbers_in(F.col("s")), s="1,250.50 of 3 (v2.1) and -7, 4x")
    assert [float(x) for x in found] == [1250.5, 3.0, -7.0]
    d = lambda *xs: F.array(*[F.lit(x).cast("decimal(38,10)") for x in xs])
    used = one(spark, spans.ungrounded(d(20, 0.2, 0.8, 1.2, 5), d(20)))
    assert [float(x) for x in used] == [5.0]
    assert one(spark, spans.agreed(F.array(F.lit(3), F.lit(None).cast("int"), F.lit(3)))) == 3
    assert one(spark, spans.agreed(F.array(F.lit(3), F.lit(None).cast("int")))) is None and one(spark, spans.agreed(F.array(F.lit(3), F.lit(4)))) is None
    assert one(spark, spans.confirmed(F.lit(3), F.array(F.lit(3), F.lit(4)), 2)) is None


def test_runs_and_maximal_spans(spark):
    assert one(spark, spans.runs(F.split(F.lit("a b c"), " "), 2)) == ["a", "a b", "b", "b c", "c"]
    assert one(spark, spans.runs(F.array().cast("array<string>"))) == []
    assert one(spark, spans.maximal(F.split(F.lit("ab,abc,x,abc,bc"), ","))) == ["abc", "x"]


def test_whole_lines_and_chunks(spark):
    lines = F.split(F.lit("ab\ncd\nefghij\nk"), "\n")
    assert [one(spark, spans.whole_lines(lines, F.octet_length, n)) for n in (1, 2, 4, 5, 100)] == [[], ["ab"], ["ab"], ["ab", "cd"], ["ab", "cd", "efghij", "k"]]
    s = F.split(F.lit("a|b|c|d|e"), r"\|")
    assert one(spark, spans.sentence_chunks(s, F.lit(10))) == ["a b c d e"] and one(spark, spans.sentence_chunks(s, F.lit(700))) == ["a", "b", "c", "d", "e"]


def test_integers_and_mutations(spark):
    assert [one(spark, spans.to_int(F.col("x")), x=x) for x in ("-7", "007", "1.5", "x", "")] == [-7, 7, None, None, None]
    assert sorted(one(spark, spans.mutations(F.lit(1).cast("long")))) == [-1, 0, 2] and sorted(one(spark, spans.mutations(F.lit(0).cast("long")))) == [-1, 1]
    got = one(spark, spans.list_mutations(F.array(F.lit(1), F.lit(2))))
    assert sorted(map(list, got)) == [[], [1], [1, 2, 2], [2], [2, 1]]
    assert [1, 2] not in got and one(spark, spans.list_mutations(F.array().cast("array<int>"))) == []


@pytest.mark.parametrize("pos,neg,rate,want", [(5, 5, 0.6, (2, 3)), (5, 1, 0.6, (4, 1)), (1, 5, 0.2, (1, 4)), (5, 5, 1, (0, 5)), (5, 5, 0.0, (5, 0))])
def test_noise_mix(spark, pos, neg, rate, want):
    p, n = spans.noise_mix(F.lit(pos), F.lit(neg), rate, 5)
    assert (one(spark, p), one(spark, n)) == want


def test_bytes_and_json():
    assert spans.undecodable(b"a\xff\xc3") == 2 and spans.undecodable("é".encode()) == 0
    assert [spans.utf8_edge("aé東😀".encode()[:n]) for n in (1, 2, 3, 4, 5, 6, 7, 9, 10)] == [x.encode() for x in ("a", "a", "aé", "aé", "aé", "aé東", "aé東", "aé東", "aé東😀")]
    assert spans.utf8_edge(b"") == b"" and spans.utf8_edge(b"\x80\x80") == b"\x80\x80"
    a, b = '{"b": [1, 2], "a": "é"}', '{"a":"é","b":[1,2]}'
    assert spans.json_digest(a) == spans.json_digest(b) == spans.json_digest(json.dumps(a)) == hashlib.sha256(b.encode()).hexdigest()
    assert spans.json_digest("{") is None
    assert spans.stage_fingerprint({"x": "1", "y": "2"}, {"k": 3}) == spans.stage_fingerprint({"y": "2", "x": "1"}, {"k": 3}) != spans.stage_fingerprint({"x": "1", "y": "2"}, {"k": 4})
    assert spans.squeezed_lines(" a  b \n\n\n\n c ") == "a b\n\nc"


def test_resampling():
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 3.0, 4.0, 5.0]
    mean = lambda x, y: sum(y) / len(y) - sum(x) / len(x)
    assert review.bootstrap(a, b, mean, paired=True, draws=500) == (1.0, 1.0)
    low, high = review.bootstrap(a, b, mean, paired=False, draws=2000)
    assert low < 0 < 1 < high
    exact = sum(abs(s1 * 3 + s2 * 2 + s3) >= 6 for s1 in (1, -1) for s2 in (1, -1) for s3 in (1, -1)) / 8
    assert review.sign_flips([3, 2, 1, 0]) == pytest.approx(exact, abs=0.02) and review.sign_flips([0, 0]) == 1.0


def test_exact_median(spark):
    r = random.Random(1)
    for n in (1, 2, 7, 500):
        values = [float(r.randint(0, 40)) for _ in range(n)]
        want = (sorted(values)[(n - 1) // 2] + sorted(values)[n // 2]) / 2
        assert ordered.median(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").first()["median"] == want


def test_needles_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "NEEDLES", 3)
    docs = spark.createDataFrame([(k, f"text number {k} ends") for k in range(30)], "doc_id long, text string")
    needles = spark.createDataFrame([(k, f"number {k} ") for k in range(0, 30, 3)], "item long, needle string")
    got = leakage.containing(docs, needles).select("doc_id", "item").collect()
    assert sorted(map(tuple, got)) == [(k, k) for k in range(0, 30, 3)]


def test_first_matches_by_a_shuffle(spark, monkeypatch):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x " * 30), (3, "A, " + ", ".join(words[5:20]).upper()), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words[6:20])), (8, "too short")], "item_id long, text string")
    want = [(1, 6, [7]), (3, 2, [7])]
    for held in (leakage.HELD_GRAMS, 0):
        monkeypatch.setattr(leakage, "HELD_GRAMS", held)
        assert [(r.doc_id, r.pos, r.owners) for r in leakage.first_matches(docs, bench).orderBy("doc_id").collect()] == want


def test_frozen_rows_must_be_a_prefix(spark):
    df = spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "p", "a")], "i long, prompt string, chosen string")
    assert sorted((r.i, r.frozen) for r in assembly.after_frozen(df, df.where("i < 2"), "i", "prompt", "chosen").collect()) == [(1, True), (2, False)]
    with pytest.raises(ValueError):
        assembly.after_frozen(df, df.where("i = 2").withColumn("chosen", F.lit("z")), "i", "prompt", "chosen").count()
    assert assembly.after_frozen(df, df.limit(0), "i", "prompt", "chosen").count() == 2


def test_gates_come_before_deduplication(spark):
    df = spark.createDataFrame([(1, 1, "same", False), (1, 2, "same", True), (1, 3, "other", True)], "task long, n long, text string, ok boolean")
    got = assembly.training_rows(df, "task", "text", "n", [("refused", ~F.col("ok"))], 5).collect()
    assert sorted((r.n, r.place) for r in got) == [(2, 1), (3, 2)]


def test_character_codes(spark):
    df = spark.createDataFrame([(1, "abca"), (2, "é😀b"), (3, "")], "k long, text string")
    vocab = chars.vocabulary(df.where("k < 3"))
    ids = chars.codes(df.union(spark.createDataFrame([(4, "a?b")], "k long, text string")), vocab, "k")
    assert {r.k: r.ids for r in ids.collect()} == {1: [0, 1, 2, 0], 2: [3, 4, 1], 3: [], 4: [0, 1]}
    assert {r.k: r.text for r in chars.decoded(ids, vocab, "k").collect()} == {1: "abca", 2: "é😀b", 3: "", 4: "ab"}


def test_characters_and_trigrams(spark):
    texts = ["abab", "é😀é", "", None, "x", "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.ch: r.n for r in chars.counts(df).collect()} == {"a": 3, "b": 3, "é": 2, "😀": 1, "x": 1}
    got = {chr(r.a) + chr(r.b) + chr(r.c): r.n for r in chars.trigram_counts(df).collect()}
    assert got == {"aba": 1, "bab": 1, "é😀é": 1}


def test_reserved_tier(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "b", 2), (1, "c", 3), (2, "b", 4), (2, "c", 5), (2, "c", 6)], "g long, t string, n long")
    got = rows.tiered(df, ["g"], "t", [F.col("n")], {"a": 2, "b": 2, "c": 1}, 4, {"c": ("b", 2)}).collect()
    assert sorted(r.n for r in got) == [1, 2, 4, 5]


def test_sources(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("7 some text\n\n8\n9  two  words\n")
    assert [tuple(r) for r in files.key_text(spark, str(tmp_path / "keys.txt")).orderBy("key").collect()] == [("7", "some text"), ("8", ""), ("9", "two  words")]
    (tmp_path / "stage.txt").write_text("100644 aaa 0\ta b.py\n120000 bbb 0\tlink\n100755 ccc 2\tx\n")
    assert [(r.path, r.content) for r in files.git_stage(spark, str(tmp_path / "stage.txt")).orderBy("object").collect()] == [("a b.py", True), ("link", False), ("x", False)]
    (tmp_path / "extract.json").write_text('{"1": {"stage": "task", "why": "", "name": "f"}, "2": {"stage": "parse", "why": "at \'x\'"}}')
    (tmp_path / "tests.json").write_text('{"1": {"overall": "pass", "name": "f"}}')
    (tmp_path / "kernels.md").write_text("| task | k1 | k2 |\n|-|-|-|\n| f | ok / no | bad / no |\n")
    got = {r.key: r for r in files.answer_set(spark, str(tmp_path)).collect()}
    assert got["1"].cells == {"k1": "ok", "k2": "bad"} and got["1"].overall == "pass" and got["2"].cells is None and got["2"].overall is None
    assert files.keyed_json(spark, str(tmp_path / "none.json"), "a string").count() == 0


def test_reports_and_stages(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n long, t string")
    assert sinks.markdown(df.orderBy("n")) == "| n | t |\n|-|-|\n| 1 | a\\|b |\n| 2 |  |\n"
    with pytest.raises(ValueError):
        sinks.markdown(df, 1)
    runs = []

    def build():
        runs.append(1)
        return df

    path = str(tmp_path / "stage")
    for fingerprint in ("x", "x", "y"):
        assert sinks.built_once(spark, path, fingerprint, build).count() == 2
    assert len(runs) == 2


def test_latest_rows_of_a_stream(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("".join(f'{{"i": {k * 10 + j}}}\n' for j in range(10)))
    stream = tail.tail(spark, str(tmp_path / "in"), "i long", files_per_batch=1)
    query = tail.keep_latest(stream, str(tmp_path / "out"), ["i"], 4).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(p.name for p in (tmp_path / "out").iterdir())
    assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "out" / last)).collect()) == [26, 27, 28, 29]
