"""Program keys, row leaks and the leak check against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textmill.functions import programs
from textmill.operators import leaks

ONE = """version 1
gate loops
task sumTo(n: int) returns (r: int)
  requires n >= 0 // not negative
  ensures forall k :: 0 <= k ==> r >= k
{
  var total := 0; var i := 0;
  while i < n { let d := i + 1; total := total + d; i := d; }
  return total;
}
"""


def renamed(text, **names):
    return re.sub(r"[A-Za-z_]\w*", lambda m: names.get(m.group(), m.group()), text)


def test_renamed_copies_have_one_form():
    other = renamed(ONE, sumTo="f", n="upTo", r="res", k="q", total="acc", i="j", d="step").replace("gate loops", "gate arrays").replace("version 1", "version 0").replace("// not negative", "/* what\never */")
    assert programs.erased(other) == programs.erased(ONE)
    assert "%" in programs.erased(ONE) and "sumTo" not in programs.erased(ONE) and "loops" not in programs.erased(ONE)


@pytest.mark.parametrize("a,b", [("total + d", "total - d"), ("n >= 0", "n > 0"), ("i < n", "n < i"), ("let d := i + 1", "let d := total + 1"), ("return total", "return i")])
def test_other_programs_have_others(a, b):
    assert programs.erased(ONE.replace(a, b)) != programs.erased(ONE)


def test_scopes():
    shadow = "def f(x: int) { { let x := 1; g(x); } h(x); }"
    assert programs.erased(shadow) == programs.erased("def f(y: int) { { let z := 1; g(z); } h(y); }")
    assert programs.erased(shadow) != programs.erased("def f(y: int) { { let z := 1; g(z); } h(z); }")
    assert programs.erased("g(x)") != programs.erased("h(x)")  # free names count
    assert programs.erased("let a, b := 1; a b") == programs.erased("let c, d := 1; c d") != programs.erased("let c, d := 1; d c")
    assert programs.erased('let a := "a";') == 'let %1 := "a" ;'
    assert programs.erased("def f(n: int) { f(n) } def g(n: int) { f(n) }") == programs.erased("def a(m: int) { a(m) } def b(k: int) { a(k) }")
    assert programs.erased(") ] }") == ") ] }" and programs.erased("") == ""


def test_row_leaks(spark):
    fence = lambda p: f"so\n```t\n{p}```\n"
    other = ONE.replace("total + d", "total * d")
    spec_only = ONE.replace("return total", "return 7")
    held = [(1, "vericoding_da0007__x", fence(ONE)), (2, "plain", "no program")]
    rows = [
        (10, "vericoding_DA0007", "no program"), (11, "a", fence(renamed(ONE, sumTo="h", i="j"))), (12, "b", fence(spec_only)), (13, "c", fence(ONE.replace("n >= 0", "n >= 1"))),
        (14, "d", "no program"), (15, "vericoding_da0008", fence(other.replace("ensures", "ensures true ensures"))), (16, None, None),
    ]
    frame = lambda r: spark.createDataFrame(r, "id long, name string, chosen string").withColumn("k", programs.keys("chosen"))
    stem = F.nullif(F.regexp_extract(F.lower("name"), r"^vericoding_([a-z]{2}\d{4})", 1), F.lit(""))
    keys = {"stem": [("stem", stem)], "text": [("program", F.col("k.program")), ("spec", F.col("k.spec"))]}
    got = dict(map(tuple, leaks.row_leaks(frame(rows), frame(held), "id", keys).collect()))
    assert got == {10: "stem", 11: "text", 12: "text"}


def test_keys_of_one_kind_meet_alone(spark):
    rows, held = spark.createDataFrame([(1, "x", None)], "id int, a string, b string"), spark.createDataFrame([(2, None, "x")], "id int, a string, b string")
    keys = {"a": [("a", F.col("a"))], "b": [("b", F.col("b"))]}
    assert leaks.row_leaks(rows, held, "id", keys).collect() == []
    assert [tuple(r) for r in leaks.row_leaks(rows, rows, "id", keys).collect()] == [(1, "a")]


def brute(texts, items):
    from textmill.functions.spans import UNSPACED

    edge = rf"[^\W{UNSPACED}]"
    out = []
    for doc, text in texts:
        for item, needle, words in items:
            if not text or not needle:
                continue
            before = f"(?<!{edge})" if re.match(edge, needle[0]) else ""
            after = f"(?!{edge})" if re.match(edge, needle[-1]) else ""
            pattern = f"{before}{re.escape(needle)}{after}" if words else re.escape(needle)
            n = len(re.findall(f"(?={pattern})", text))
            out += [(doc, item, needle, n)] if n else []
    return sorted(out)


@pytest.mark.parametrize("chars", [2_000_000, 12])
def test_leak_check(spark, chars):
    r = random.Random(4)
    bits = ["art", "party", "art_2", "a", "東京", "東", "京都art", "http://x.org/a?b=1", "x.org", "Über", "über", "aa", "é", " ", ".", "-", "_"]
    texts = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for i in range(200)] + [(900, None), (901, ""), (902, "aaaa")]
    items = [(i, b, w) for i, (b, w) in enumerate((b, w) for b in bits if b.strip() for w in (True, False))] + [(90, "", True), (91, None, False), (92, "art", True)]
    got = leaks.leak_check(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item int, needle string, words boolean"), chars)
    assert got.columns == ["doc_id", "item", "needle", "words", "hits"]
    assert sorted((r.doc_id, r.item, r.needle, r.hits) for r in got.collect()) == brute(texts, items)


def test_leak_check_of_nothing(spark):
    items = spark.createDataFrame([], "needle string, words boolean")
    assert leaks.leak_check(spark.createDataFrame([(1, "x")], "doc_id long, text string"), items).collect() == []


def test_hundred_thousand_names_in_one_pass(spark):
    names = spark.range(100_000).select(F.concat(F.lit("name"), "id").alias("needle"), F.lit(True).alias("words"))
    texts = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("so name"), F.col("id") * 7, F.lit(" and xname1, name2x")).alias("text"))
    got = leaks.leak_check(texts, names)
    assert got.count() == 3000 and got.agg(F.sum("hits")).first()[0] == 3000
