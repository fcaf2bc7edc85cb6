"""Text, number and expression columns against plain Python."""

import hashlib
import random
from fractions import Fraction
from math import comb, gcd

import pytest
from pyspark.sql import functions as F

from textmill.functions import expressions, hashing, numbers, python_text, text
from textmill.operators import stats

TEXTS = ["", "  a b ", "\x1c x y\x85 ", "A-b c\n\nd\r\ne", "ß Straße", "123", "aXa aXa", "　z", "x\n", "-42", "tab\there", "a b\x0bc"]


def column(spark, col, values=TEXTS, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(col.alias("r")).collect()]


@pytest.mark.parametrize(
    "made,plain",
    [
        (lambda: text.strip_py("x"), str.strip),
        (lambda: text.split_lines_py("x"), lambda s: s.splitlines() if s else []),
        (lambda: text.split_words_py("x"), str.split),
        (lambda: text.swapcase("x"), lambda s: "".join(c.swapcase() if c.isascii() else c for c in s)),
        (lambda: text.find("x", "a"), lambda s: s.find("a")),
        (lambda: text.rfind("x", "aX"), lambda s: s.rfind("aX")),
        (lambda: text.count_text("x", "aX"), lambda s: s.count("aX")),
        (lambda: text.count_text("x", ""), lambda s: s.count("")),
        (lambda: text.pad("x", 9, "center", "*"), lambda s: s.center(9, "*")),
        (lambda: text.pad("x", 8, "center", "*"), lambda s: s.center(8, "*")),
        (lambda: text.pad("x", 7, "left"), lambda s: s.ljust(7)),
        (lambda: text.pad("x", 7, "right"), lambda s: s.rjust(7)),
        (lambda: text.zfill("x", 6), lambda s: s.zfill(6)),
        (lambda: text.is_class("x", "digit"), lambda s: s.isascii() and s.isdigit()),
        (lambda: text.partition("x", "X"), lambda s: s.partition("X")),
    ],
)
def test_text(spark, made, plain):
    got = column(spark, made())
    want = [plain(t) for t in TEXTS]
    assert [tuple(g) if isinstance(w, tuple) else g for g, w in zip(got, want, strict=True)] == want


def test_hash_thresholds(spark):
    import hashlib

    got = column(spark, hashing.holdout("x", 0.5, 7))
    want = [int(hashlib.sha256(f"split\0007\000{t.strip()}".encode()).hexdigest()[:16], 16) < 2**63 for t in TEXTS]
    assert got == want
    assert column(spark, hashing.fold("x", 7)) == [int(hashlib.sha256(t.encode()).hexdigest()[:16], 16) % 7 for t in TEXTS]


def test_numbers(spark):
    pairs = [(7, 2), (-7, 2), (7, -2), (-7, -2), (0, 5), (12, 18), (5, 0)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", numbers.euclid_mod("a", "b").alias("m"), numbers.euclid_div("a", "b").alias("d"), numbers.gcd("a", "b").alias("g"), numbers.rational("a", "b").alias("q"), numbers.floor_div("a", F.nullif("b", F.lit(0))).alias("f")).collect():
        if r.b == 0:
            assert (r.m, r.d, r.q) == (None, None, None)
            continue
        assert 0 <= r.m < abs(r.b) and r.a == r.d * r.b + r.m and r.g == gcd(r.a, r.b) and r.f == r.a // r.b
        q = Fraction(r.a, r.b)
        assert (r.q.num, r.q.den) == (q.numerator, q.denominator)


def test_pass_at_k(spark):
    cases = [(n, c, k) for n in (1, 3, 8) for c in range(-1, n + 2) for k in (0, 1, 2, n)]
    df = spark.createDataFrame(cases, "n int, c int, k int")
    for r in df.select("*", numbers.pass_at_k("n", "c", F.col("k")).alias("p")).collect():
        if not 0 <= r.c <= r.n or not 1 <= r.k <= r.n:
            assert r.p is None
        else:
            assert r.p == pytest.approx(1 - comb(r.n - r.c, r.k) / comb(r.n, r.k))


def test_quantifiers_over_empty_ranges(spark):
    one = spark.range(1)
    r = one.select(numbers.forall_range(F.lit(3), F.lit(3), lambda i: i < 0), numbers.exists_range(F.lit(3), F.lit(1), lambda i: i > 0)).first()
    assert tuple(r) == (True, False)


def test_expressions(spark):
    env = {"s": F.array(F.lit(3).cast("long"), F.lit(1).cast("long"), F.lit(2).cast("long"))}
    run = lambda ast: spark.range(1).select(expressions.compile_ast(ast, env)).first()[0]
    assert run(["at", ["var", "s"], 0]) == 3 and run(["at", ["var", "s"], 3]) is None
    assert run(["forall", "i", 0, ["len", ["var", "s"]], [">", ["at", ["var", "s"], ["var", "i"]], 0]]) is True
    assert run(["forall", "i", 5, 5, ["=", ["div", 1, 0], 1]]) is True
    assert run(["and", False, ["=", ["div", 1, 0], 1]]) is False
    assert run(["map", "x", ["filter", "y", ["var", "s"], [">", ["var", "y"], 1]], ["*", ["var", "x"], 10]]) == [30, 20]
    assert run(["fold", ["var", "s"], 0, ["a", "x"], ["+", ["var", "a"], ["var", "x"]]]) == 6
    assert run(["sum", ["seq"]]) == 0 and run(["slice", ["var", "s"], 1, 3]) == [1, 2] and run(["mod", -7, 3]) == 2
    for bad in (["while", 1], ["+", 1], ["var", "t"], [], ["at", 1, 2, 3]):
        with pytest.raises(expressions.IllFormed):
            expressions.compile_ast(bad, env)


def test_python_text():
    assert python_text.html_text("<p>a&amp;b<script>x</script><br>c <b>d</b></p><div>e") == "a&b\nc d\n\ne"
    assert python_text.decode_text(b"caf\xe9 au lait est bon")[:2] == ("café au lait est bon", "cp1252")
    assert python_text.decode_text("абв".encode("cp1251") * 20)[2] == "too many accents"
    assert python_text.decode_text(b"\xff\xfea\x00")[:2] == ("﻿a", "utf-16") or python_text.decode_text(b"\xff\xfea\x00")[0] == "a"
    assert python_text.calculate("1/3 + 1/6") == "1/2" and python_text.calculate("round(2.5)") == "3" and python_text.calculate("1/0") is None and python_text.calculate("-7 // 2") == "-4"
    assert python_text.tokens_any("Straße 東京都 x1") == ["strasse", "東京", "京都", "x1"]
    assert python_text.edits(list("kitten"), list("sitting")) == 3
    assert all(len(c) <= 2000 for c in python_text.chunks("word " * 3000 + "\n\nshort"))


def test_winnowing_guarantee():
    import random

    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    for at in (0, 7, 200):
        shared = noise(74)
        assert set(python_text.winnow(noise(at) + shared + noise(90))) & set(python_text.winnow(noise(33) + shared + noise(60)))
    assert python_text.winnow("") == [] and python_text.winnow(" \n") == [] and len(python_text.winnow("short")) == 1


def signed(digest):
    return int.from_bytes(digest[:8], "big", signed=True)


def test_winnowing_of_50_to_73_bytes_keeps_every_gram():
    text = "".join(chr(97 + k * k % 23) for k in range(73))
    for n in range(50, 74):
        want = {signed(hashlib.blake2b(text[i : i + 50].encode(), digest_size=8).digest()) for i in range(n - 49)}
        assert set(python_text.winnow(text[:n])) == want
        assert set(python_text.winnow(text[:n], digest="md5")) == {signed(hashlib.md5(text[i : i + 50].encode()).digest()) for i in range(n - 49)}


def test_winnowing_keeps_the_least_of_every_window():
    r = random.Random(9)
    text = "".join(r.choice("ab ä") for _ in range(300))
    data = text.encode()
    h = [int.from_bytes(hashlib.blake2b(data[i : i + 50], digest_size=8).digest(), "big") for i in range(len(data) - 49)]
    want = {min(h[i : i + 25]) for i in range(len(h) - 24)}
    assert {x % (1 << 64) for x in python_text.winnow(text)} == want


PAGES = [
    "<p>a&amp;b<script>x</script><br>c <b>d</b></p><div>e",
    "<!doctype html><html><head><title>T</title><style>p{}</style></head><body><noscript>n</noscript><template>t</template></body></html>",
    "<table><tr><td>1</td><td>2</td></tr></table><!-- gone <p>x</p> -->after",
    "a < b and c > d &lt;p&gt; &nbsp;x&#233;",
    "<SCRIPT src='a>b'>var x = '<p>';</SCRIPT >kept<script>open to the end",
    "<a title='1 > 0' href=\"<br>\">link</a><img alt=it's>z",
    "one<br/>two<hr>three\r\n\r\n\r\n\tfour  five",
    "",
]


def test_pages(spark):
    want = ["a&b\nc d\n\ne", "T\nnt", "1\n\n2\n\nafter", "a < b and c > d <p> \xa0xé", "kept", "linkz", "one\ntwo\nthree\n\nfour five", ""]
    assert [python_text.html_text(x) for x in PAGES] == want
    df = spark.createDataFrame(list(enumerate(PAGES)), "i int, html string")
    assert [r.t for r in df.select("i", python_text.page_text("html").alias("t")).orderBy("i").collect()] == want


def test_sentences():
    s = python_text.sentences
    assert s("One is here. two is not. Three is! \"Four?\" Five.") == ["One is here. two is not.", "Three is!", "\"Four?\"", "Five."]
    assert s("Am 3. März 2026 war es. Am 3. Mai nicht.") == ["Am 3. März 2026 war es.", "Am 3.", "Mai nicht."]
    assert s("今日は。明日は！\n\n- one item\n- two item\nrest of it") == ["今日は。", "明日は！", "- one item", "- two item rest of it"]
    assert s("a b\n \nok. No.") == ["a b", "ok.", "No."]
    long = "x" * 250 + ", " + "y" * 300
    assert s(long) == ["x" * 250 + ",", "y" * 300]
    assert [len(p) for p in s("z" * 900)] == [400, 400, 100] and s("w " * 300)[0] == ("w " * 200).strip()
    assert s("ab") == [] and s("") == []


def test_exact_statistics():
    assert stats.sign_test(0, 0) == (1.0, "1/1")
    assert stats.sign_test(8, 1)[1] == "5/128"
    assert stats.paired_permutation([1, 1, 1]) == Fraction(1, 4)
    assert stats.two_sample_permutation([5, 6], [1, 2]) == Fraction(2, 6)
    assert stats.best_reachable([5, 3, 2], 0.5) == 0.5
    assert [stats.decision(*x, 0.1) for x in ((0.2, 0.3), (-0.05, 0.05), (0.0, 0.4))] == ["adopt", "not meaningful", "inconclusive"]
