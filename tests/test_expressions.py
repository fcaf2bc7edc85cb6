"""The expression compiler against a plain interpreter, undefined values included."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from textmill.functions import expressions as x
from textmill.functions import numbers


class Undefined(Exception):
    pass


def value(ast, env, functions=()):
    """What a tree means, evaluated in order; Undefined where it has no value."""
    if not isinstance(ast, list):
        return ast
    op, args = ast[0], ast[1:]
    go = lambda a, **more: value(a, {**env, **more}, functions)

    def fit(n):
        if isinstance(n, int) and not isinstance(n, bool) and not -(2**63) <= n < 2**63:
            raise Undefined
        return n

    match op:
        case "var":
            return env[args[0]]
        case "rat":
            return Fraction(*args)
        case "seq":
            return [go(a) for a in args]
        case "and":
            return all(go(a) for a in args)
        case "or":
            return any(go(a) for a in args)
        case "implies":
            return not go(args[0]) or go(args[1])
        case "ite":
            return go(args[1]) if go(args[0]) else go(args[2])
        case "let":
            return go(args[2], **{args[0]: go(args[1])})
        case "call":
            f = next(f for f in functions if f.name == args[0])
            return value(f.body, dict(zip(f.parameters, [go(a) for a in args[1:]], strict=True)), functions)
        case "forall" | "exists":
            *_, body = args
            seq = go(args[1]) if len(args) == 3 else range(go(args[1]), go(args[2]))
            each = (go(body, **{args[0]: i}) for i in seq)
            return all(each) if op == "forall" else any(each)
        case "map":
            return [go(args[2], **{args[0]: i}) for i in go(args[1])]
        case "filter":
            return [i for i, keep in [(i, go(args[2], **{args[0]: i})) for i in go(args[1])] if keep]
        case "sort_by":
            return sorted(go(args[1]), key=lambda i: go(args[2], **{args[0]: i}))
        case "min_by" | "max_by":
            seq = go(args[1])
            if not seq:
                raise Undefined
            return (min if op == "min_by" else max)(seq, key=lambda i: go(args[2], **{args[0]: i}))
        case "fold":
            acc = go(args[1])
            for i in go(args[0]):
                acc = go(args[3], **{args[2][0]: acc, args[2][1]: i})
            return acc
    v = [go(a) for a in args]
    match op:
        case "+" | "-" | "*":
            return fit({"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}[op](*v))
        case "div" | "mod":
            if v[1] == 0:
                raise Undefined
            if isinstance(v[0], Fraction):
                return v[0] / v[1]
            r = v[0] % abs(v[1])
            return r if op == "mod" else (v[0] - r) // v[1]
        case "at":
            if not 0 <= v[1] < len(v[0]):
                raise Undefined
            return v[0][v[1]]
        case "len":
            return len(v[0])
        case "range":
            return list(range(*v))
        case "min" | "max":
            return (min if op == "min" else max)(v)
        case "not":
            return not v[0]
        case "=" | "!=" | "<" | "<=" | ">" | ">=":
            a, b = v
            return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        case "toreal":
            return Fraction(v[0])
        case "floor":
            return v[0].numerator // v[0].denominator
        case "ceil":
            return -(-v[0].numerator // v[0].denominator)
    raise AssertionError(op)


FUNCTIONS = [
    x.Function("third", ["s"], ["at", ["var", "s"], 2]),
    x.Function("ratio", ["a", "b"], ["div", ["var", "a"], ["var", "b"]]),
    x.Function("twice", ["a"], ["+", ["call", "ratio", ["var", "a"], 1], ["var", "a"]]),
    x.Function("zero", [], 0),
]


def trees(r, depth, kind, names):
    """Random trees of a kind (int, bool, seq) over names of ints."""
    if depth == 0:
        return {"int": r.choice([["var", r.choice(names)], r.randint(-3, 4)]), "bool": r.random() < 0.5, "seq": ["seq", *[r.randint(-2, 3) for _ in range(r.randint(0, 3))]]}[kind]
    t = lambda k, more=(): trees(r, depth - 1, k, [*names, *more])
    i = f"i{depth}"
    options = {
        "int": [
            lambda: [r.choice(["+", "-", "*", "div", "mod", "min"]), t("int"), t("int")], lambda: ["at", t("seq"), t("int")], lambda: ["len", t("seq")], lambda: ["ite", t("bool"), t("int"), t("int")],
            lambda: ["let", i, t("int"), t("int", [i])], lambda: ["call", "ratio", t("int"), t("int")], lambda: ["call", "twice", t("int")], lambda: ["call", "third", t("seq")],
            lambda: ["fold", t("seq"), t("int"), [f"a{depth}", i], t("int", [f"a{depth}", i])], lambda: [r.choice(["min_by", "max_by"]), i, t("seq"), t("int", [i])],
        ],
        "bool": [
            lambda: [r.choice(["and", "or", "implies"]), t("bool"), t("bool")], lambda: ["not", t("bool")], lambda: [r.choice(["=", "<", ">="]), t("int"), t("int")],
            lambda: [r.choice(["forall", "exists"]), i, t("seq"), t("bool", [i])], lambda: [r.choice(["forall", "exists"]), i, r.randint(-1, 1), t("int"), t("bool", [i])],
        ],
        "seq": [lambda: ["seq", t("int"), t("int")], lambda: ["map", i, t("seq"), t("int", [i])], lambda: ["filter", i, t("seq"), t("bool", [i])], lambda: ["sort_by", i, t("seq"), t("int", [i])], lambda: ["range", r.randint(-1, 1), r.randint(-1, 4)]],
    }
    return r.choice(options[kind])()


def test_against_an_interpreter(spark):
    r = random.Random(8)
    rows = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
    df = spark.createDataFrame(rows, "a long, b long").coalesce(1)
    undefined = 0
    for _ in range(10):
        some = [trees(r, 2 + (k == "int"), k, ["a", "b"]) for k in ("int", "bool", "seq", "bool", "int")]
        values = [x.compile_value(t, {"a": F.col("a"), "b": F.col("b")}, FUNCTIONS) for t in some]
        got = df.select("a", "b", *[F.struct(F.when(v.ok, v.value).alias("v"), v.ok.alias("o")).alias(f"c{i}") for i, v in enumerate(values)]).collect()
        for row in got:
            for i, t in enumerate(some):
                try:
                    want = (value(t, {"a": row.a, "b": row.b}, FUNCTIONS), True)
                except Undefined:
                    want, undefined = (None, False), undefined + 1
                assert tuple(row[f"c{i}"]) == want, (t, row)
    assert undefined > 20


def run(spark, ast, functions=(), **env):
    v = x.compile_value(ast, {k: F.lit(e) for k, e in env.items()}, functions)
    return spark.range(1).select(F.when(v.ok, v.value).alias("v"), v.ok.alias("o")).first()


def test_undefined_is_not_false(spark):
    bad = ["=", ["div", 1, 0], 1]
    for ast, want in ((bad, (None, False)), (["and", False, bad], (False, True)), (["and", bad, False], (None, False)), (["or", True, bad], (True, True)), (["or", bad, True], (None, False)), (["implies", False, bad], (True, True)),
                      (["not", bad], (None, False)), (["ite", bad, 1, 1], (None, False)), (["min", 1, ["div", 1, 0]], (None, False)), (["seq", ["div", 1, 0]], (None, False)), (["len", ["seq", ["div", 1, 0]]], (None, False)),
                      (["forall", "i", ["seq", 1, 0], ["=", ["div", 1, ["var", "i"]], 2]], (False, True)), (["forall", "i", ["seq", 0, 1], ["=", ["div", 1, ["var", "i"]], 2]], (None, False))):
        assert tuple(run(spark, ast)) == want, ast
    big = 2**62
    assert tuple(run(spark, ["+", big, big])) == (None, False) and tuple(run(spark, ["*", big, 4])) == (None, False)
    assert tuple(run(spark, ["var", "n"], n=None)) == (None, False)


def test_fractions(spark):
    half, third = ["rat", 1, 2], ["rat", -2, -6]
    got = lambda ast: run(spark, ["tostr", ast]).v
    assert [got([op, half, third]) for op in ("+", "-", "*", "div")] == ["5/6", "1/6", "1/6", "3/2"] and got(["div", ["toreal", 6], ["toreal", 3]]) == "2"
    assert [run(spark, [f, ["rat", n, 2]]).v for f in ("floor", "ceil") for n in (-3, 3)] == [-2, 1, -1, 2]
    assert run(spark, ["<", third, half]).v is True and run(spark, ["<=", half, ["rat", 2, 4]]).v is True and run(spark, ["=", half, third]).v is False
    assert tuple(run(spark, ["div", half, ["rat", 0, 5]])) == (None, False) and tuple(run(spark, ["*", ["rat", 2**62, 1], ["rat", 4, 1]])) == (None, False)
    assert got(["rat", 9007199254740993, 1]) == "9007199254740993"


def test_whole_powers_and_roots(spark):
    p = lambda a, b: spark.range(1).select(numbers.power(F.lit(a).cast("long"), F.lit(b).cast("long"))).first()[0]
    assert [p(2, 10), p(-3, 3), p(0, 0), p(7, 0), p(-1, 99), p(1, 10**9), p(0, 5), p(2, 62), p(2, 63), p(3, 90), p(2, -1)] == [1024, -27, 1, 1, -1, 1, 0, 2**62, None, None, None]
    roots = [0, 1, 3, 4, 15, 16, 10**18, 10**18 - 1, 2**63 - 1, -1, (2**31 - 1) ** 2, (2**31 - 1) ** 2 - 1]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(roots)], "i int, v long").orderBy("i").select(numbers.isqrt(F.col("v"))).collect()
    from math import isqrt

    assert [g[0] for g in got] == [isqrt(v) if v >= 0 else None for v in roots]


@pytest.mark.parametrize(
    "ast,functions",
    [
        (["call", "f", 1], [x.Function("f", ["a"], ["call", "f", ["var", "a"]])]),
        (["call", "f", 1], [x.Function("f", ["a"], ["call", "g", ["var", "a"]]), x.Function("g", ["a"], 1)]),
        (["call", "g"], [x.Function("g", ["a"], 1)]), (["call", "h"], []), (["+", ["rat", 1, 2], 1], []), (["rat", 1, 0], []), (["while", True], []),
        (["call", "f", 1], [x.Function("f", ["a"], ["var", "b"])]), (["let", "a", 1], []), (["__init__", 1], []), (["value", 1], []), (["call", "f", 1], [x.Function("f", ["a"], 1), x.Function("f", ["a"], 2)]),
    ],
)
def test_refused(spark, ast, functions):
    with pytest.raises(x.IllFormed):
        x.compile_value(ast, {}, functions)


def test_values_as_columns(spark):
    """Trees that are added to a table: as the interpreter has them; what is outside of loops is computed in columns, once."""
    r = random.Random(9)
    df = spark.createDataFrame([(a, b) for a in range(-2, 3) for b in range(-2, 3)], "a long, `_held0` long").coalesce(1)
    some = {f"c{i}": trees(r, 2 + (k == "int"), k, ["a", "b"]) for i, k in enumerate(("int", "bool", "seq", "int", "bool", "seq", "int", "bool"))}
    rows = x.with_values(df, some, {"a": F.col("a"), "b": F.col("_held0")}, FUNCTIONS)
    assert rows.columns == ["a", "_held0", *some]
    for row in rows.collect():
        for name, t in some.items():
            try:
                want = (value(t, {"a": row.a, "b": row._held0}, FUNCTIONS), True)
            except Undefined:
                want = (None, False)
            assert (row[name].v if row[name].o else None, row[name].o) == want, (t, row)
    nulls = x.with_values(spark.sql("SELECT CAST(NULL AS BIGINT) AS a"), {"c": ["+", ["var", "a"], 1], "d": ["and", False, ["=", ["var", "a"], 1]]}, {"a": F.col("a")}).first()
    assert nulls.c.o is False and tuple(nulls.d) == (False, True)


def test_fractions_are_reduced_once(spark):
    from textmill.plans import registry

    plan = registry.QUERIES["total_expressions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 3  # two quotients and their sum; what is whole, or upside down, is in lowest terms
    assert plan.count("transform(") < 20
    whole = ["toreal", -(2**63)]
    assert run(spark, ["tostr", whole]).v == str(-(2**63)) and tuple(run(spark, ["tostr", ["neg", whole]])) == (None, False) and tuple(run(spark, ["tostr", ["div", ["rat", 1, 3], whole]])) == (None, False)
