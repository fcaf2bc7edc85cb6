"""A compiler from expression trees (JSON lists) to columns.

A tree is a number, a boolean, or a list of an operator and its arguments:
["var", name], ["str", text], ["rat", n, d], ["seq", …], arithmetic and comparisons, ["ite", c, a, b],
["let", name, value, body], ["call", function, …], quantifiers ["forall" | "exists", name, lo, hi, body] over a
range or ["forall" | "exists", name, seq, body] over a sequence, comprehensions ["map" | "filter", name, seq, body],
["sort_by" | "min_by" | "max_by", name, seq, key], folds ["fold", seq, start, [acc, item], body], and the
collection and text functions below.

Every value carries whether it is defined: a place outside a sequence, a division by zero or a number beyond
64 bits has no value, which is not the same as false. What is not reached does not count: the right side of and,
or, implies that the left decides, the other branch of ite, what follows the element that decides a quantifier.
`compile_value` gives both; `compile_ast` gives null where there is no value. `with_values` adds many trees to a table:
what is computed outside of loops becomes columns, one after another, which Spark turns into generated code.

Functions of the user are inlined: each may call the ones before it, its arguments are computed once, and a
call of itself or of a later one is refused. An unknown operator, a wrong number of arguments or an unbound name is an
error at compile time; loops are not expressions and are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers, text

RATIONAL = "rational"


class IllFormed(ValueError):
    """The tree is no expression of the language."""


class Value(NamedTuple):
    """A column, whether it is defined (never null), and RATIONAL for exact fractions.

    simple: a literal, a column or a bound name, which may stand in an expression any number of times; `whole` is the struct
    that a computed value was taken from.
    """

    value: Column
    ok: Column
    kind: str = ""
    simple: bool = False
    whole: Column | None = None

    @property
    def packed(self) -> Column:
        return self.whole if self.whole is not None else F.struct(self.value.alias("v"), self.ok.alias("o"))

    @staticmethod
    def of(packed: Column, kind: str = "") -> Value:
        """A computed value."""
        return Value(packed["v"], packed["o"], kind, False, packed)

    @staticmethod
    def named(packed: Column, kind: str = "") -> Value:
        """A value that is bound to a name."""
        return Value(packed["v"], packed["o"], kind, True, packed)


class Function(NamedTuple):
    name: str
    parameters: list[str]
    body: object


def _at(s: Column, i: Column) -> Column:
    return F.when((i >= 0) & (i < F.size(s)), F.get(s, i.cast("int")))


def _update(s: Column, i: Column, v: Column) -> Column:
    return F.when((i >= 0) & (i < F.size(s)), F.transform(s, lambda x, k: F.when(k == i, v).otherwise(x)))


def _slice(s: Column, a: Column, b: Column) -> Column:
    return F.when((a >= 0) & (a <= b) & (b <= F.size(s)), F.slice(s, (a + 1).cast("int"), (b - a).cast("int")))


def _range(a: Column, b: Column) -> Column:
    return F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))


def _sum(s: Column) -> Column:
    return F.aggregate(s, F.lit(0).cast("long"), lambda x, y: F.try_add(x, y))


#: operator: (least and most number of arguments, whether it may have no value, how to build it)
OPERATORS: dict[str, tuple[int, int, bool, Callable[..., Column]]] = {
    "+": (2, 2, True, F.try_add),
    "-": (2, 2, True, F.try_subtract),
    "*": (2, 2, True, F.try_multiply),
    "neg": (1, 1, True, lambda a: F.try_subtract(F.lit(0).cast("long"), a)),
    "abs": (1, 1, False, F.abs),
    "div": (2, 2, True, numbers.euclid_div),
    "mod": (2, 2, True, numbers.euclid_mod),
    "gcd": (2, 2, False, numbers.gcd),
    "pow": (2, 2, True, numbers.power),
    "isqrt": (1, 1, True, numbers.isqrt),
    "min": (2, 9, False, F.least),
    "max": (2, 9, False, F.greatest),
    "=": (2, 2, False, lambda a, b: a == b),
    "!=": (2, 2, False, lambda a, b: a != b),
    "<": (2, 2, False, lambda a, b: a < b),
    "<=": (2, 2, False, lambda a, b: a <= b),
    ">": (2, 2, False, lambda a, b: a > b),
    ">=": (2, 2, False, lambda a, b: a >= b),
    "not": (1, 1, False, lambda a: ~a),
    "len": (1, 1, False, lambda s: F.size(s).cast("long")),
    "at": (2, 2, True, _at),
    "update": (3, 3, True, _update),
    "slice": (3, 3, True, _slice),
    "range": (2, 2, False, _range),
    "concat": (2, 2, False, F.concat),
    "rev": (1, 1, False, F.reverse),
    "sort": (1, 1, False, F.array_sort),
    "sum": (1, 1, True, _sum),
    "in": (2, 2, False, lambda x, s: F.array_contains(s, x)),
    "toset": (1, 1, False, lambda s: F.array_sort(F.array_distinct(s))),
    "union": (2, 2, False, lambda a, b: F.array_sort(F.array_union(a, b))),
    "inter": (2, 2, False, lambda a, b: F.array_sort(F.array_intersect(a, b))),
    "diff": (2, 2, False, lambda a, b: F.array_sort(F.array_except(a, b))),
    "strlen": (1, 1, False, lambda s: F.char_length(s).cast("long")),
    "lower": (1, 1, False, text.ascii_lower),
    "upper": (1, 1, False, text.ascii_upper),
    "strip": (1, 1, False, text.strip_py),
    "split": (1, 1, False, text.split_words_py),
    "tostr": (1, 1, False, lambda a: a.cast("string")),
    "toint": (1, 1, True, lambda s: F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("long"))),
    "mapget": (2, 2, True, lambda m, k: F.try_element_at(m, k)),
    "keys": (1, 1, False, lambda m: F.array_sort(F.map_keys(m))),
}

#: The same signs between fractions, and what leads from and to whole numbers: (result is a fraction, how to build it).
RATIONALS: dict[str, tuple[bool, Callable[..., Column]]] = {
    "+": (True, numbers.rational_add),
    "-": (True, numbers.rational_sub),
    "*": (True, numbers.rational_mul),
    "div": (True, numbers.rational_div),
    "neg": (True, numbers.rational_neg),
    "=": (False, lambda a, b: a == b),
    "!=": (False, lambda a, b: a != b),
    "<": (False, numbers.rational_less),
    ">": (False, lambda a, b: numbers.rational_less(b, a)),
    "<=": (False, lambda a, b: ~numbers.rational_less(b, a)),
    ">=": (False, lambda a, b: ~numbers.rational_less(a, b)),
    "floor": (False, lambda a: numbers.floor_div(a["num"], a["den"])),
    "ceil": (False, lambda a: -numbers.floor_div(-a["num"], a["den"])),
    "tostr": (False, lambda a: F.when(a["den"] == 1, a["num"].cast("string")).otherwise(F.concat_ws("/", a["num"], a["den"]))),
}


def _all(oks: Sequence[Column]) -> Column:
    out = F.lit(True)
    for ok in oks:
        out = out & ok
    return out


class _Compiler:
    """rows: the table that gets what is computed outside of loops as columns, if there is one; loops: how many are around what is compiled."""

    def __init__(self, functions: Sequence[Function], rows: DataFrame | None = None):
        self.rows, self.held, self.loops = rows, [], 0
        self.functions: dict[str, Function] = {}
        for f in functions:
            if f.name in self.functions:
                raise IllFormed(f"two functions {f.name}")
            self.functions[f.name] = f
        self.order = {name: i for i, name in enumerate(self.functions)}

    def value(self, ast, env: dict[str, Value], inside: int | None = None) -> Value:
        """The value of a tree; inside: the place of the function whose body it is."""
        if isinstance(ast, bool) or isinstance(ast, float):
            return Value(F.lit(ast), F.lit(True), simple=True)
        if isinstance(ast, int):
            return Value(F.lit(ast).cast("long"), F.lit(True), simple=True)
        if not isinstance(ast, list) or not ast or not isinstance(ast[0], str):
            raise IllFormed(f"not an expression: {ast!r}")
        op, args = ast[0], ast[1:]
        go = lambda x, more=None: self.value(x, {**env, **(more or {})}, inside)
        special = getattr(self, f"_{op}", None) if op in self.SPECIAL else None
        if special:
            return special(ast, go, env, inside)
        values = [go(a) for a in args]
        if op == "toreal" or any(v.kind == RATIONAL for v in values):
            return self._rational(ast, values)
        if op not in OPERATORS:
            raise IllFormed(f"unknown operator: {op}")
        least, most, partial, build = OPERATORS[op]
        if not least <= len(args) <= most:
            raise IllFormed(f"{op} takes {least} to {most} arguments: {ast!r}")

        def make(values: list[Value]) -> Value:
            made, ok = build(*[v.value for v in values]), _all([v.ok for v in values])
            return Value(made, ok & made.isNotNull() if partial else ok)

        return self._on(values, make)

    @property
    def _staged(self) -> bool:
        return self.rows is not None and not self.loops

    def column(self, v: Value) -> Value:
        """The value as a column of the rows, where it may be one: lambda functions are interpreted, columns are not."""
        if v.simple or not self._staged:
            return v
        name = f"_held{len(self.held)}"
        while name in self.rows.columns:
            name = f"_{name}"
        if v.whole is not None:
            self.held.append(name)
            self.rows = self.rows.withColumn(name, v.whole)
            return Value.named(F.col(name), v.kind)
        ok = f"{name}_ok"  # two columns: a struct would be taken apart and computed wherever it is used
        self.held += [name, ok]
        self.rows = self.rows.withColumns({name: v.value, ok: v.ok})
        return Value(F.col(name), F.col(ok), v.kind, True)

    def _on(self, values: list[Value], make: Callable[[list[Value]], Value]) -> Value:
        """What is made of the values, each computed once however often it is used: expressions grow with the tree, not faster."""
        values = [self.column(v) for v in values]
        if all(v.simple for v in values):
            return make(values)
        return self._bound({f"a{i}": v for i, v in enumerate(values)}, lambda bound: make(list(bound.values())))

    #: Forms that bind names, decide what is reached, or are no plain function of their arguments.
    SPECIAL = frozenset("var str rat seq and or implies ite let call forall exists map filter sort_by min_by max_by fold".split())

    def _rational(self, ast: list, values: list[Value]) -> Value:
        op = ast[0]
        if op == "toreal":
            _arity(ast, 1)
            stays, build = True, numbers.rational_whole
        elif op not in RATIONALS or len(values) != (1 if op in ("neg", "floor", "ceil", "tostr") else 2) or any(v.kind != RATIONAL for v in values):
            raise IllFormed(f"no such operator between fractions: {ast!r}")
        else:
            stays, build = RATIONALS[op]

        def make(values: list[Value]) -> Value:
            made = F.transform(F.array(build(*[v.value for v in values])), lambda m: F.struct(m.alias("v"), (_all([v.ok for v in values]) & m.isNotNull()).alias("o")))
            return Value.of(F.get(made, F.lit(0)), RATIONAL if stays else "")

        return self._on(values, make)

    def _var(self, ast, go, env, inside) -> Value:
        (name,) = _arity(ast, 1)
        if name not in env:
            raise IllFormed(f"unbound name: {ast!r}")
        return env[name]

    def _str(self, ast, go, env, inside) -> Value:
        return Value(F.lit(_arity(ast, 1)[0]), F.lit(True), simple=True)

    def _rat(self, ast, go, env, inside) -> Value:
        num, den = _arity(ast, 2)
        if not isinstance(num, int) or not isinstance(den, int) or den == 0:
            raise IllFormed(f"no fraction: {ast!r}")
        return Value(numbers.rational(F.lit(num), F.lit(den)), F.lit(True), RATIONAL)

    def _seq(self, ast, go, env, inside) -> Value:
        values = [go(a) for a in ast[1:]]
        if not values:
            return Value(F.array().cast("array<bigint>"), F.lit(True), simple=True)
        return self._on(values, lambda values: Value(F.array(*[v.value for v in values]), _all([v.ok for v in values])))

    def _decided(self, ast, go, stops: Callable[[Column], Column], stop_value: bool) -> Value:
        """Left to right, up to the first side that decides."""
        if len(ast) < 3:
            raise IllFormed(f"{ast[0]} takes two arguments or more: {ast!r}")

        def make(sides: list[Value]) -> Value:
            out = sides[-1]
            for v in reversed(sides[:-1]):
                out = Value(F.when(stops(v.value), stop_value).otherwise(out.value), v.ok & (stops(v.value) | out.ok))
            return out

        return self._on([go(a) for a in ast[1:]], make)

    def _and(self, ast, go, env, inside) -> Value:
        return self._decided(ast, go, lambda v: ~v, False)

    def _or(self, ast, go, env, inside) -> Value:
        return self._decided(ast, go, lambda v: v, True)

    def _implies(self, ast, go, env, inside) -> Value:
        _arity(ast, 2)
        return self._decided(ast, go, lambda v: ~v, True)

    def _ite(self, ast, go, env, inside) -> Value:
        c, a, b = (go(x) for x in _arity(ast, 3))
        if a.kind != b.kind:
            raise IllFormed(f"branches of two kinds: {ast!r}")
        choose = lambda c, a, b: Value(F.when(c.value, a.value).otherwise(b.value), c.ok & F.when(c.value, a.ok).otherwise(b.ok), a.kind)
        return self._on([c, a, b], lambda values: choose(*values))

    def _bound(self, values: dict[str, Value], body: Callable[[dict[str, Value]], Value], strict: bool = False) -> Value:
        """The body with names for values that are computed once; strict: all of them need a value, even those not used."""
        if self._staged:
            named = {name: self.column(v) for name, v in values.items()}
            out = self.column(body(named))
            return Value(out.value, out.ok & _all([v.ok for v in named.values()]), out.kind) if strict else out
        packed = F.struct(*[v.packed.alias(name) for name, v in values.items()])
        kind: list[str] = []

        def inner(s: Column) -> Column:
            named = {name: Value.named(s[name], v.kind) for name, v in values.items()}
            out = body(named)
            kind.append(out.kind)
            return self._on([out], lambda o: Value(o[0].value, o[0].ok & _all([v.ok for v in named.values()]))).packed if strict else out.packed

        return Value.of(F.get(F.transform(F.array(packed), inner), F.lit(0)), kind[0])

    def _let(self, ast, go, env, inside) -> Value:
        name, value, body = _arity(ast, 3)
        return self._bound({name: go(value)}, lambda more: go(body, more), strict=True)

    def _call(self, ast, go, env, inside) -> Value:
        if len(ast) < 2 or ast[1] not in self.functions:
            raise IllFormed(f"unknown function: {ast!r}")
        f = self.functions[ast[1]]
        if inside is not None and self.order[f.name] >= inside:
            raise IllFormed(f"{f.name} is called by itself or by one before it")
        if len(ast) - 2 != len(f.parameters):
            raise IllFormed(f"{f.name} takes {len(f.parameters)} arguments: {ast!r}")
        if not f.parameters:
            return self.value(f.body, {}, self.order[f.name])
        return self._bound(dict(zip(f.parameters, map(go, ast[2:]), strict=True)), lambda more: self.value(f.body, more, self.order[f.name]), strict=True)

    def _elements(self, ast, go, name: str, seq, body, make: Callable[[Column, str, str], Value]) -> Value:
        """What is made of the sequence's elements x with the body's value v and whether that is defined o (and the kinds of both)."""
        of, kinds = go(seq), []

        def inner(x: Column) -> Column:
            self.loops += 1
            out = go(body, {name: Value(x, F.lit(True), of.kind, True)})
            self.loops -= 1
            kinds.append(out.kind)
            return F.struct(x.alias("x"), out.packed.alias("r"))

        def outer(bound: list[Value]) -> Value:
            each = F.transform(bound[0].value, inner)
            packed = F.transform(F.array(each), lambda e: self._noted(make(e, of.kind, kinds[0]), kinds))
            made = self.column(Value.of(F.get(packed, F.lit(0))))
            return Value(made.value, bound[0].ok & F.coalesce(made.ok, F.lit(False)))

        out = self._on([of], outer) if not of.simple else outer([of])
        return out._replace(kind=kinds[-1])

    @staticmethod
    def _noted(v: Value, kinds: list[str]) -> Column:
        kinds.append(v.kind)
        return v.packed

    def _quantified(self, ast, go, wanted: bool) -> Value:
        if len(ast) == 5:
            name, lo, hi, body = ast[1:]
            seq = ["range", lo, hi]
        else:
            name, seq, body = _arity(ast, 3)

        def make(each: Column, of: str, kind: str) -> Value:
            decides = F.filter(each, lambda s: ~s["r"]["o"] | (s["r"]["v"] if wanted else ~s["r"]["v"]))
            first = F.get(decides, F.lit(0))
            return Value(first.isNotNull() if wanted else first.isNull(), F.coalesce(first["r"]["o"], F.lit(True)))

        return self._elements(ast, go, name, seq, body, make)

    def _forall(self, ast, go, env, inside) -> Value:
        return self._quantified(ast, go, False)

    def _exists(self, ast, go, env, inside) -> Value:
        return self._quantified(ast, go, True)

    def _each(self, ast, go, build: Callable[[Column], Column], stays: bool = True) -> Value:
        """A sequence or element made of elements whose bodies all have a value."""
        make = lambda each, of, kind: Value(build(each), F.forall(each, lambda s: s["r"]["o"]), of if stays else kind)
        return self._elements(ast, go, *_arity(ast, 3), make)

    def _map(self, ast, go, env, inside) -> Value:
        return self._each(ast, go, lambda each: F.transform(each, lambda s: s["r"]["v"]), False)

    def _filter(self, ast, go, env, inside) -> Value:
        return self._each(ast, go, lambda each: F.transform(F.filter(each, lambda s: s["r"]["v"]), lambda s: s["x"]))

    @staticmethod
    def _by_key(each: Column, sign: int = 1) -> Column:
        """Elements by key, equal keys in their order (by falling place for the last of the greatest keys: sign -1)."""
        return F.array_sort(F.transform(each, lambda s, i: F.struct(s["r"]["v"].alias("v"), (i * sign).alias("i"), s["x"].alias("x"))))

    def _sort_by(self, ast, go, env, inside) -> Value:
        return self._each(ast, go, lambda each: F.transform(self._by_key(each), lambda s: s["x"]))

    def _min_by(self, ast, go, env, inside) -> Value:
        out = self._each(ast, go, lambda each: F.get(self._by_key(each), F.lit(0))["x"])
        return self._on([out], lambda v: Value(v[0].value, v[0].ok & v[0].value.isNotNull(), out.kind))

    def _max_by(self, ast, go, env, inside) -> Value:
        out = self._each(ast, go, lambda each: F.get(F.reverse(self._by_key(each, -1)), F.lit(0))["x"])
        return self._on([out], lambda v: Value(v[0].value, v[0].ok & v[0].value.isNotNull(), out.kind))

    def _fold(self, ast, go, env, inside) -> Value:
        seq, start, names, body = _arity(ast, 4)
        of, first = go(seq), go(start)

        def make(values: list[Value]) -> Value:
            of, first = values

            def step(a: Column, x: Column) -> Column:
                self.loops += 1
                out = go(body, {names[0]: Value.named(a, first.kind), names[1]: Value(x, F.lit(True), of.kind, True)})
                self.loops -= 1
                both = F.transform(F.array(out.packed), lambda r: F.struct(r["v"].alias("v"), (a["o"] & r["o"]).alias("o")))
                return F.get(both, F.lit(0))

            end = self.column(Value.of(F.aggregate(of.value, first.packed, step), first.kind))
            return Value(end.value, of.ok & F.coalesce(end.ok, F.lit(False)), first.kind)

        return self._on([of, first], make)


def _arity(ast: list, n: int) -> list:
    if len(ast) != n + 1:
        raise IllFormed(f"{ast[0]} takes {n} arguments: {ast!r}")
    return ast[1:]


def compile_value(ast, env: dict[str, Column | Value], functions: Sequence[Function] = ()) -> Value:
    """The value of a tree and whether it is defined, with columns for its free names (a null column has no value)."""
    bound = {name: x if isinstance(x, Value) else Value(x, x.isNotNull(), simple=True) for name, x in env.items()}
    return _Compiler(functions).value(ast, bound)


def compile_ast(ast, env: dict[str, Column | Value], functions: Sequence[Function] = ()) -> Column:
    """The column of a tree: null where it has no value."""
    out = compile_value(ast, env, functions)
    return F.when(out.ok, out.value)


def with_values(rows: DataFrame, trees: dict[str, object], env: dict[str, Column], functions: Sequence[Function] = ()) -> DataFrame:
    """rows with a struct for each tree: v, its value, and o, whether it has one (where it has none, v means nothing)."""
    compiler = _Compiler(functions, rows)
    bound = {name: compiler.column(Value(x, x.isNotNull())) for name, x in env.items()}
    found = {name: compiler.column(compiler.value(tree, bound)) for name, tree in trees.items()}
    return compiler.rows.withColumns({name: v.packed for name, v in found.items()}).drop(*compiler.held)


def defined(x: Column) -> Column:
    return x.isNotNull()
