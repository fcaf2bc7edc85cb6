"""Integer, rational and statistical expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c


def euclid_mod(x: Column | str, y: Column | str) -> Column:
    """The remainder that is never negative; null for y = 0."""
    y = c(y)
    return F.when(y != 0, F.pmod(c(x), F.abs(y)))


def euclid_div(x: Column | str, y: Column | str) -> Column:
    """The quotient that goes with euclid_mod."""
    x, y = c(x), c(y)
    return F.when(y != 0, ((x - euclid_mod(x, y)) / y).cast("long"))


def floor_div(x: Column | str, y: Column | str) -> Column:
    x, y = c(x), c(y)
    m = F.pmod(x, y)
    m = F.when((m != 0) & ((m < 0) != (y < 0)), m + y).otherwise(m)
    return F.when(y != 0, ((x - m) / y).cast("long"))


def gcd(x: Column | str, y: Column | str) -> Column:
    """Greatest common divisor by Euclid's steps: at most 1.45 times the bits of the smaller number, and a few."""
    return _euclid(F.abs(c(x)), F.abs(c(y)), lambda g: g)


def _euclid(x: Column, y: Column, end: Callable[[Column], Column]) -> Column:
    """What is made of the greatest common divisor of two numbers from 0; null if either is null."""
    steps = (F.log2(F.least(x, y).cast("double") + 1) * 1.45 + 3).cast("int")
    start = F.struct(x.alias("a"), y.alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: end(s["a"]))


def rational(num: Column | str, den: Column | str) -> Column:
    """struct(num, den) in lowest terms with a positive denominator; null for den = 0 and where either is null."""
    # a list of one entry: what is computed once has a name inside
    pair = F.struct(c(num).cast("long").alias("n"), c(den).cast("long").alias("d"))

    def lowest(s: Column) -> Column:
        sign = F.when(s["d"] < 0, -1).otherwise(1)
        over = lambda g: F.struct(*[F.call_function("div", s[x] * sign, g).alias(name) for x, name in (("n", "num"), ("d", "den"))])
        return F.when(s["n"].isNotNull() & (s["d"] != 0), _euclid(F.abs(s["n"]), F.abs(s["d"]), over))

    return F.get(F.transform(F.array(pair), lowest), F.lit(0))


def rational_whole(num: Column | str) -> Column:
    """A whole number as a fraction."""
    return F.struct(c(num).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))


def rational_add(a: Column, b: Column) -> Column:
    """The sum; null where a number on the way is beyond 64 bits (as for the others)."""
    times = F.try_multiply
    return rational(F.try_add(times(a["num"], b["den"]), times(b["num"], a["den"])), times(a["den"], b["den"]))


def rational_sub(a: Column, b: Column) -> Column:
    times = F.try_multiply
    return rational(F.try_subtract(times(a["num"], b["den"]), times(b["num"], a["den"])), times(a["den"], b["den"]))


def rational_mul(a: Column, b: Column) -> Column:
    return rational(F.try_multiply(a["num"], b["num"]), F.try_multiply(a["den"], b["den"]))


def rational_div(a: Column, b: Column) -> Column:
    """The quotient; null for b = 0. b upside down is in lowest terms as it is."""
    sign = F.when(b["num"] < 0, -1).otherwise(1).cast("long")
    return rational(F.try_multiply(a["num"], b["den"] * sign), F.try_multiply(a["den"], F.try_multiply(b["num"], sign)))


def rational_neg(a: Column) -> Column:
    num = F.try_subtract(F.lit(0).cast("long"), a["num"])
    return F.when(num.isNotNull(), F.struct(num.alias("num"), a["den"].alias("den")))


def rational_less(a: Column, b: Column) -> Column:
    return F.try_multiply(a["num"], b["den"]) < F.try_multiply(b["num"], a["den"])


def power(base: Column, exponent: Column) -> Column:
    """base ** exponent for exponents from 0; null below 0 or beyond 64 bits."""
    odd = F.pmod(exponent, F.lit(2)) == 1
    one = F.lit(1).cast("long")
    steps = F.when((exponent > 0) & (exponent < 64), F.sequence(one, exponent)).otherwise(F.array().cast("array<bigint>"))
    product = F.aggregate(steps, one, lambda p, _: F.try_multiply(p, base))
    small = F.when(base == -1, F.when(odd, -one).otherwise(one)).otherwise(F.when(exponent == 0, one).otherwise(base))
    return F.when(exponent < 0, None).when(F.abs(base) <= 1, small).when(exponent < 64, product)


def isqrt(x: Column) -> Column:
    """The whole square root; null below 0."""
    near = F.floor(F.sqrt(x.cast("double"))).cast("long")
    near = F.least(F.greatest(near, F.lit(0).cast("long")), F.lit(3_037_000_499).cast("long"))
    down = F.when(near * near > x, near - 1).otherwise(near)
    return F.when(x >= 0, F.when(F.coalesce(F.try_multiply(down + 1, down + 1) <= x, F.lit(False)), down + 1).otherwise(down))


def forall_range(lo: Column, hi: Column, test) -> Column:
    """test(i) for all lo <= i < hi; true for the empty range."""
    return F.when(hi <= lo, F.lit(True)).otherwise(F.forall(F.sequence(lo, hi - 1), test))


def exists_range(lo: Column, hi: Column, test) -> Column:
    return F.when(hi <= lo, F.lit(False)).otherwise(F.exists(F.sequence(lo, hi - 1), test))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    return F.when(c(b) != 0, c(a) / c(b))


def pass_at_k(n: Column | str, correct: Column | str, k: Column | int) -> Column:
    """1 - C(n-c, k) / C(n, k); 0 without a correct answer, 1 if fewer than k are wrong, null out of range."""
    n, r = c(n).cast("int"), c(correct).cast("int")
    k = F.lit(k).cast("int") if isinstance(k, int) else c(k).cast("int")
    product = F.aggregate(F.sequence(n - r + 1, F.greatest(n, n - r + 1)), F.lit(1.0), lambda p, i: p * (1 - k / i.cast("double")))
    return F.when((r < 0) | (r > n) | (k < 1) | (k > n), None).when(r == 0, 0.0).when(n - r < k, 1.0).otherwise(1 - product)


def wilson(successes: Column | str, n: Column | str, z: float = 1.959963984540054) -> Column:
    """struct(low, high): Wilson's interval of a share; null for n = 0."""
    s, n = c(successes).cast("double"), c(n).cast("double")
    p = s / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.struct(F.greatest(mid - half, F.lit(0.0)).alias("low"), F.least(mid + half, F.lit(1.0)).alias("high")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; 0 if either is zero."""
    a, b = c(a), c(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def half_life(age: Column, period: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(period))
