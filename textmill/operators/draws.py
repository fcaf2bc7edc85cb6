"""Inputs drawn in the shape of samples, by a counter-based generator.

Every number is a digest of (seed, key, draw, place), so a draw is the same on any engine, at any partitioning and
in any order, and all of it is columns. Shapes are learnt from a sample: the sign and size of an integer; of
a sequence the length, the range and whether it is sorted; of a sequence of sequences also the longest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of larger draws, and of these the share far past the sample.
LARGER, FAR = 0.7, 0.15
#: Slots of a digest's counter that are no place of a sequence.
SIZE, PICK, REACH, ROWS = "size", "pick", "reach", "rows"


class Counter:
    """Numbers of one draw: `at(slot)` is uniform over 52 bits."""

    def __init__(self, seed: int, key: Column, draw: Column):
        self.base = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), draw.cast("string"))

    def at(self, *slot: Column | str) -> Column:
        parts = [F.lit(s) if isinstance(s, str) else s.cast("string") for s in slot]
        return F.conv(F.substring(F.sha2(F.concat_ws(":", self.base, *parts), 256), 1, 13), 16, 10).cast("long")

    def between(self, lo: Column, hi: Column, *slot: Column | str) -> Column:
        """A whole number from lo to hi, both included."""
        return lo + self.at(*slot) % (hi - lo + 1)

    def chance(self, share: float, slot: str) -> Column:
        return self.at(slot) < round(share * 16**13)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _values(c: Counter, like: Column, n: Column, row: Column | None = None) -> Column:
    """n values within two of the sample's range (-6 to 6 without a sample), sorted if the sample is."""
    some = F.size(like) > 0
    lo = F.when(some, F.array_min(like) - 2).otherwise(_long(-6))
    hi = F.when(some, F.array_max(like) + 2).otherwise(_long(6))
    places = F.when(n > 0, F.sequence(_long(1), n)).otherwise(F.array().cast("array<bigint>"))
    drawn = F.transform(places, lambda i: c.between(lo, hi, *([i] if row is None else [row, i])))
    return F.when(some & (F.array_sort(like) == like), F.array_sort(drawn)).otherwise(drawn)


def like_int(c: Counter, like: Column, larger: bool = False) -> Column:
    """An integer of the sample's sign: up to twice it, or larger than any of these."""
    top = F.greatest(_long(2), F.abs(like) * 2)
    size = c.between(_long(0), top, SIZE)
    if larger:
        far = c.between(4 * top, 20 * top, SIZE)
        near = c.between(top + 1, F.greatest(top * 3, top + 12), SIZE)
        size = F.when(c.chance(LARGER, PICK), F.when(c.chance(FAR, REACH), far).otherwise(near)).otherwise(size)
    return F.when(like >= 0, size).otherwise(-size)


def like_seq(c: Counter, like: Column, larger: bool = False) -> Column:
    """A sequence of up to two more values than the sample, or longer."""
    top = F.greatest(_long(3), F.size(like).cast("long") + 2)
    n = c.between(_long(0), top, SIZE)
    if larger:
        far = c.between(F.greatest(_long(28), top + 1), F.greatest(_long(40), top + 12), SIZE)
        near = c.between(top + 1, F.greatest(top * 3, _long(12)), SIZE)
        n = F.when(c.chance(LARGER, PICK), F.when(c.chance(FAR, REACH), far).otherwise(near)).otherwise(n)
    return _values(c, like, n)


def like_rows(c: Counter, like: Column) -> Column:
    """Rows in the sample's shape: up to two more, each up to two longer than the longest, values within two of the range."""
    points = F.flatten(like)
    longest = F.coalesce(F.array_max(F.transform(like, F.size)), F.lit(0)).cast("long")
    rows = c.between(_long(0), F.size(like).cast("long") + 2, ROWS)
    at = F.when(rows > 0, F.sequence(_long(1), rows)).otherwise(F.array().cast("array<bigint>"))
    unsorted = F.concat(points, F.slice(points, 1, 1))  # rows of a sequence are not sorted as a whole
    return F.transform(at, lambda r: _values(c, F.when(F.size(points) > 0, F.concat(F.array(F.array_max(points)), F.array(F.array_min(points)), unsorted)).otherwise(points), c.between(_long(0), longest + 2, SIZE, r), r))


KINDS = {"int": like_int, "seq": like_seq, "rows": like_rows}


def drawn(samples: DataFrame, key: str, value: str, kind: str, n: int, seed: int = 1, larger: bool = False) -> DataFrame:
    """key, draw (1 to n), value: inputs in the shape of each key's sample; a null sample gives none."""
    rows = samples.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_like"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    c = Counter(seed, F.col(key), F.col("draw"))
    make = KINDS[kind](c, F.col("_like"), True) if larger else KINDS[kind](c, F.col("_like"))
    return rows.select(key, "draw", make.alias("value"))
