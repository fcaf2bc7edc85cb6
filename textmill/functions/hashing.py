"""Hash identities and splits as Catalyst expressions.

Unsigned thresholds are compared as fixed-width hex, so nothing overflows.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, strip_py


def sha256(x: Column | str) -> Column:
    return F.sha2(c(x), 256)


def below(hex_digest: Column, share: float, digits: int = 16) -> Column:
    """Whether the first `digits` hex digits, as a fraction of their range, lie below `share`."""
    if share >= 1:
        return F.lit(True)
    limit = ceil(Fraction(str(share)) * 16**digits)
    return F.substring(hex_digest, 1, digits) < F.lit(f"{limit:0{digits}x}")


def holdout(x: Column | str, share: float, seed: int = 1337, salt: str = "split") -> Column:
    """Whether a text is held out: by its stripped content, a seed and a salt alone."""
    key = F.concat(F.lit(f"{salt}\x00{seed}\x00"), strip_py(x))
    return below(sha256(key), share)


def fold(x: Column | str, k: int) -> Column:
    """sha256 (first 16 hex digits) mod k."""
    wide = F.conv(F.substring(sha256(x), 1, 16), 16, 10).cast("decimal(20,0)")
    return (wide % F.lit(k)).cast("int")


def option(x: Column | str, k: int) -> Column:
    """sha256 (first 8 hex digits) mod k."""
    return (F.conv(F.substring(sha256(x), 1, 8), 16, 10).cast("long") % k).cast("int")


def unit(x: Column | str) -> Column:
    """sha256 (first 13 hex digits) as a fraction of its range."""
    return F.conv(F.substring(sha256(x), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def sample_order(key: Column | str, seed: int) -> Column:
    """The order of a reproducible sample: sha256 of 'seed:key'."""
    return sha256(F.concat(F.lit(f"{seed}:"), c(key).cast("string")))


def composite_key(*parts: Column | str) -> Column:
    """One digest of several parts, NUL-joined; null and '' differ."""
    return sha256(F.concat_ws("\x00", *[F.coalesce(c(p).cast("string"), F.lit("\x01")) for p in parts]))
