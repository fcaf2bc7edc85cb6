"""Dates in texts and spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c

#: Patterns that are tried in order.
PATTERNS = ("yyyy-MM-dd", "yyyy/MM/dd", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy", "dd.MM.yyyy")


def parse_date(x: Column | str) -> Column:
    """struct(date, reason): reason is null, 'ambiguous' (day and month can't be told apart) or 'no date'."""
    t = F.regexp_replace(F.trim(c(x)), r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    plain = F.coalesce(*[F.try_to_timestamp(t, F.lit(p)).cast("date") for p in PATTERNS])
    a, b, y = (F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i) for i in (1, 2, 3))
    slashed = t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    first, second = a.try_cast("int"), b.try_cast("int")
    unsure = slashed & (first <= 12) & (second <= 12) & (first != second)
    day, month = F.when(first > 12, first).otherwise(second), F.when(first > 12, second).otherwise(first)
    made = F.when(slashed & ~unsure, F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y.try_cast("int"), month, day), F.lit("yyyy-MM-dd")).cast("date"))
    date = F.coalesce(plain, made)
    return F.struct(date.alias("date"), F.when(unsure, "ambiguous").when(date.isNull(), "no date").alias("reason"))


def serial_date(n: Column | str, epoch: int = 1900) -> Column:
    """The date of a spreadsheet's day number; the 1900 system counts a 29 February 1900 that never was."""
    n = F.floor(c(n)).cast("int")
    if epoch == 1904:
        return F.date_add(F.lit("1904-01-01").cast("date"), n)
    return F.when(n == 60, None).when(n > 60, F.date_add(F.lit("1899-12-30").cast("date"), n)).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), n))


def utc_text(ts: Column | str) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_utc(x: Column | str) -> Column:
    """The timestamp of an ISO text in UTC, or null."""
    return F.try_to_timestamp(c(x), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def age_days(now: Column, *times: Column) -> Column:
    """Days since the first known of several times, never negative; 0 if none is known."""
    known = F.coalesce(*times)
    return F.coalesce(F.greatest((F.unix_micros(now) - F.unix_micros(known)) / F.lit(86_400e6), F.lit(0.0)), F.lit(0.0))


def parse_number(x: Column | str, convention: str = "english") -> Column:
    """A number with grouped digits: '1,234.5' (english) or '1.234,5' (continental); null if it is none."""
    group, point = (",", ".") if convention == "english" else (".", ",")
    g, p = "\\" + group, "\\" + point
    ok = c(x).rlike(rf"^[+-]?(\d{{1,3}}({g}\d{{3}})+|\d+)({p}\d+)?$")
    return F.when(ok, F.replace(F.replace(c(x), F.lit(group), F.lit("")), F.lit(point), F.lit(".")).try_cast("double"))
