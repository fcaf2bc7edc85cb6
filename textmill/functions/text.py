"""Text functions as Catalyst expressions.

Java and Python differ on white space, line ends and case; each function here states
which of the two it follows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python's str.strip() removes, for a Java character class.
PY_SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Fixed value: the line ends of Python's str.splitlines().
PY_LINE_END = r"\r\n|[\n\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_py(x: Column | str, chars: str | None = None) -> Column:
    """str.strip(): all Unicode white space, or any of `chars`."""
    if chars is not None:
        return F.trim(c(x), F.lit(chars))
    return F.regexp_replace(c(x), f"^[{PY_SPACE}]+|[{PY_SPACE}]+$(?![\\s\\S])", "")


def split_lines_py(x: Column | str) -> Column:
    """str.splitlines(): no empty last line."""
    parts = F.split(c(x), PY_LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_lf(x: Column | str) -> Column:
    """Lines by the line feed alone; U+2028 and the like are text."""
    return F.split(c(x), "\n", -1)


def split_words_py(x: Column | str) -> Column:
    """str.split(): runs of white space; empty text has no words."""
    s = strip_py(x)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"[{PY_SPACE}]+"))


def ascii_lower(x: Column | str) -> Column:
    return F.translate(c(x), ASCII_UPPER, ASCII_LOWER)


def ascii_upper(x: Column | str) -> Column:
    return F.translate(c(x), ASCII_LOWER, ASCII_UPPER)


def swapcase(x: Column | str) -> Column:
    return F.translate(c(x), ASCII_UPPER + ASCII_LOWER, ASCII_LOWER + ASCII_UPPER)


def capitalize(x: Column | str) -> Column:
    return F.concat(ascii_upper(F.substring(c(x), 1, 1)), ascii_lower(F.substring(c(x), 2, 1 << 30)))


def count_text(x: Column | str, part: str) -> Column:
    """Non-overlapping occurrences; an empty part occurs between all characters."""
    x = c(x)
    if part == "":
        return F.char_length(x) + 1
    return ((F.char_length(x) - F.char_length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("int")


def find(x: Column | str, part: str) -> Column:
    """Zero-based place of the first occurrence, or -1."""
    return F.instr(c(x), part) - 1


def rfind(x: Column | str, part: str) -> Column:
    """Zero-based place of the last occurrence, or -1."""
    at = F.instr(F.reverse(c(x)), part[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.char_length(c(x)) - at + 1 - len(part)).cast("int")


def pad(x: Column | str, width: int, side: str, fill: str = " ") -> Column:
    """ljust ('left' aligned), rjust ('right'), center ('center'), never cutting the text."""
    x = c(x)
    room = F.greatest(F.lit(width) - F.char_length(x), F.lit(0))
    if side == "left":
        return F.concat(x, F.repeat(F.lit(fill), room))
    if side == "right":
        return F.concat(F.repeat(F.lit(fill), room), x)
    # the spare character of an uneven margin goes left when the width is odd
    left = F.floor(room / 2) + F.when((room % 2 == 1) & F.lit(width % 2 == 1), 1).otherwise(0)
    return F.concat(F.repeat(F.lit(fill), left.cast("int")), x, F.repeat(F.lit(fill), (room - left).cast("int")))


def zfill(x: Column | str, width: int) -> Column:
    x = c(x)
    sign = F.when(F.substring(x, 1, 1).isin("+", "-"), F.substring(x, 1, 1)).otherwise("")
    body = F.when(sign == "", x).otherwise(F.substring(x, 2, 1 << 30))
    return F.concat(sign, F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.char_length(x), F.lit(0))), body)


def is_class(x: Column | str, kind: str) -> Column:
    """isdigit, isalpha, isalnum, isspace, isupper, islower over ASCII; false for the empty text."""
    x = c(x)
    plain = {"digit": "^[0-9]+$", "alpha": "^[A-Za-z]+$", "alnum": "^[A-Za-z0-9]+$", "space": "^[ \\t\\n\\r\\x{B}\\x{C}]+$"}
    if kind in plain:
        return x.rlike(plain[kind])
    return x.rlike("[A-Za-z]") & ~x.rlike("[a-z]" if kind == "upper" else "[A-Z]")


def partition(x: Column | str, sep: str) -> Column:
    """struct(before, sep, after); (text, '', '') without the separator."""
    x = c(x)
    at = F.instr(x, sep)
    return F.when(at > 0, F.struct(F.substring(x, F.lit(1), at - 1).alias("before"), F.lit(sep).alias("sep"), F.substring(x, at + len(sep), F.lit(1 << 30)).alias("after"))).otherwise(
        F.struct(x.alias("before"), F.lit("").alias("sep"), F.lit("").alias("after"))
    )


def alnum_words(x: Column | str) -> Column:
    """[A-Za-z0-9]+ of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c(x)), F.lit("[a-z0-9]+"), F.lit(0))


def word_tokens(x: Column | str) -> Column:
    """[A-Za-z0-9_]+ of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c(x)), F.lit("[a-z0-9_]+"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words as texts joined by one space (none if it is shorter)."""
    last = F.size(words) - n
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, n), " ")))


def spdx_ids(x: Column | str) -> Column:
    """Sorted distinct licence identifiers after 'SPDX-License-Identifier:'."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c(x), F.lit(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)"), F.lit(1))))


def normalized(x: Column | str) -> Column:
    """Line ends stripped of trailing white space, the whole stripped."""
    return strip_py(F.regexp_replace(F.regexp_replace(c(x), r"\r\n?", "\n"), r"[ \t]+(?=\n)", ""))


def statement_key(x: Column | str) -> Column:
    """Lower case, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", " "))


def stem_s(w: Column) -> Column:
    """A plural stemmer: ies to y (but not after a vowel e or a), es to e, s dropped (but not us, ss)."""
    ies = w.rlike("ies$") & ~w.rlike("[ea]ies$")
    es = w.rlike("es$") & ~w.rlike("[aeo]es$")
    s = w.rlike("s$") & ~w.rlike("[us]s$")
    cut = lambda n: F.substring(w, F.lit(1), F.char_length(w) - n)
    return F.when(ies, F.concat(cut(3), F.lit("y"))).when(es, cut(1)).when(s, cut(1)).otherwise(w)
