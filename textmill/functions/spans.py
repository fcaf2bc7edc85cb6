"""Small text and JSON functions: titles, scopes, kinds, spans, numbers, agreement, canonical JSON, UTF-8 edges."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from hashlib import sha256 as _sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_py

#: Fixed value: ranges of scripts that are written without spaces.
UNSPACED = "぀-ヿ㐀-䶿一-鿿가-힯฀-๿"
#: Words of a chunk of sentences, about.
CHUNK_WORDS = 350


def title(text: Column | str, label: str = "Problem") -> Column:
    """What follows `label:` on its line, stripped; null without such a line."""
    found = F.regexp_extract(text, rf"(?m)^{re.escape(label)}:[ \t]*(.*)$", 1)
    return F.nullif(strip_py(found), F.lit(""))


def citation(kind: Column, source: Column, locator: Column) -> Column:
    """[kind:source#locator]"""
    return F.concat(F.lit("["), kind, F.lit(":"), source, F.lit("#"), locator.cast("string"), F.lit("]"))


def in_scope(path: Column, scopes: list[tuple[str, str]]) -> Column:
    """Whether a path lies in a (first folder, suffix) scope."""
    first, suffix = F.get(F.split(path, "/"), F.lit(0)), F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    return F.exists(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in scopes]), lambda x: (x["d"] == first) & (x["s"] == suffix))


def barred(path: Column, folders: list[str], names: str) -> Column:
    """Why a path is left out: a barred folder, test data, a benchmark's name (a pattern); else null."""
    parts = F.split(F.lower(path), "/")
    tests = F.exists(parts, lambda p: p.isin("test", "tests") | p.startswith("test_"))
    return F.when(F.arrays_overlap(parts, F.array(*map(F.lit, folders))), "folder").when(F.array_contains(parts, "data") & tests, "test data").when(path.rlike(names), "benchmark")


def first_kind(text: Column, kinds: list[tuple[str, str]], other: str) -> Column:
    """The name of the first pattern that the text matches."""
    out = F.when(text.rlike(kinds[0][1]), kinds[0][0])
    for name, pattern in kinds[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def family(source: Column, path: Column, general: str, rules: dict[str, str]) -> Column:
    """source:module, the module being the first group of the source's own pattern in the path, else of the general one."""
    found = F.regexp_extract(path, general, 1)
    for name, pattern in rules.items():
        found = F.when(source == name, F.regexp_extract(path, pattern, 1)).otherwise(found)
    return F.concat_ws(":", source, found)


def claims_only(row: list[str], allowed: list[str], eligible: Column) -> list[Column]:
    """The columns of a row, null where it is not eligible unless the column is allowed."""
    return [F.col(c) if c in allowed else F.when(eligible, F.col(c)).alias(c) for c in row]


def stated_in(value: Column, sentence: Column) -> Column:
    """Whether the value is in the sentence as words; an edge in a script without spaces has no boundary to respect."""
    spaced = rf"(?U)^[\w&&[^{UNSPACED}]]"
    edge = rf"[\w&&[^{UNSPACED}]]"
    before = F.when(value.rlike(spaced), f"(?<!{edge})").otherwise("")
    after = F.when(F.reverse(value).rlike(spaced), f"(?!{edge})").otherwise("")
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.coalesce((value != "") & F.call_function("rlike", sentence, F.concat(F.lit("(?U)"), before, quoted, after)), F.lit(False))


def sentence_chunks(sentences: Column, words: Column, size: int = CHUNK_WORDS) -> Column:
    """Sentences joined in groups of equal number, about `size` words each: max(sentences // (words // size + 1), 1) a group."""
    n = F.greatest(F.floor(F.size(sentences) / (F.floor(words / size) + 1)).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(1), F.greatest(F.size(sentences), F.lit(1)), n)
    return F.transform(starts, lambda k: F.array_join(F.slice(sentences, k.cast("int"), n), " "))


def is_int(x: Column) -> Column:
    """Whether the text is an integer literal: an optional minus and ASCII digits."""
    return F.coalesce(x.rlike("^-?[0-9]+$"), F.lit(False))


def to_int(x: Column) -> Column:
    """The integer, exact up to 38 digits; null where it is none."""
    return F.when(is_int(x), x.try_cast("decimal(38,0)"))


def whole_lines(lines: Column, size: Callable[[Column], Column], budget: int) -> Column:
    """The longest run of lines from the start whose sizes, with one for each line end between them, fit the budget."""
    start = F.struct(F.lit(-1).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s: Column, x: Column) -> Column:
        used = (s["used"] + 1 + size(x)).cast("long")
        fits = s["open"] & (used <= budget)
        return F.struct(F.when(fits, used).otherwise(s["used"]).alias("used"), (s["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    return F.slice(lines, F.lit(1), F.aggregate(lines, start, step)["n"])


def runs(pieces: Column, longest: int = 7) -> Column:
    """Every contiguous run of at most `longest` pieces, joined by blanks."""
    n = F.size(pieces)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: F.array_join(F.slice(pieces, i, k), " "))))


def maximal(spans: Column) -> Column:
    """The distinct spans that are in no other one."""
    return F.array_distinct(F.filter(spans, lambda s: ~F.exists(spans, lambda o: (o != s) & F.contains(o, s))))


def numbers_in(text: Column) -> Column:
    """The numbers that a text states, without the commas between thousands, as decimals."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w.])(-?\d+(?:,\d{3})*(?:\.\d+)?)(?![\w])"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(38,10)"))


def ungrounded(used: Column, stated: Column, percent: bool = True) -> Column:
    """The numbers used that are not stated. With `percent`, a stated number's hundredth and hundredfold are, and 1 - x and 1 + x of those between 0 and 1."""
    if not percent:
        return F.array_except(used, stated)
    number = lambda x: x.cast("decimal(38,10)")
    near = F.concat(stated, F.transform(stated, lambda x: number(x / 100)), F.transform(stated, lambda x: number(x * 100)))
    share = F.filter(near, lambda x: (x > 0) & (x < 1))
    return F.array_except(used, F.concat(near, F.transform(share, lambda x: number(1 - x)), F.transform(share, lambda x: number(1 + x))))


def agreed(values: Column) -> Column:
    """The value of two ways or more that all agree (ways without a value don't count); else null."""
    some = F.array_compact(values)
    return F.when((F.size(some) >= 2) & (F.size(F.array_distinct(some)) == 1), F.get(some, F.lit(0)))


def confirmed(value: Column, values: Column, needed: int = 1) -> Column:
    """The value if at least `needed` of the ways give it; else null."""
    return F.when(F.size(F.filter(values, lambda v: v == value)) >= needed, value)


def yes_no(reply: Column) -> Column:
    """'no' if No, no or not is a word of the first sentence (commas dropped, words between single blanks), else 'yes'."""
    words = F.split(F.replace(F.get(F.split(reply, r"\."), F.lit(0)), F.lit(","), F.lit("")), " ")
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, ("No", "no", "not")))), "no").otherwise("yes")


def noise_mix(positives: Column, negatives: Column, rate: float, k: int) -> tuple[Column, Column]:
    """How many of a question's positive and negative documents go into a set of k with a share of noise, rounded up; one side fills what the other lacks."""
    noise = F.lit(-(-k * round(rate * 1_000_000) // 1_000_000))
    if rate == 1:
        return F.lit(0), F.least(F.lit(k), negatives)
    neg = F.when(noise > negatives, negatives).when(k - noise > positives, k - positives).otherwise(noise)
    return F.least(k - neg, positives), F.least(neg, negatives)


def shown_hidden(examples: Column, shown: int) -> tuple[Column, Column]:
    """(the first examples, which a prompt may show; the others, which judge)."""
    n = F.size(examples)
    return F.slice(examples, 1, shown), F.slice(examples, shown + 1, 1 << 20)


def mutations(x: Column) -> Column:
    """Wrong outputs near a right integer, each once and none equal to it: off by one, negated, zero, doubled."""
    return F.array_except(F.array_distinct(F.array(x + 1, x - 1, -x, x * 0, x * 2)), F.array(x))


def list_mutations(x: Column) -> Column:
    """Wrong outputs near a right list: reversed, without its first or last, with its last doubled, empty; none equal to it."""
    n = F.size(x)
    cut = F.greatest(n - 1, F.lit(0))
    near = F.array(F.reverse(x), F.slice(x, F.lit(2), cut), F.slice(x, F.lit(1), cut), F.concat(x, F.slice(x, F.greatest(n, F.lit(1)), F.lit(1))), F.slice(x, 1, 0))
    return F.array_except(F.array_distinct(near), F.array(x))


# ------------------------------------------------------------------ JSON, bytes, stages


def canonical_json(value) -> str:
    """JSON with sorted keys and no blanks; the same for equal values, whatever their order."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_digest(text: str) -> str | None:
    """sha256 of a JSON text's canonical form; None if it is no JSON. A text that is a JSON string of JSON is read twice."""
    try:
        value = json.loads(text)
        if isinstance(value, str):
            value = json.loads(value)
    except ValueError:
        return None
    return _sha256(canonical_json(value).encode()).hexdigest()


def stage_fingerprint(inputs: dict[str, str], parameters: dict) -> str:
    """What a stage's result depends on: digests of its inputs and its parameters. Equal fingerprints need no second run."""
    return _sha256(canonical_json({"inputs": inputs, "parameters": parameters}).encode()).hexdigest()


def undecodable(data: bytes) -> int:
    """Bytes that are no UTF-8."""
    return sum(0xDC80 <= ord(ch) <= 0xDCFF for ch in bytes(data).decode("utf-8", "surrogateescape"))


def utf8_edge(data: bytes) -> bytes:
    """A probe of the beginning of a file without the character that its end cuts through."""
    data = bytes(data)
    for back in range(1, min(4, len(data)) + 1):
        lead = data[-back]
        if lead >= 0xC0:
            need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return data[:-back] if need > back else data
        if lead < 0x80:
            break
    return data


def squeezed_lines(text: str) -> str:
    """Lines with their blanks squeezed, at most one empty line in a row."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(" ".join(line.split()) for line in text.splitlines())).strip()


# ------------------------------------------------------------------ how a document writes numbers

_SPACED = rf"[\w&&[^{UNSPACED}]]"
#: A word or number with separators inside.
PIECE = rf"(?U){_SPACED}+(?:[.,'’:/-]{_SPACED}+)*"
#: The two ways to write a number, and those that can be read in one way alone.
ENGLISH, CONTINENTAL = r"^(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?$", r"^(?:[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+)(?:,[0-9]+)?$"
SURELY_ENGLISH, SURELY_CONTINENTAL = r"^(?:[0-9]{1,3}(?:,[0-9]{3})+\.[0-9]+|[0-9]+\.[0-9]{1,2})$", r"^(?:[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+|[0-9]+,[0-9]{2})$"


def number_pieces(text: Column | str) -> Column:
    """The pieces of a text that are digits with separators inside, as they stand."""
    return F.filter(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: x.rlike("^[0-9](?:[0-9.,]*[0-9])?$"))


def number_convention(pieces: Column) -> Column:
    """How a document writes numbers, from all its numeric pieces: english, continental or mixed (both surely occur); english if nothing decides."""
    english, continental = F.exists(pieces, lambda x: x.rlike(SURELY_ENGLISH)), F.exists(pieces, lambda x: x.rlike(SURELY_CONTINENTAL))
    return F.when(english & continental, "mixed").when(continental, "continental").otherwise("english")


def read_number(piece: Column, convention: Column) -> Column:
    """struct(value, refused): a piece's value under the document's convention, or why it has none.

    A piece that reads in one way alone is read that way; one with two different values follows the convention, and
    is refused where the document writes numbers both ways.
    """
    english = F.when(piece.rlike(ENGLISH), F.regexp_replace(piece, ",", "").try_cast("decimal(38,10)"))
    continental = F.when(piece.rlike(CONTINENTAL), F.regexp_replace(F.regexp_replace(piece, r"\.", ""), ",", ".").try_cast("decimal(38,10)"))
    two = english.isNotNull() & continental.isNotNull() & (english != continental)
    refused = F.when(english.isNull() & continental.isNull(), "unreadable").when(two & (convention == "mixed"), "two readings")
    other = english.isNull() | ((convention == "continental") & continental.isNotNull())
    return F.struct(F.when(refused.isNull(), F.when(other, continental).otherwise(english)).alias("value"), refused.alias("refused"))
