"""Table functions: one value in, any number of rows out, with columns that the caller chooses.

`lateral` is the extension point: it joins every row with what a table function (any class with `eval`, and
`analyze` where the columns depend on constant arguments) makes of it, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..session import ship_code


def lateral(df: DataFrame, function: type, *args: Column | str, keep: list[str] | None = None) -> DataFrame:
    """The rows (their columns `keep`, else all) with the rows of the table function for each, none where it gives none; args that are names are columns of df."""
    ship_code(df.sparkSession)
    # a lateral table sees the columns of the row before it as outer ones
    outer = [F.col(a).outer() if isinstance(a, str) else a for a in args]
    joined = df.lateralJoin(F.udtf(function, useArrow=True)(*outer))
    return joined.select(*(keep or df.columns), *joined.columns[len(df.columns) :])


def _constant(a: AnalyzeArgument, what: str) -> str:
    if not a.isConstantExpression or not isinstance(a.value, str) or not a.value:
        raise ValueError(f"{what} has to be a constant text")
    return a.value


@dataclass
class Chosen(AnalyzeResult):
    """The columns, and what `eval` needs of the constant arguments."""

    parts: list = field(default_factory=list)
    fields: list = field(default_factory=list)


class Elements:
    """Rows of an HTML text's elements: elements(html, 'p,h1', 'place,name,text').

    Columns may be place (number in the text, from 1, over all names), name, text (what lies between the tags,
    unchanged), begin (its first character) and chars. An element ends at the first end tag of its name. A null text has none.
    """

    KINDS = {"place": IntegerType(), "name": StringType(), "text": StringType(), "begin": LongType(), "chars": LongType()}

    def __init__(self, chosen: Chosen):
        self.fields = chosen.fields
        names = "|".join(map(re.escape, chosen.parts))
        self.pattern = re.compile(rf"<({names})(?:\s[^>]*)?>(.*?)</\1>", re.S)

    @staticmethod
    def analyze(html: AnalyzeArgument, names: AnalyzeArgument, fields: AnalyzeArgument) -> Chosen:
        wanted = _constant(fields, "fields").split(",")
        if unknown := [f for f in wanted if f not in Elements.KINDS]:
            raise ValueError(f"no such fields: {', '.join(unknown)}")
        schema = StructType()
        for f in wanted:
            schema = schema.add(f, Elements.KINDS[f])
        return Chosen(schema=schema, parts=_constant(names, "names").split(","), fields=wanted)

    def eval(self, html: str, names: str, fields: str) -> Iterator[tuple]:
        for place, m in enumerate(self.pattern.finditer(html or ""), 1):
            row = {"place": place, "name": m[1], "text": m[2], "begin": m.start(2), "chars": m.end(2) - m.start(2)}
            yield tuple(row[f] for f in self.fields)
