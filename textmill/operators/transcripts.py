"""Error rates of transcripts over a whole corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.python_text import edits, python_udf
from ..functions.text import c, split_words_py
from ..session import ship_code

#: What an edit is of.
UNITS: dict[str, Callable[[Column], Column]] = {"words": split_words_py, "chars": lambda x: F.filter(F.split(x, ""), lambda ch: ch != "")}


def error_rate(pairs: DataFrame, reference: str, hypothesis: str, normalise: Callable[[Column], Column] | None = None, unit: str = "words", by: list[str] | None = None) -> DataFrame:
    """by (else one row): pairs, missing, units, edits, rate = edits / units.

    normalise: what is done to both texts before they are compared, as columns. A missing (null) hypothesis counts as
    empty: all units of its reference are edits. Pairs without a reference do not count; without units there is no rate. Sums are
    combined before they are shuffled.
    """
    ship_code(pairs.sparkSession)
    clean = normalise or (lambda x: x)
    cut = UNITS[unit]
    rows = pairs.where(F.col(reference).isNotNull()).select(
        *(by or []), cut(clean(c(reference))).alias("_r"), cut(clean(F.coalesce(c(hypothesis), F.lit("")))).alias("_h"), F.col(hypothesis).isNull().alias("_missing")
    )
    # equal and empty sides need no table of distances
    n, m = F.size("_r"), F.size("_h")
    far = F.when(F.col("_r") == F.col("_h"), 0).when((n == 0) | (m == 0), F.greatest(n, m)).otherwise(python_udf(lambda a, b: edits(list(a), list(b)), "int")("_r", "_h"))
    rows = rows.select(*(by or []), n.alias("_n"), far.alias("_e"), "_missing")
    sums = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("_missing").alias("missing"), F.coalesce(F.sum("_n"), F.lit(0)).alias("units"), F.coalesce(F.sum("_e"), F.lit(0)).alias("edits"))
    return sums.withColumn("rate", F.col("edits") / F.nullif("units", F.lit(0)))
