"""Fill-in-the-middle rows with hash-derived cuts (reproducible on any engine)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import composite_key, unit

PREFIX, SUFFIX, MIDDLE = "<|prefix|>", "<|suffix|>", "<|middle|>"


def cuts(key: Column, text: Column, seed: int = 17) -> Column:
    """struct(a, b): two ordered cut places in a text, from hashes of its key."""
    n = F.char_length(text)
    place = lambda k: F.floor(unit(composite_key(F.lit(str(seed)), F.lit(k), key)) * (n + 1)).cast("int")
    x, y = place("first"), place("second")
    return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def rows(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.5, spm: float = 0.5, seed: int = 17) -> DataFrame:
    """key, layout ('plain', 'psm', 'spm'), text: a share of the documents cut into prefix, suffix and middle."""
    t = F.col(text)
    body = lambda a, b: F.substring(t, a + 1, b - a)
    pick = docs.withColumn("_c", cuts(F.col(key).cast("string"), t, seed)).withColumn("_u", unit(composite_key(F.lit(str(seed)), F.lit("use"), key))).withColumn("_l", unit(composite_key(F.lit(str(seed)), F.lit("layout"), key)))
    a, b, n = F.col("_c.a"), F.col("_c.b"), F.char_length(t)
    pre, mid, suf = body(F.lit(0), a), body(a, b), body(b, n)
    layout = F.when(F.col("_u") >= share, "plain").when(F.col("_l") < spm, "spm").otherwise("psm")
    psm, sp = F.concat(F.lit(PREFIX), pre, F.lit(SUFFIX), suf, F.lit(MIDDLE), mid), F.concat(F.lit(SUFFIX), suf, F.lit(PREFIX), pre, F.lit(MIDDLE), mid)
    return pick.select(key, layout.alias("layout"), F.when(layout == "plain", t).when(layout == "psm", psm).otherwise(sp).alias("text"))
