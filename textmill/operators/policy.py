"""Exclusion policies: id aliases, declared names, gates and consistency, panel draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sample_order
from ..functions.text import c

#: Families of names that carry a problem's number, and what to add to it.
FAMILIES = {"mbpp": 0, "task": 0, "heldout": 1000, "extra": 100000}


def aliases(text: Column | str, families: dict[str, int] | None = None) -> Column:
    """Sorted distinct problem ids named in a text as family_123, family-123 or family123."""
    def family(name: str, base: int) -> Column:
        found = F.regexp_extract_all(c(text), F.lit(rf"(?i)(?<![A-Za-z0-9]){name}[_-]?([0-9]{{1,9}})(?![0-9A-Za-z])"), F.lit(1))
        return F.transform(found, lambda x: x.cast("long") + base)

    parts = [family(name, base) for name, base in (families or FAMILIES).items()]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def declared(text: Column | str, keyword: str = "task") -> Column:
    """Names declared at line beginnings: 'task NAME'."""
    return F.regexp_extract_all(c(text), F.lit(rf"(?m)^{keyword}\s+([A-Za-z_]\w*)"), F.lit(1))


def without_head(text: Column | str, labels: tuple[str, ...] = ("Problem", "Signature", "Example", "Spec")) -> Column:
    """The text without its leading block of 'Label: …' lines."""
    return F.regexp_replace(c(text), rf"\A(?:(?:{'|'.join(labels)}):[^\n]*(?:\n|\z))+\s*", "")


def union(policies: dict[str, DataFrame], key: str) -> DataFrame:
    """key, policies: what is excluded and by which of the policies."""
    rows = None
    for name, df in policies.items():
        part = df.select(F.col(key), F.lit(name).alias("policy")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("policy")).alias("policies"))


def inconsistent(listed: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """key, problem: keys that only one of the two lists has; a policy with any row here must be refused."""
    a, b = listed.select(key).distinct().withColumn("_a", F.lit(1)), excluded.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer").where("_a is null or _b is null")
    return both.select(key, F.when(F.col("_b").isNull(), "listed but not excluded").otherwise("excluded but not listed").alias("problem"))


def gate(rows: DataFrame, key: str, text: str, ids: DataFrame, names: DataFrame) -> DataFrame:
    """rows with reason: 'id' (its own key is excluded), 'alias' (its text names an excluded id), 'name' (it declares an excluded name)."""
    marked = rows.join(ids.select(F.col("id").alias(key)).distinct().withColumn("_i", F.lit(1)), key, "left")
    hits = lambda col, df, k: rows.select(key, F.explode(col).alias(k)).join(df.select(k).distinct(), k, "left_semi").select(key).distinct()
    by_alias = hits(aliases(text), ids, "id").withColumn("_a", F.lit(1))
    by_name = hits(declared(text), names, "name").withColumn("_n", F.lit(1))
    marked = marked.join(by_alias, key, "left").join(by_name, key, "left")
    reason = F.when(F.col("_i").isNotNull(), "id").when(F.col("_a").isNotNull(), "alias").when(F.col("_n").isNotNull(), "name")
    return marked.withColumn("reason", reason).drop("_i", "_a", "_n")


def panel(candidates: DataFrame, key: str, removes: str, k: int, most: int, seed: int = 17) -> DataFrame:
    """k candidates in hash order among those whose removal costs at most `most` training rows."""
    return candidates.where(F.size(removes) <= most).orderBy(sample_order(key, seed)).limit(k)


def systematic(df: DataFrame, order: str, k: int) -> DataFrame:
    """Every (n // k)-th row in the order, from the first: a control sample of about k rows."""
    from .ordered import sum_before

    step = max(1, df.count() // max(1, k))
    return sum_before(df, order, F.lit(1), [order], "_at").where(F.col("_at") % step == 0).drop("_at")
