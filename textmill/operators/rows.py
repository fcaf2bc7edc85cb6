"""Training rows: gates, caps, tiers, round-robin, pairs, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_reason(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that a row fails (its condition is true), or null."""
    out = None
    for name, failed in gates:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out if out is not None else F.lit(None).cast("string")


def cap_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group (deduplicate before: copies must not use up the cap)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def round_robin(df: DataFrame, kind: str, order: list[Column], n: int) -> DataFrame:
    """n rows, one of each kind in turn; kinds in their own order."""
    w = Window.partitionBy(kind).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", kind).limit(n)


def tiered(df: DataFrame, group: list[str], tier: str, order: list[Column], caps: dict[str, int], total: int, reserve: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """At most caps[tier] rows of each tier and `total` of each group, earlier tiers first.

    reserve: tier -> (other tier, n): a tier that opens only in groups with fewer than n rows of the other.
    """
    names = list(caps)
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(tier))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(tier))
    within = Window.partitionBy(*group, tier).orderBy(*order)
    rows = df.where(F.col(tier).isin(names)).withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= limit).withColumn("_p", place)
    for closed, (other, n) in (reserve or {}).items():
        held = F.count_if(F.col(tier) == other).over(Window.partitionBy(*group))
        rows = rows.withColumn("_held", held).where((F.col(tier) != closed) | (F.col("_held") < n)).drop("_held")
    over = Window.partitionBy(*group).orderBy("_p", *order)
    return rows.withColumn("place", F.row_number().over(over)).where(F.col("place") <= total).drop("_r", "_p")


def positional_pairs(df: DataFrame, group: list[str], good: Column, order: str, value: str, k: int) -> DataFrame:
    """The i-th accepted row of a group with its i-th rejected row, for i up to k and both lengths."""
    w = Window.partitionBy(*group, "_good").orderBy(order)
    rows = df.withColumn("_good", good).where(F.col("_good").isNotNull()).withColumn("i", F.row_number().over(w)).where(F.col("i") <= k)
    a = rows.where("_good").select(*group, "i", F.col(value).alias("chosen"))
    b = rows.where("not _good").select(*group, "i", F.col(value).alias("rejected"))
    return a.join(b, [*group, "i"])


def majority(df: DataFrame, group: list[str], vote: str, least_votes: int, least_share: float) -> DataFrame:
    """The most frequent vote of each group with enough votes and agreement; ties to the smaller vote."""
    counts = df.where(F.col(vote).isNotNull()).groupBy(*group, vote).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*group).agg(F.sum("n").alias("votes"), F.min(F.struct((-F.col("n")).alias("m"), F.col(vote).alias("v"))).alias("b"))
    share = -F.col("b.m") / F.col("votes")
    return best.where((F.col("votes") >= least_votes) & (share >= least_share)).select(*group, F.col("b.v").alias(vote), "votes", F.round(share, 6).alias("share"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, messages (array of role, content in turn order)."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def exchange_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, prompt, reply: each user turn that the assistant answers at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("reply"))
    return rows.where("role = 'user' and r2 = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "reply")


def fit_recent(turns: DataFrame, budget: int) -> DataFrame:
    """conv_id, turn: the latest turns whose lengths fit the budget (the oldest are dropped first)."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("_used", F.sum(F.char_length("text")).over(back)).where(F.col("_used") <= budget).select("conv_id", "turn")


def padded(ids: Column, block: int, pad: int = 0, ignore: int = -100) -> Column:
    """struct(input, target): ids cut to block + 1, shifted by one, padded on the right; padding targets are ignored."""
    cut = F.slice(ids, 1, block + 1)
    x, y = F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0))), F.slice(cut, 2, block + 1)
    fill = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), F.lit(block) - F.size(a)))
    return F.struct(fill(x, pad).alias("input"), fill(y, ignore).alias("target"))


def family_closure(rows: DataFrame, seeds: DataFrame, key: str, identity: str) -> DataFrame:
    """The seeds and all rows that share an identity with one (one hop); rows without identity only directly."""
    refused = rows.join(seeds.select(key), key, "left_semi").where(F.col(identity).isNotNull()).select(identity).distinct()
    return seeds.select(key).unionByName(rows.join(refused, identity, "left_semi").select(key)).distinct()
