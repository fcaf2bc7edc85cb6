"""Whether two programs behave alike on the same inputs, from tables of their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the share of differing draws below which a program is a near twin.
NEAR = 0.1


def pair_answers(mine: DataFrame, theirs: DataFrame, keys: list[str], draw: str, answer: str) -> DataFrame:
    """keys, draw, mine, theirs: both arms' answers to each draw that either was given (null: silent)."""
    side = lambda df, name: df.select(*keys, draw, F.col(answer).alias(name))
    return side(mine, "mine").join(side(theirs, "theirs"), [*keys, draw], "full")


def verdicts(pairs: DataFrame, keys: list[str], draw: str, near: float = NEAR) -> DataFrame:
    """One row for each key: counts, the share that differs, the verdict, whether it is a twin, and the first draw that differs.

    agrees: both answered some draw and never differently. near twin: they differ on less than `near` of the draws
    that both answered. differs: on more. no draw answered by both: then the program stays suspected, as one that
    agrees or nearly does. Counts are combined before they are shuffled, so a key with many draws is no hot task.
    """
    both = F.col("mine").isNotNull() & F.col("theirs").isNotNull()
    differ = both & (F.col("mine") != F.col("theirs"))
    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("draws"),
        F.count_if(both).alias("answered_by_both"),
        F.count_if(both & ~differ).alias("agreed"),
        F.count_if(differ).alias("differed"),
        F.count_if(F.col("mine").isNull()).alias("program_silent"),
        F.count_if(F.col("mine").isNotNull() & F.col("theirs").isNull()).alias("reference_silent"),
        F.min(F.when(differ, F.col(draw))).alias("witness"),
    )
    share = F.when(F.col("differed") > 0, F.col("differed") / F.nullif("answered_by_both", F.lit(0)))
    verdict = F.when(F.col("answered_by_both") == 0, "no draw answered by both").when(F.col("differed") == 0, "agrees").when(share < near, "near twin").otherwise("differs")
    return sums.withColumn("differ_fraction", F.round(share, 4)).withColumn("verdict", verdict).withColumn("twin", F.col("verdict") != "differs")


def signatures(answers: DataFrame, keys: list[str], draw: str, answer: str, draws: Column | None = None) -> DataFrame:
    """keys, signature: a digest of a program's answers to all draws, in their order; equal signatures behave alike on them.

    A program's answers are as many as the draws, which are stated, so one row holds them.
    """
    cell = F.struct(F.col(draw), F.coalesce(F.concat(F.lit("="), F.col(answer).cast("string")), F.lit("!")).alias("a"))
    rows = answers if draws is None else answers.where(draws)
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda s: F.concat_ws(":", s[draw].cast("string"), s["a"])), "\x00"), 256).alias("signature"))
