"""Evaluation aggregates: funnels, levels, disagreement, ranking and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import pass_at_k
from .ordered import sum_before


def funnel(df: DataFrame, by: list[str], stages: dict[str, Column]) -> DataFrame:
    """Rows of each group that pass each stage and all stages before it."""
    aggs, so_far = [F.count(F.lit(1)).alias("replies")], F.lit(True)
    for name, ok in stages.items():
        so_far = so_far & F.coalesce(ok, F.lit(False))
        aggs.append(F.count_if(so_far).alias(name))
    return df.groupBy(*by).agg(*aggs)


def at_least_curve(df: DataFrame, by: list[str], level: str, top: int) -> DataFrame:
    """by, k, n: rows whose level is at least k, for k = 1..top."""
    rows = df.groupBy(*by, level).agg(F.count(F.lit(1)).alias("m"))
    return rows.select(*by, F.explode(F.sequence(F.lit(1), F.lit(top))).alias("k"), level, "m").groupBy(*by, "k").agg(F.sum(F.when(F.col(level) >= F.col("k"), F.col("m")).otherwise(0)).alias("n"))


def contradictions(cells: DataFrame, task: list[str], judge: str, verdict: str) -> DataFrame:
    """judge_a (verified), judge_b (refuted), n: tasks on which the two disagree."""
    sides = cells.where(F.col(verdict).isin("verified", "refuted")).groupBy(*task).agg(
        F.array_sort(F.collect_set(F.when(F.col(verdict) == "verified", F.col(judge)))).alias("v"), F.array_sort(F.collect_set(F.when(F.col(verdict) == "refuted", F.col(judge)))).alias("r")
    )  # judges are few
    pairs = sides.select(F.explode("v").alias("judge_a"), "r").select("judge_a", F.explode("r").alias("judge_b"))
    return pairs.groupBy("judge_a", "judge_b").agg(F.count(F.lit(1)).alias("n"))


def coverage(counts: DataFrame, n: str, correct: str, top: int) -> DataFrame:
    """k, coverage: mean pass@k over problems with at least k samples."""
    rows = counts.groupBy(n, correct).agg(F.count(F.lit(1)).alias("m")).select(n, correct, "m", F.explode(F.sequence(F.lit(1), F.lit(top))).alias("k")).where(F.col("k") <= F.col(n))
    return rows.groupBy("k").agg((F.sum(pass_at_k(n, correct, F.col("k")) * F.col("m")) / F.sum("m")).alias("coverage"), F.sum("m").alias("problems"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the share of (positive, negative) pairs in order, ties half; null with one class only.

    From counts by distinct score, with a running sum of negatives over ranges: no pair is formed and no task sees all rows.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    rows = sum_before(counts, score, F.col("n"), out="under")
    return rows.agg((F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auroc"))


def calibration_error(df: DataFrame, score: str, label: str, key: str, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over bins of equal count (bounds b n // bins), and the Brier score."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    ranked = sum_before(df, score, F.lit(1), [key], "i").select("i", F.col(score).alias("s"), F.col(label).cast("double").alias("y")).crossJoin(F.broadcast(total))
    # the bin b holds b n // bins <= i < (b + 1) n // bins
    b = F.floor(((F.col("i") + 1) * bins - 1) / F.col("total"))
    rows = ranked.withColumn("b", b).groupBy("b", "total").agg(F.count(F.lit(1)).alias("m"), F.avg("s").alias("s"), F.avg("y").alias("y"), F.sum(F.pow(F.col("s") - F.col("y"), 2)).alias("q"))
    return rows.agg(F.sum(F.col("m") / F.col("total") * F.abs(F.col("s") - F.col("y"))).alias("ece"), F.sum(F.col("q") / F.col("total")).alias("brier"))


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row of counts and rates; rates with a zero denominator are 0."""
    rows = df.select(predicted.alias("p"), actual.alias("a")).agg(
        F.count_if(F.col("p") & F.col("a")).alias("tp"), F.count_if(F.col("p") & ~F.col("a")).alias("fp"), F.count_if(~F.col("p") & F.col("a")).alias("fn"), F.count_if(~F.col("p") & ~F.col("a")).alias("tn")
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return rows.select(
        "tp", "fp", "fn", "tn",
        F.round(rate(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(rate(tp, tp + fp), 6).alias("precision"), F.round(rate(tp, tp + fn), 6).alias("recall"),
        F.round(rate(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(rate(tp + fp, tp + fp + fn + tn), 6).alias("yes_ratio"),
    )


def token_f1(pairs: DataFrame, keys: list[str], predicted: Column, gold: Column) -> DataFrame:
    """keys, f1: multiset overlap of two token arrays; if one is empty, whether both are."""
    rows = pairs.select(*keys, predicted.alias("p"), gold.alias("g"))
    words = rows.select(*keys, F.explode("p").alias("w"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(rows.select(*keys, F.explode("g").alias("w"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    shared = words.groupBy(*keys, "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("s"))
    n, m = F.size("p"), F.size("g")
    return rows.join(shared, keys, "left").select(
        *keys, F.when((n == 0) | (m == 0), ((n == 0) & (m == 0)).cast("double")).otherwise(2 * F.coalesce("s", F.lit(0)) / (n + m)).alias("f1")
    )


def expected_best(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """by, expected: the mean of the best of n draws with replacement, from the distribution of values."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*by)
    up = F.sum("m").over(w.orderBy(value)) / F.sum("m").over(w)
    rows = counts.withColumn("hi", up).withColumn("lo", up - F.col("m") / F.sum("m").over(w))
    return rows.groupBy(*by).agg(F.sum(F.col(value) * (F.pow("hi", F.lit(float(n))) - F.pow("lo", F.lit(float(n))))).alias("expected"))


def outperforms(df: DataFrame, arm: str, a: str, b: str, value: str) -> DataFrame:
    """One row: the probability that a draw of arm a exceeds one of arm b, ties half."""
    rows = df.where(F.col(arm).isin(a, b)).withColumn("label", (F.col(arm) == a).cast("int"))
    return auroc(rows, value, "label").select(F.col("auroc").alias("probability"))


def blockers(cells: DataFrame, task: str, column: str, ok: Column) -> DataFrame:
    """column, sole, shared: tasks that this column alone keeps from passing, and those it does with others."""
    failing = cells.where(~ok).groupBy(task).agg(F.collect_set(column).alias("c"))
    return failing.select(F.explode("c").alias(column), F.size("c").alias("n")).groupBy(column).agg(F.count_if(F.col("n") == 1).alias("sole"), F.count_if(F.col("n") > 1).alias("shared"))
