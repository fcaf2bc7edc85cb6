"""Reports on runs, arms, cells and held-out sets; checks that sets are what they are said to be."""

from __future__ import annotations

from collections.abc import Callable
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rows import first_reason


def reencountered(flagged: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One row: flagged ids, those met exactly once, several times, not at all."""
    seen = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    met = flagged.select(key).distinct().join(seen, key, "left")
    return met.agg(F.count(F.lit(1)).alias("flagged"), F.count_if(F.col("_n") == 1).alias("once"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("_n").isNull()).alias("absent"))


def weighted_ratio(df: DataFrame, by: list[str], part: Column, whole: Column) -> DataFrame:
    """by, ratio: sums over sums, null where the whole is 0."""
    total = F.sum(whole)
    return df.groupBy(*by).agg(F.when(total != 0, F.sum(part) / total).alias("ratio"))


def flattened(reason: Column, longest: int = 110) -> Column:
    """A refusal message without what differs from case to case: quoted names are 'X', whole numbers N."""
    return F.regexp_replace(F.regexp_replace(F.substring(reason, 1, longest), "'[^']*'", "'X'"), r"\b\d+\b", "N")


def top_reasons(df: DataFrame, reason: Column, n: int) -> DataFrame:
    """reason, n: the most frequent flattened reasons; ties by reason."""
    return df.groupBy(flattened(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def cell_fold(df: DataFrame, cell: list[str], admissible: Column, outcome: str, order: str) -> DataFrame:
    """cell, state: 'not admissible' if no row is, 'conflict' if the admissible rows' outcomes differ, else 'graded' with the last one's outcome."""
    value = F.when(admissible, F.col(outcome))
    folded = df.groupBy(*cell).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.count_if(admissible).alias("_n"), F.max_by(value, F.when(admissible, F.col(order))).alias("_last"))
    state = F.when(F.col("_n") == 0, "not admissible").when(F.col("_a") != F.col("_b"), "conflict").otherwise("graded")
    return folded.select(*cell, state.alias("state"), F.when(state == "graded", F.col("_last")).alias(outcome))


def held_out_scores(answers: DataFrame, by: list[str], task: Column, passed: Column, graded: Column, proven: Column, recited: Column) -> DataFrame:
    """by and the counts of a held-out table; clean = graded, proven and passed; converts = 'clean/passed (percent)'."""
    clean = graded & proven & passed
    counts = {
        "answered": F.lit(True), "task": task, "tests_pass": passed, "graded": graded, "clean": clean, "wrong_but_proven": graded & proven & ~passed,
        "clean_recited": clean & recited, "clean_novel": clean & ~recited,
    }
    out = answers.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    share = F.concat(F.lit(" ("), F.round(F.col("clean") * 100 / F.col("tests_pass")).cast("int").cast("string"), F.lit("%)"))
    return out.withColumn("converts", F.concat(F.col("clean").cast("string"), F.lit("/"), F.col("tests_pass").cast("string"), F.when(F.col("tests_pass") > 0, share).otherwise("")))


def paired_arms(df: DataFrame, unit: str, arm: str, a: str, b: str, signature: str, value: str) -> DataFrame:
    """One row: units in both arms on the same inputs, wins, losses, ties, the mean difference b - a; units in one arm alone; units whose inputs differ (refused)."""
    sides = df.where(F.col(arm).isin(a, b)).groupBy(unit).agg(*[f(F.when(F.col(arm) == x, F.col(c))).alias(f"{n}{k}") for k, x in enumerate((a, b)) for n, f, c in (("v", F.max, value), ("s", F.max, signature), ("n", F.count, value))])
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    same = both & F.col("s0").eqNullSafe(F.col("s1"))
    d = F.col("v1") - F.col("v0")
    count = lambda c: F.count_if(c)
    return sides.agg(
        count(same).alias("paired"), count(same & (d > 0)).alias("wins"), count(same & (d < 0)).alias("losses"), count(same & (d == 0)).alias("ties"),
        F.avg(F.when(same, d)).alias("difference"), count(~both).alias("one_arm"), count(both & ~same).alias("mismatched"),
    )


def first_values(rows: DataFrame, key: list[str], column: str, most: int, out: str, salts: int = 64) -> DataFrame:
    """key, n_<out>, <out>: the number of a column's distinct values in each group, and the first `most` of them.

    Values are made distinct before they are gathered, and of those gathered by a task only the first `most` go on, so no
    row ever holds a group's whole set.
    """
    few = lambda lists: F.slice(F.array_sort(lists), 1, most)
    once = rows.where(F.col(column).isNotNull()).select(*key, F.col(column).alias("_v")).distinct().withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)))
    place = Window.partitionBy(*key, "_salt").orderBy("_v")
    part = once.withColumn("_n", F.row_number().over(place)).groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.when(F.col("_n") <= most, F.col("_v"))).alias("_few"))
    return part.groupBy(*key).agg(F.sum("_n").alias(f"n_{out}"), few(F.flatten(F.collect_list("_few"))).alias(out))


def holdout_groups(runs: DataFrame, key: list[str], sets: dict[str, str], most: int = 20) -> DataFrame:
    """Runs by what they were held out on: how many, and the distinct values of some columns (their number, and the first `most` of them)."""
    out = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("runs"))
    for name, column in sets.items():
        values = first_values(runs, key, column, most, name)
        same = [out[c].eqNullSafe(values[c]) for c in key]
        out = out.join(values, same, "left").select(*[out[c] for c in out.columns], F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}"), values[name])
    return out


def exclusion_proof(before: DataFrame, after: DataFrame, flagged: DataFrame, key: str, by: str) -> DataFrame:
    """by, before, flagged, after, proven: per file, that exactly the flagged rows are gone, by count and by set."""
    a = before.select(key, by).join(flagged.select(key).distinct().withColumn("_f", F.lit(1)), key, "left").join(after.select(key).distinct().withColumn("_k", F.lit(1)), key, "left")
    counts = a.groupBy(by).agg(F.count(F.lit(1)).alias("before"), F.count("_f").alias("flagged"), F.count("_k").alias("after"), F.count_if(F.col("_f").isNotNull() == F.col("_k").isNotNull()).alias("_wrong"))
    return counts.select(by, "before", "flagged", "after", ((F.col("_wrong") == 0) & (F.col("before") == F.col("flagged") + F.col("after"))).alias("proven"))


def cleaned(held: DataFrame, train: DataFrame, tests: dict[str, str]) -> DataFrame:
    """held with the first reason to remove a row: a key (reason: column) that training has too; null keys match nothing."""
    out = held
    for k, column in enumerate(tests.values()):
        known = train.where(F.col(column).isNotNull()).select(column).distinct().withColumn(f"_{k}", F.lit(True))
        out = out.join(known, column, "left")
    reason = first_reason([(name, F.col(f"_{k}").isNotNull()) for k, name in enumerate(tests)])
    return out.withColumn("reason", reason).select(*held.columns, "reason")


def findings_by_problem(findings: DataFrame, gate: str, problem: str, detail: str, most: int = 5) -> DataFrame:
    """gate, problem, n, details: findings and the first few distinct details of each problem."""
    out = holdout_groups(findings, [gate, problem], {"details": detail}, most)
    return out.select(gate, problem, F.col("runs").alias("n"), F.coalesce("details", F.slice(F.array(F.lit("")), 1, 0)).alias("details"))


def closed_fraction(table: Column, model: Column, ineligible: Column) -> tuple[Column, Column]:
    """(how much of the way from a lookup table's choices per character to 1 a model closes, why there is no number)."""
    reason = F.coalesce(ineligible, F.when(table <= 1.0, "no denominator"))
    return F.when(reason.isNull(), (table - model) / (table - 1.0)), reason


def eligible(split_verdict: Column, leakage_verdict: Column) -> tuple[Column, Column]:
    """(whether a holdout's number may be reported, why not): the split's verdict first, then the leakage verdict."""
    reason = first_reason([("split: " + v, split_verdict == v) for v in ("empty", "corpus", "splitter")] + [("leakage: " + v, leakage_verdict == v) for v in ("CONTAMINATED", "SUSPECT")])
    return reason.isNull(), reason


def shown_report(df: DataFrame, arm: str, answerable: Column, shown: Column, right: Column) -> DataFrame:
    """arm and, over answerable and unanswerable questions, how many were answered, rightly, and left empty."""
    n = lambda c: F.count_if(c)
    return df.groupBy(arm).agg(
        n(answerable).alias("answerable"), n(answerable & shown).alias("shown"), n(answerable & shown & right).alias("right"), n(answerable & ~shown).alias("empty"),
        n(~answerable).alias("unanswerable"), n(~answerable & shown).alias("invented"), n(~answerable & ~shown).alias("rightly_empty"),
    )


def problem_fractions(df: DataFrame, problem: list[str], flag: Column) -> DataFrame:
    """problem, decodes, fraction of them with the flag."""
    return df.groupBy(*problem).agg(F.count(F.lit(1)).alias("decodes"), F.avg(flag.cast("double")).alias("fraction"))


def support(pairs: DataFrame, claim: list[str], sentence: str, score: Column) -> DataFrame:
    """claim, support: the mean over a claim's sentences of the best score of any chunk; the scorer is a column."""
    best = pairs.groupBy(*claim, sentence).agg(F.max(score).alias("_best"))
    return best.groupBy(*claim).agg(F.avg("_best").alias("support"))


# ------------------------------------------------------------------ resampling, on lists of a report's size


def bootstrap(a: list[float], b: list[float], statistic: Callable[[list, list], float], paired: bool, draws: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """The 2.5 and 97.5 percentiles of the statistic over resampled lists (pairs stay together): the values at the floor and the ceiling of the ranks."""
    random, found = Random(seed), []
    for _ in range(draws):
        pick = [random.randrange(len(a)) for _ in a]
        other = pick if paired else [random.randrange(len(b)) for _ in b]
        found.append(statistic([a[i] for i in pick], [b[i] for i in other]))
    found.sort()
    low, high = 25 * (draws - 1), 975 * (draws - 1)  # thousandths
    return found[low // 1000], found[-(-high // 1000)]


def sign_flips(differences: list[float], draws: int = 20_000, seed: int = 0) -> float:
    """Monte Carlo p of a paired permutation test: how often random signs give a sum at least as far from 0; zeros are left out."""
    values = [d for d in differences if d]
    if not values:
        return 1.0
    random, seen = Random(seed), abs(sum(values)) - 1e-12
    return sum(abs(sum(v if random.random() < 0.5 else -v for v in values)) >= seen for _ in range(draws)) / draws
