"""Training rows out of graded samples: pools, lanes, pairs, repairs, fills, frozen prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import place_within, sum_before
from .rows import cap_per_group, first_reason


def evidence_pairs(df: DataFrame, group: list[str], order: str, good: Column, bad: Column, evidence: Column, k: int) -> DataFrame:
    """group, chosen, rejected: each of a group's first k good rows with each of its first k bad ones, where the evidence holds.

    evidence is a condition on g and b, structs of the two rows; k x k pairs a group at most.
    """
    rows = df.withColumn("_good", F.when(good, True).when(bad, False)).where(F.col("_good").isNotNull())
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_good").orderBy(order))).where(F.col("_n") <= k)
    side = lambda flag, name: rows.where(flag).select(*group, F.struct(*df.columns).alias(name))
    return side(F.col("_good"), "g").join(side(~F.col("_good"), "b"), group).where(evidence).select(*group, F.col(f"g.{order}").alias("chosen"), F.col(f"b.{order}").alias("rejected"))


def revalidated(imported: DataFrame, current: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """imported with status: 'current', 'changed' (the key has another digest now) or 'missing'."""
    now = current.select(*keys, F.col(digest).alias("_now"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing").when(F.col(digest).eqNullSafe(F.col("_now")), "current").otherwise("changed")
    return imported.join(now, keys, "left").withColumn("status", status).drop("_now", "_there")


def stronger(df: DataFrame, keys: list[str], strength: str, order: str) -> DataFrame:
    """One row for each key: its strongest (the earliest of equals), with the number of rows merged."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct((-F.col(strength)).alias("m"), F.col(order).alias("o"), F.struct(*rest).alias("row"))).alias("b")
    return df.groupBy(*keys).agg(best, F.count(F.lit(1)).alias("merged")).select(*keys, *[F.col(f"b.row.{c}").alias(c) for c in rest], "merged")


def graded_pool(samples: DataFrame, task: str, text: str, level: str, order: str, least: int, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the pool: samples of level `least` or more of tasks that are not blocked, equal texts of a task merged into the strongest; reason, n of the others)."""
    held = blocked.select(task).distinct().withColumn("_held", F.lit(True))
    reason = first_reason([("held out", F.col("_held").isNotNull()), ("below the level", F.col(level) < least)])
    judged = samples.join(held, task, "left").withColumn("reason", reason).drop("_held")
    kept = judged.where("reason is null").drop("reason")
    pool = stronger(kept.withColumn("_text", F.sha2(text, 256)), [task, "_text"], level, order).drop("_text")
    doubled = pool.agg(F.lit("duplicate").alias("reason"), F.coalesce(F.sum(F.col("merged") - 1), F.lit(0)).alias("n")).where("n > 0")
    refused = judged.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return pool, refused.unionByName(doubled)


def training_rows(samples: DataFrame, task: str, text: str, order: str, gates: list[tuple[str, Column]], cap: int) -> DataFrame:
    """Rows that no gate refuses, the first of each text of a task, at most `cap` of a task: place, from 1.

    The gates come before the deduplication: a refused first copy must not take an accepted later one with it.
    """
    kept = samples.withColumn("_reason", first_reason(gates)).where("_reason is null").drop("_reason").withColumn("_text", F.sha2(text, 256))
    rest = [c for c in kept.columns if c not in (task, "_text")]
    firsts = kept.groupBy(task, "_text").agg(F.min(F.struct(F.col(order).alias("o"), F.struct(*rest).alias("row"))).alias("m"))
    firsts = firsts.select(task, *[F.col(f"m.row.{c}").alias(c) for c in rest])
    place = F.row_number().over(Window.partitionBy(task).orderBy(order))
    return firsts.withColumn("place", place).where(F.col("place") <= cap)


def disagreeing(accepted: DataFrame, rejected: DataFrame, task: str, digest: str, cap: int) -> DataFrame:
    """Rejected rows of tasks with an accepted row of another digest, none that equals one: at most `cap` a task, by digest."""
    own = accepted.select(task, digest).distinct()
    rows = rejected.join(own.select(task).distinct(), task, "left_semi").join(own, [task, digest], "left_anti")
    return cap_per_group(rows.dropDuplicates([task, digest]), [task], [F.col(digest)], cap)


def merged_lanes(rows: DataFrame, lane: str, task: str, text: str, order: list[str], cap: int, refused: list[str]) -> DataFrame:
    """Rows of all lanes but the refused, lanes in their order: the first of each text of a task, `cap` a task; row_hash of task and text."""
    kept = rows.where(~F.col(lane).isin(refused)) if refused else rows
    kept = kept.withColumn("row_hash", F.sha2(F.concat_ws("\0", F.col(task).cast("string"), text), 256))
    rest = [c for c in kept.columns if c not in (task, "row_hash")]
    first = kept.groupBy(task, "row_hash").agg(F.min(F.struct(lane, *order, F.struct(*rest).alias("row"))).alias("m"))
    first = first.select(task, "row_hash", *[F.col(f"m.row.{c}").alias(c) for c in rest])
    return cap_per_group(first, [task], [F.col(lane), *map(F.col, order)], cap)


def repairs(drafts: DataFrame, task: str, sample: str, text: str, passes: Column, same: Column, most_repairs: int = 2, most_passes: int = 1) -> DataFrame:
    """Drafts that become conversations: built 'repair' (a new failing text) or 'pass' (it passes and is the proved text).

    Each text of a task counts once, at its first sample; drafts without text are left out.
    """
    rows = drafts.where((F.col(text).isNotNull()) & (F.col(text) != "")).withColumn("_text", F.sha2(text, 256)).withColumn("built", F.when(~passes, "repair").when(same, "pass"))
    rest = [c for c in rows.columns if c not in (task, "_text")]
    once = rows.groupBy(task, "_text").agg(F.min(F.struct(F.col(sample).alias("o"), F.struct(*rest).alias("row"))).alias("m")).select(task, *[F.col(f"m.row.{c}").alias(c) for c in rest])
    n = F.row_number().over(Window.partitionBy(task, "built").orderBy(sample))
    limit = F.when(F.col("built") == "repair", most_repairs).otherwise(most_passes)
    return once.where("built is not null").withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def repair_messages(question: str, draft: str, proved: str, verdict: Column, repair: Column) -> Column:
    """The messages of a conversation: question and draft, and for a repair the verdict on the draft and the proved answer."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    first = F.array(said("user", F.col(question)), said("assistant", F.col(draft)))
    return F.when(repair, F.concat(first, F.array(said("user", verdict), said("assistant", F.col(proved))))).otherwise(first)


def relabelled(rows: DataFrame, labels: DataFrame, task: str, key: str, cap: int) -> DataFrame:
    """Rows with the newer label where there is one; of the relabelled ones at most `cap` a task, none twice."""
    new = labels.select(key, F.col("label").alias("_new")).dropDuplicates([key])
    both = rows.join(new, key, "left")
    moved = both.where("_new is not null and not (_new <=> label)").withColumn("label", F.col("_new")).withColumn("relabelled", F.lit(True)).drop("_new")
    stay = both.where("_new is null or _new <=> label").withColumn("relabelled", F.lit(False)).drop("_new")
    return stay.unionByName(cap_per_group(moved, [task], [F.col(key)], cap))


def preference_rows(pairs: DataFrame, prompt: Column, chosen: Column, rejected: Column, block: int, ignore: int = -1) -> DataFrame:
    """pairs with the token arrays and targets of both sides, the prompt's masked; a pair that does not fit the block has null rows and a reason.

    prompt, chosen, rejected: arrays of ids, the completions with their end marker.
    """

    def row(side: Column) -> Column:
        ids = F.concat(prompt, side)
        targets = F.concat(F.array_repeat(F.lit(ignore), F.size(prompt)), side)
        return F.struct(F.slice(ids, F.lit(1), F.size(ids) - 1).alias("input"), F.slice(targets, F.lit(2), F.size(ids) - 1).alias("target"))

    need = F.size(prompt) + F.greatest(F.size(chosen), F.size(rejected))
    fits = need <= block + 1
    reason = F.when(F.size(chosen) == 0, "empty chosen").when(F.size(rejected) == 0, "empty rejected").when(~fits, "longer than the block")
    return pairs.withColumn("reason", reason).withColumn("chosen_row", F.when(F.col("reason").isNull(), row(chosen))).withColumn("rejected_row", F.when(F.col("reason").isNull(), row(rejected)))


def budget_fill(rows: DataFrame, kind: str, key: str, cost: str, budget: int) -> DataFrame:
    """Rows within a token budget: in turn over the kinds while the running sum fits, then of the others the shortest while they fit.

    A row's turn is its place within its kind. Places and both sums go over ranges of the order, so no task sees all
    rows, or all of a kind. The key is numeric.
    """
    ranked = place_within(rows, kind, key, "_turn")
    first = sum_before(ranked, "_turn", F.col(cost), [kind]).withColumn("_in", F.col("before") + F.col(cost) <= budget)
    stop = first.where(~F.col("_in")).agg(F.min("before").alias("stop"))  # the round stops at the first row that does not fit
    first = first.crossJoin(F.broadcast(stop)).withColumn("_in", F.col("_in") & (F.col("stop").isNull() | (F.col("before") < F.col("stop")))).drop("stop", "before")
    used = first.agg(F.coalesce(F.sum(F.when(F.col("_in"), F.col(cost))), F.lit(0)).alias("used"))
    rest = sum_before(first.where("not _in"), cost, F.col(cost), [key]).crossJoin(F.broadcast(used)).where(F.col("used") + F.col("before") + F.col(cost) <= budget)
    return first.where("_in").select(*rows.columns, F.lit("round").alias("part")).unionByName(rest.select(*rows.columns, F.lit("fill").alias("part")))


def after_frozen(rows: DataFrame, frozen: DataFrame, order: str, prompt: str, chosen: str) -> DataFrame:
    """The frozen rows unchanged, then the rows whose (prompt, chosen) is new, each once. An error unless `frozen` is a prefix of `rows`."""
    digest = F.sha2(F.concat_ws("\0", prompt, chosen), 256)
    all_, old = rows.withColumn("row_hash", digest), frozen.withColumn("row_hash", digest)
    last = old.agg(F.max(order).alias("m")).collect()[0]["m"]
    if last is None:
        differ, tail = False, all_
    else:
        head = all_.where(F.col(order) <= last).select(order, F.col("row_hash").alias("_now"))
        differ = not old.select(order, "row_hash").join(head, order, "full").where("not (row_hash <=> _now)").isEmpty()
        tail = all_.where(F.col(order) > last)
    if differ:
        raise ValueError("the frozen rows are not the beginning of the rows")
    rest = [c for c in tail.columns if c != "row_hash"]
    fresh = tail.join(old.select("row_hash"), "row_hash", "left_anti").groupBy("row_hash").agg(F.min(F.struct(F.col(order).alias("o"), F.struct(*rest).alias("row"))).alias("m"))
    fresh = fresh.select(*[F.col(f"m.row.{c}").alias(c) for c in rest], "row_hash")
    return old.withColumn("frozen", F.lit(True)).unionByName(fresh.select(*old.columns).withColumn("frozen", F.lit(False)))
