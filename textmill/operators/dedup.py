"""Exact and normalised deduplication, splits and their health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import below, holdout, sha256
from ..functions.text import normalized, strip_py
from ..session import spread, written


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the given order.

    A grouped minimum, so that a key with a third of all rows is combined before the shuffle.
    """
    rest = [x for x in df.columns if x not in keys]
    least = F.min(F.struct(*[F.col(o) for o in order], F.struct(*rest).alias("_row"))).alias("_m")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"_m._row.{x}").alias(x) for x in rest]).select(df.columns)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key: last write wins."""
    rest = [x for x in df.columns if x not in keys]
    most = F.max(F.struct(*[F.col(o) for o in order], F.struct(*rest).alias("_row"))).alias("_m")
    return df.groupBy(*keys).agg(most).select(*keys, *[F.col(f"_m._row.{x}").alias(x) for x in rest]).select(df.columns)


def exact_first(docs: DataFrame, mode: str = "raw") -> DataFrame:
    """doc_id, digest of the first document of each text (mode 'raw') or stripped text ('stripped')."""
    text = F.col("text") if mode == "raw" else strip_py("text")
    return docs.select("doc_id", F.sha1(text).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


def duplicate_of(docs: DataFrame) -> DataFrame:
    """Each later copy by normalised text with the kept document, and whether it is an exact or a normalised copy.

    Both digests are computed once and written; texts are not moved. The kept document is a minimum of ids alone.
    """
    rows = written(spread(docs.select("doc_id", "text")).select("doc_id", sha256("text").alias("sha"), sha256(normalized("text")).alias("norm")))
    kept = rows.groupBy("norm").agg(F.min("doc_id").alias("duplicate_of"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = rows.join(kept, "norm").where("doc_id > duplicate_of")
    first = rows.select(F.col("doc_id").alias("duplicate_of"), F.col("norm"), F.col("sha").alias("kept_sha"))
    # rows that repeat the kept id have one text each: the least digest counts, as with a minimum over both
    first = first.join(kept, ["norm", "duplicate_of"], "left_semi").groupBy("duplicate_of", "norm").agg(F.min("kept_sha").alias("kept_sha"))
    return copies.join(first, ["duplicate_of", "norm"]).select("doc_id", "duplicate_of", F.when(F.col("sha") == F.col("kept_sha"), "exact").otherwise("normalized").alias("reason"))


def group_report(docs: DataFrame) -> DataFrame:
    """One row: groups of equal texts, records in them, groups across and within sources."""
    groups = docs.groupBy(sha256("text").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources")).where("n > 1")
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.count_if(F.col("sources") > 1).alias("across"),
        F.count_if(F.col("sources") == 1).alias("within"),
    )


def source_pairs(docs: DataFrame) -> DataFrame:
    """For each two sources, the texts they share."""
    held = docs.select(sha256("text").alias("h"), "source").distinct()
    sets = held.groupBy("h").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)  # sources are few
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def hash_split(docs: DataFrame, share: float = 0.1, seed: int = 1337) -> DataFrame:
    return docs.select("doc_id", F.when(holdout("text", share, seed), "val").otherwise("train").alias("split"))


def hash_split_rows(docs: DataFrame, share: float = 0.1, seed: int = 1337) -> DataFrame:
    """doc_id, text, split: the side follows from the text, so texts are neither joined nor moved, however many they are (doc_ids are distinct)."""
    return spread(docs.select("doc_id", "text")).select("doc_id", "text", F.when(holdout("text", share, seed), "val").otherwise("train").alias("split"))


def family_split(docs: DataFrame, family: str | Column, share: float = 0.1) -> DataFrame:
    """All members of a family on one side, by the family's whole digest."""
    key = F.col(family) if isinstance(family, str) else family
    return docs.withColumn("split", F.when(below(sha256(key.cast("string")), share, 64), "val").otherwise("train"))


def split_health(split: DataFrame, docs: DataFrame, share: float = 0.1) -> DataFrame:
    """One row: characters on each side, share reached, verdict."""
    rows = docs.select("doc_id", F.char_length("text").alias("chars")).join(split, "doc_id").select("split", "chars")  # texts are not moved
    sums = rows.agg(
        F.coalesce(F.sum(F.when(F.col("split") == "val", F.col("chars"))), F.lit(0)).alias("val_chars"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.max("chars"), F.lit(0)).alias("longest")
    )
    reached = F.col("val_chars") / F.col("chars")
    return sums.select(
        "val_chars",
        "chars",
        F.round(reached, 6).alias("reached"),
        F.when(F.col("chars") == 0, "empty").when(reached >= 0.8 * share, "healthy").when(F.col("longest") > share * F.col("chars"), "corpus").otherwise("splitter").alias("verdict"),
    )


def greedy_split(lengths: DataFrame, share: float = 0.1, seed: int = 1337) -> DataFrame:
    """Fill a validation side in hash order up to share x total; the order is a hash order, not a shuffle.

    Lengths alone are folded: rows whose running sum stays within the budget are chosen. The
    running sum is global, so it is taken over bucket sums first, then inside each bucket.
    """
    rows = lengths.select("doc_id", F.col("n").cast("long").alias("n"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256).alias("o")).withColumn("b", F.substring("o", 1, 3))
    sums = rows.groupBy("b").agg(F.sum("n").alias("m"))
    before = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows
    base = sums.select("b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("b").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    total = sums.agg(F.sum("m").alias("total"))
    run = rows.join(F.broadcast(base), "b").withColumn("run", F.col("base") + F.sum("n").over(inside)).join(F.broadcast(total))
    return run.select("doc_id", F.when(F.col("run") <= F.col("total") * share, "val").otherwise("train").alias("split"))


#: Candidates that one round of first-fit looks at beyond the prefix.
ROUND = 10_000


def filled_split(lengths: DataFrame, share: float = 0.1, seed: int = 1337, rounds: int = ROUND) -> DataFrame:
    """doc_id, split: documents in hash order fill a validation side of share x total characters; one that does not fit is passed over, later ones that do are taken.

    The prefix that fits as a whole is found by running sums over hash ranges. What is left then is less than one
    document, and only shorter documents count: they come in order, `rounds` at a time, until none fits. A second
    pass over what was passed over, the shortest first, could add nothing: the room only shrinks. Empty documents always
    fit. If all fit there would be no training side: then nothing is held out. doc_ids are distinct.
    """
    rows = written(lengths.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256).alias("o")).withColumn("b", F.substring("o", 1, 3)))
    target = (rows.agg(F.sum("n")).first()[0] or 0) * share
    sums = rows.groupBy("b").agg(F.sum("n").alias("m"))
    before = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows
    base = sums.select("b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("b").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(F.broadcast(base), "b").withColumn("run", F.col("base") + F.sum("n").over(inside))
    edge = run.agg(F.min(F.when(F.col("run") > target, F.col("o"))).alias("o"), F.coalesce(F.max(F.when(F.col("run") <= target, F.col("run"))), F.lit(0)).alias("used")).first()
    first, last, room, later = edge["o"], edge["o"], target - edge["used"], []
    while last is not None and room >= 1:
        some = rows.where((F.col("o") > last) & (F.col("n") >= 1) & (F.col("n") <= room)).orderBy("o").limit(rounds).select("o", "n").collect()
        for r in some:
            if r["n"] <= room:
                room -= r["n"]
                later.append(r["o"])
        last = some[-1]["o"] if len(some) == rounds else None
    taken = F.col("n") == 0
    if first is None:
        return rows.select("doc_id", F.lit("train").alias("split"))
    taken = taken | (F.col("o") < first)
    if later:
        more = F.broadcast(rows.sparkSession.createDataFrame([(o,) for o in later], "o string").withColumn("_taken", F.lit(True)))
        rows = rows.join(more, "o", "left")
        taken = taken | F.coalesce("_taken", F.lit(False))
    return rows.select("doc_id", F.when(taken, "val").otherwise("train").alias("split"))
