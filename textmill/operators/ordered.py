"""Global orders without a single task: running sums, ranks and medians by ranges of the order; broadcasts by count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges that a global order is cut into.
RANGES = 200


#: Rows that are broadcast at most.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if it has at most `rows` rows (they are counted); else joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _cuts(df: DataFrame, order: str, ranges: int) -> list[float]:
    return sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.002)))


def _place(order: str, cuts: list[float]) -> Column:
    """How many of the cuts are at most the value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(order).cast("double")))


def ranged(df: DataFrame, order: str, ranges: int = RANGES, second: str | None = None) -> DataFrame:
    """df with _range: the place of a numeric column among its approximate quantiles (a sketch of bounded size).

    second: rows that equal a quantile (frequent values do) are ranges of their own, cut once more by this numeric column.
    """
    cuts = _cuts(df, order, ranges)
    if second is None or not cuts:
        return df.withColumn("_range", _place(order, cuts))
    equal = F.array_contains(F.array(*[F.lit(c) for c in cuts]), F.col(order).cast("double"))
    inner = F.when(equal, _place(second, _cuts(df, second, ranges))).otherwise(ranges)
    return df.withColumn("_range", _place(order, cuts) * (ranges + 1) + inner)


def sum_before(df: DataFrame, order: str, value: Column, then: list[str] | None = None, out: str = "before", second: str | None = None) -> DataFrame:
    """df with the sum of `value` over all rows that come earlier in the order.

    Sums by range first (a bounded number of them meets in one task), then inside each range. Equal
    order values stay in one range, unless `second` (numeric, the first of `then`) splits them; `then` orders them,
    else they count as one (none before another).
    """
    rows = ranged(df.withColumn("_value", value), order, second=second)
    sums = rows.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_range").orderBy(order, *(then or []))
    inside = F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, -1)) if then else F.sum("_value").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("_value").over(Window.partitionBy("_range", order))
    return rows.join(F.broadcast(base), "_range").withColumn(out, F.col("_base") + F.coalesce(inside, F.lit(0))).drop("_range", "_value", "_base")


def ranked(df: DataFrame, order: str, then: list[str], out: str = "place") -> DataFrame:
    """df with each row's place, from 1, in the order of a numeric column and then others, the first of them numeric; no hot value is one task."""
    return sum_before(df, order, F.lit(1), then, out, second=then[0]).withColumn(out, F.col(out) + 1)


def place_within(df: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """df with each row's place, from 1, within its group in the order of a numeric column of distinct values: counts of (group, range) first, then inside each."""
    rows = ranged(df, order)
    counts = rows.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order))
    joined = rows.withColumn("_inside", inside).join(base, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn(out, F.col("_base") + F.col("_inside")).drop("_range", "_inside", "_group", "_at", "_base")


def median(df: DataFrame, value: str, out: str = "median") -> DataFrame:
    """One row: the exact median, from the counts of distinct values; no task sees all rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    total = F.broadcast(counts.agg(F.sum("_n").alias("_total")))
    runs = sum_before(counts, value, F.col("_n")).crossJoin(total)
    lower, upper = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("_n"))
    return runs.agg(((F.max(F.when(holds(lower), F.col(value))) + F.max(F.when(holds(upper), F.col(value)))) / 2).alias(out))
