"""The best share of a total that some subset of many lengths reaches, without bringing the lengths together.

Lengths are counted by (quantised) value, so equal ones are one row. Each task turns its rows into the set of
sums that they reach, a bit for each sum up to the target, copies by binary splitting. Sets of different rows
are added: a sum is reached if it is one of the first set plus one of the second (a convolution), level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code

#: Steps that a total is divided into, parts that reach sums by themselves, and sets that one task adds.
STEPS, PARTS, FAN = 200_000, 64, 8


def reached(rows: list[tuple[int, int]], most: int) -> int:
    """The sums up to `most` that (length, copies) reach, as bits."""
    bits, mask = 1, (1 << most + 1) - 1
    for length, copies in rows:
        times = 1
        while copies > 0 and length <= most:
            take = min(times, copies)
            bits |= bits << length * take & mask if length * take <= most else 0
            copies, times = copies - take, times * 2
    return bits & mask


def added(a: int, b: int, most: int) -> int:
    """The sums of one of a and one of b, up to `most`."""
    if min(a.bit_count(), b.bit_count()) <= 64:
        few, other = sorted((a, b), key=int.bit_count)
        out = 0
        while few:
            low = few & -few
            out |= other << low.bit_length() - 1
            few ^= low
        return out & (1 << most + 1) - 1
    size = 1 << (2 * most + 1).bit_length()
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(most // 8 + 1, "little"), np.uint8), bitorder="little")[: most + 1].astype(float)
    ways = np.fft.irfft(np.fft.rfft(bits(a), size) * np.fft.rfft(bits(b), size), size)[: most + 1]
    return int.from_bytes(np.packbits(ways > 0.5, bitorder="little").tobytes(), "little")


def best_share(lengths: DataFrame, length: str, share: float, steps: int = STEPS, parts: int = PARTS) -> DataFrame:
    """One row: total, target, best (the greatest reachable sum at most the target, in whole steps) and reached = best / total.

    Lengths are whole steps of total // steps, at least one; with a total below `steps` all is exact. Null and
    negative lengths don't count; an empty table reaches 0.
    """
    spark = lengths.sparkSession
    ship_code(spark)
    rows = lengths.where(F.col(length) >= 0).select(F.col(length).cast("long").alias("n"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scale = max(1, total // steps)
    most = int(total * share) // scale
    step_of = F.greatest(F.lit(1), F.call_function("div", F.col("n"), F.lit(scale).cast("long")))
    # more copies than reach the target make no further sums
    counts = rows.groupBy(step_of.alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("w") <= most)
    counts = counts.select("w", F.least("n", F.lit(most) / F.col("w")).cast("long").alias("n"), F.pmod(F.xxhash64("w"), F.lit(parts)).cast("long").alias("part"))
    schema = "part long, bits binary"

    def packed(part: int, bits: int) -> pa.Table:
        return pa.table({"part": pa.array([part], pa.int64()), "bits": pa.array([bits.to_bytes(most // 8 + 1, "little")], pa.binary())})

    def first(table: pa.Table) -> pa.Table:
        return packed(table["part"][0].as_py() // FAN, reached(list(zip(table["w"].to_pylist(), table["n"].to_pylist(), strict=True)), most))

    def merge(table: pa.Table) -> pa.Table:
        out = 1
        for bits in table["bits"].to_pylist():
            out = added(out, int.from_bytes(bits, "little"), most)
        return packed(table["part"][0].as_py() // FAN, out)

    sets, left = counts.groupBy("part").applyInArrow(first, schema), parts
    while left > 1:
        left = -(-left // FAN)
        sets = sets.groupBy("part").applyInArrow(merge, schema)
    found = sets.select("bits").collect()  # one set of at most steps / 8 bytes
    best = max((int.from_bytes(r["bits"], "little").bit_length() - 1 for r in found), default=0) * scale
    return spark.range(1).select(F.lit(total).cast("long").alias("total"), F.lit(int(total * share)).cast("long").alias("target"), F.lit(best).cast("long").alias("best"), F.lit(best / total if total else 0.0).alias("reached"))
