"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree has regions, racks and shards, with weights at the leaves. A row starts at the
root and at every level draws, for each child, -ln(u) / weight with u from a hash of
(child's name, key); the smallest draw wins. A child's draw depends on that child
alone, so a change of weights moves rows only between the changed subtree and its
siblings at each level above it; nothing inside an unchanged subtree moves.

Growth law (`key`): `grown_tree` puts every shard beyond the base eight in a region of
its own, so a row moves only if the new region wins its root draw, and then it can
only land in the new shard. The shard depends on doc_id and the shard count alone.

Nulls and edges: a null key hashes as the one string 'null'; a null text has size 1 and
crc32 0; repeated rows share a shard and get slots of their own; an empty table gives an
empty result; other columns are ignored, also those named like a result column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hex digits of the hash by which slots are dealt: 16 ** DIGITS buckets a shard, whose counts are the only global state.
DIGITS = 3
#: Shards of the balanced part of the tree: 2 regions of 2 racks of 2 shards.
BASE = 8


@dataclass(frozen=True)
class Node:
    """A subtree; a leaf has a shard number."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int = -1


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def grown_tree(shards: int, weights: dict[int, float] | None = None) -> Node:
    """Regions of two racks of two shards up to BASE shards, then a region for each further one."""
    w = weights or {}
    leaf = lambda s: Node(f"s{s}", w.get(s, 1.0), (), s)
    regions = []
    for r in range(0, min(shards, BASE), 4):
        racks = [inner(f"k{k // 2}", [leaf(s) for s in range(k, min(k + 2, shards, BASE))]) for k in range(r, min(r + 4, shards, BASE), 2)]
        regions.append(inner(f"r{r // 4}", racks))
    regions += [inner(f"r{s}", [inner(f"k{s}", [leaf(s)])]) for s in range(BASE, shards)]
    return inner("root", regions)


def unit_draw(name: str, key: Column) -> Column:
    """A uniform number in (0, 1): 13 hex digits (52 bits) of md5(name ':' key)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{name}:"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def descend(node: Node, key: Column) -> Column:
    """The shard that the key reaches below node."""
    if node.shard >= 0:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return descend(live[0], key)
    draws = [(-F.ln(unit_draw(c.name, key)) / F.lit(float(c.weight)), c) for c in live]
    least = F.least(*[d for d, _ in draws])
    pick = F.when(draws[0][0] == least, descend(draws[0][1], key))
    for d, c in draws[1:-1]:
        pick = pick.when(d == least, descend(c, key))
    return pick.otherwise(descend(draws[-1][1], key))


def assign(df: DataFrame, tree: Node, key: str, out: str = "shard") -> DataFrame:
    """df with the shard of every row; names in df are left alone but for `out`."""
    return df.withColumn(out, descend(tree, F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("int"))


def with_slots(df: DataFrame, group: str, order: list[str], digits: int = DIGITS) -> DataFrame:
    """Gapless slots from 0 within each value of `group`, without gathering a group in one task.

    Rows are dealt to buckets by the first digits of a hash of the order columns; a running
    sum over the bucket counts (at most groups x 16 ** digits rows) gives each bucket's first
    slot, and row_number within (group, bucket) does the rest.
    """
    rows = df.withColumn("_bucket", F.substring(F.md5(F.concat_ws(":", *order)), 1, digits))
    counts = rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(within))
        .join(first, [group, "_bucket"])
        .withColumn("slot", (F.col("_first") + F.col("_rank") - 1).cast("long"))
        .drop("_bucket", "_rank", "_first")
    )


def shard_documents(docs: DataFrame, shards: int = BASE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
    )
    rows = assign(rows, grown_tree(shards), "doc_id", "shard")
    rows = assign(rows, grown_tree(shards + 1), "doc_id", "grown_shard")
    out = with_slots(rows, "shard", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
