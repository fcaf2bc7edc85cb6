"""Exact Jaccard self-join of documents on word n-grams, as a blocked sparse product.

The documents are the rows and the n-grams the columns of an incidence matrix A; the join
is the part of A x A' that a Jaccard similarity of `percent` leaves.

1. *Classes.* Documents with equal sets are one row of the matrix.
2. *Columns in an order.* N-grams that recur within a task are counted over the corpus;
   every row lists its n-grams from the least to the most frequent (ties by hash) and
   enters with the first n - ceil(t n) + 1 of them. Two rows above the threshold t share at
   least one of these, whatever the order; the order keeps frequent passages out.
3. *Blocks.* The columns are cut into blocks by hash. A block keeps the columns with two
   rows or more (most have one). A task sends one row per column and passes further rows of
   the same column on as they are, so no block holds more rows of a column than tasks.
4. *Product.* Overlap counts of pairs are accumulated over shared columns. With c shared
   of the entered columns, the whole overlap is at most c + min(n_x - p_x, n_y - c) or the same
   with x and y swapped, and must be at least t / (1 + t) (n_x + n_y); other pairs are
   discarded. The rest are compared on their whole sets.
5. *Full columns.* A column with more than HOT rows (a large group of near copies) would give
   a table of all its pairs. Rows that full columns connect are a cluster instead, multiplied
   with whole sets in dense tiles of at most TILE rows and TILE_ENTRIES entries on a side. Rows
   are banded by size first, so that tiles whose sizes rule a link out never meet. A tile
   returns no pairs but a spanning forest of its links, at most one row for each of its rows. For
   pairs met in other columns, c then counts all full columns that both rows could share.

Nulls and edges: a null or empty text has no n-grams and links with nothing; texts of
fewer words than n have their whole sequence as the one n-gram; a row with a null doc_id
links with nothing (component_id null); rows that repeat a doc_id are told apart by their
sets; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .bpe import HashIndex
from .common import (
    LOWER,
    arrow_map,
    buffers,
    claim,
    long_list,
    materialize,
    range_hash,
    ranges,
    semi_by_id,
    sequence_hash,
    set_hash,
    slices,
    text_array,
    window_hash,
    word_spans,
)

#: Entries of the incidence matrix that one block holds, about.
BLOCK_ENTRIES = 800_000
#: Frequent n-grams whose counts are used for the order (16 bytes each in every worker).
ORDERED = 500_000
#: Rows beyond which a column is multiplied as a dense block, and rows on a tile's side.
HOT, TILE = 100, 1000
#: Entries on a tile's side, about (one longer set is a side by itself).
TILE_ENTRIES = 1_000_000
#: Entries that a task holds before it sends them to their blocks.
HELD = 500_000


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct n-gram hashes of every text."""
    buf = LOWER[buf]
    starts, ends, wo = word_spans(buf, offs)
    words = range_hash(buf, starts, ends)
    counts = np.diff(wo)
    short = (counts > 0) & (counts < n)
    per = np.where(short, 1, np.maximum(counts - n + 1, 0))
    at = ranges(wo[:-1], per)
    text = np.repeat(np.arange(len(per)), per)
    size = np.where(short, counts, n)[text]
    h = np.empty(len(at), np.uint64)
    full = size == n
    h[full] = window_hash(words, n)[at[full]] if full.any() else 0
    h[~full] = sequence_hash(words, at[~full], size[~full])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[keep], text[keep]
    return h, np.searchsorted(text, np.arange(len(per) + 1))


def _blocks(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf_all, offs_all = buffers(text_array(batch.column("text")))
    for i, j in slices(offs_all):
        yield i, j, *shingle_sets(buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i], n)


def prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def summarize(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: doc_id, n_shingles, node, check (a document); node, n_shingles with a null check (a recurring n-gram, its count)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def recurring() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            again = counts > 1
            m = int(again.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(counts[again]), pa.array(keys[again].view(np.int64)), pa.nulls(m, pa.int64())], ["doc_id", "n_shingles", "node", "check"])

        for batch in batches:
            for i, j, h, cut in _blocks(batch, n):
                count = np.diff(cut)
                node = set_hash(h, cut).view(np.int64)
                check = set_hash(h, cut, 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(count), pa.array(node), pa.array(check)], ["doc_id", "n_shingles", "node", "check"])
                held.append(h)
                size += len(h)
                if size > 1_500_000:
                    yield recurring()
                    held, size = [], 0
        if held:
            yield recurring()

    return arrow_map(docs, step, "doc_id long, n_shingles long, node long, check long")


def _order(counts: DataFrame) -> dict[str, np.ndarray]:
    """The most frequent n-grams and their counts, at most ORDERED of them."""
    from .byte_bpe import least_count

    table = counts.where(F.col("n") >= least_count(counts, ORDERED, 4)).select("node", "n").toArrow()
    if not len(table):
        return {"keys": np.zeros(0, np.uint64), "n": np.zeros(0, np.int64)}
    return {"keys": table["node"].to_numpy().view(np.uint64), "n": np.minimum(table["n"].to_numpy(), (1 << 22) - 1)}


_held: list = []


def _ordered(shared) -> tuple[HashIndex, np.ndarray]:
    if not _held or _held[0] is not shared:
        claim(__name__, _held.clear)
        _held[:] = [shared, (HashIndex(shared.value["keys"]), shared.value["n"])]
    return _held[1]


def entries(docs: DataFrame, n: int, percent: int, shared, blocks: int) -> DataFrame:
    """block, hs, nodes: the entered part of the incidence matrix; negative blocks hold columns known to have two rows."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, freq = _ordered(shared)
        hs, nodes, size, part = [], [], 0, 0

        def send() -> pa.RecordBatch:
            nonlocal part
            h, node = np.concatenate(hs), np.concatenate(nodes)
            order = np.lexsort((node, h))
            h, node = h[order], node[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
            h, node = h[new], node[new]
            lead = np.ones(len(h), bool)
            lead[1:] = h[1:] != h[:-1]
            run = np.flatnonzero(lead)
            sizes = np.diff(np.append(run, len(h)))
            block = (h >> np.uint64(1)).astype(np.int64) % blocks
            part += 1
            pass_on = -1 - (mix_int(node) % blocks)
            several = np.repeat(sizes > 1, sizes)
            # every row of a recurring column is passed on; its first row also meets the other tasks' rows
            dest = np.concatenate([block[lead], pass_on[several]])
            h2, node2 = np.concatenate([h[lead], h[several]]), np.concatenate([node[lead], node[several]])
            order = np.argsort(dest, kind="stable")
            dest, h2, node2 = dest[order], h2[order], node2[order]
            names, first = np.unique(dest, return_index=True)
            cut = np.append(first, len(dest))
            return pa.RecordBatch.from_arrays([pa.array(names), long_list(h2, cut), long_list(node2, cut)], ["block", "hs", "nodes"])

        for batch in batches:
            for _, _, h, cut in _blocks(batch, n):
                count = np.diff(cut)
                text = np.repeat(np.arange(len(count)), count)
                node = set_hash(h, cut).view(np.int64)
                key = h >> np.uint64(1)
                hot = index.find(h)
                is_hot = hot >= 0
                key[is_hot] = np.uint64(1 << 63) | freq[hot[is_hot]].astype(np.uint64) << np.uint64(41) | h[is_hot] >> np.uint64(23)
                order = np.lexsort((h, key, text)) if is_hot.any() else slice(None)  # else already in order
                ranked = h[order]
                p = prefix_lengths(count, percent)
                at = ranges(cut[:-1], p)
                hs.append(ranked[at])
                nodes.append(np.repeat(node, p))
                size += len(at)
                if size > HELD:
                    yield send()
                    hs, nodes, size = [], [], 0
        if size:
            yield send()

    return arrow_map(docs, step, "block long, hs array<long>, nodes array<long>")


def mix_int(x: np.ndarray) -> np.ndarray:
    return (x.view(np.uint64) >> np.uint64(33)).astype(np.int64)


def _recurring_columns(table: pa.Table) -> pa.Table:
    """h, node: of one block, the entries of the columns with two rows or more."""
    h = table["hs"].combine_chunks().flatten().to_numpy()
    node = table["nodes"].combine_chunks().flatten().to_numpy()
    if table["block"][0].as_py() >= 0:
        order = np.argsort(h, kind="stable")
        h, node = h[order], node[order]
        same = h[1:] == h[:-1]
        several = np.zeros(len(h), bool)
        several[1:] |= same
        several[:-1] |= same
        h, node = h[several], node[several]
    return pa.table({"h": h, "node": node})


def _possible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """x, y that the sizes, the shared entries c and the full columns of either don't rule out."""
    side = lambda k: sizes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("full").alias(f"f{k}"))
    nx, ny, c = F.col("nx"), F.col("ny"), F.col("c") + F.least("fx", "fy")
    rest = lambda n: F.floor((n * percent + 99) / 100) - 1  # n - p
    most = c + F.greatest(F.least(rest(nx), ny - c), F.least(rest(ny), nx - c))
    near = (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (most * (100 + percent) >= (nx + ny) * percent)
    return pairs.join(side("x"), "x").join(side("y"), "y").where(near)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(parent, child) for a spanning forest of a symmetric boolean matrix."""
    seen, out = np.zeros(len(linked), bool), []
    for start in range(len(linked)):
        if seen[start]:
            continue
        seen[start] = True
        front = np.array([start])
        while len(front):
            reach = linked[front]
            new = np.flatnonzero(reach.any(0) & ~seen)
            seen[new] = True
            out += zip(front[reach[:, new].argmax(0)].tolist(), new.tolist(), strict=True)
            front = new
    return out


def _tile(percent: int):
    """The links within one tile of a cluster, as a spanning forest."""

    def step(table: pa.Table) -> pa.Table:
        sets = table["hs"].combine_chunks()
        flat, size = sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64)
        m = len(size)
        row = np.repeat(np.arange(m), size)
        _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
        keep = times[col] > 1
        row, col = row[keep], col[keep]
        shared = np.zeros((m, m), np.float32)
        _, col = np.unique(col, return_inverse=True)
        width = 2048
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for k in range(0, int(col[-1]) + 1 if len(col) else 0, width):  # some columns at a time bound the memory
            i, j = np.searchsorted(col, [k, k + width])
            block = np.zeros((m, width), np.float32)
            block[row[i:j], col[i:j] - k] = 1
            shared += block @ block.T
        linked = 100.0 * shared >= percent * (size[:, None] + size[None, :] - shared)
        np.fill_diagonal(linked, False)
        side = table["i"].to_numpy()
        if table["a"][0].as_py() != table["b"][0].as_py():
            linked &= side[:, None] != side[None, :]  # pairs of one side belong to its own tile
        node = table["node"].to_numpy()
        pairs = forest(linked)
        return pa.table({"x": pa.array([int(node[p]) for p, _ in pairs], pa.int64()), "y": pa.array([int(node[q]) for _, q in pairs], pa.int64())})

    return step


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs x, y whose whole sets reach the threshold, with the overlap."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("hx"), batch.column("hy")
            shared, keep = [], []
            for k in range(len(batch)):
                x, y = a[k].values.to_numpy(), b[k].values.to_numpy()
                both = np.concatenate([x, y])
                both.sort()
                s = int((both[1:] == both[:-1]).sum())
                shared.append(s)
                keep.append(100 * s >= percent * (len(x) + len(y) - s))
            out = pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(shared, pa.int64())], ["x", "y", "overlap"])
            yield out.filter(pa.array(keep, pa.bool_()))

    both = pairs.select("x", "y").join(sets.select(F.col("node").alias("x"), F.col("hs").alias("hx")), "x").join(sets.select(F.col("node").alias("y"), F.col("hs").alias("hy")), "y")
    return arrow_map(both, step, "x long, y long, overlap long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, cut in _blocks(batch, n):
                yield pa.RecordBatch.from_arrays([pa.array(set_hash(h, cut).view(np.int64)), long_list(h, cut)], ["node", "hs"])

    return arrow_map(docs, step, "node long, hs array<long>")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    from .components import components

    spark = docs.sparkSession
    ship_code(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = materialize(summarize(docs, n))
    rows = sums.where("check is not null")
    counts = sums.where("check is null").groupBy("node").agg(F.sum("n_shingles").alias("n"))
    shared = spark.sparkContext.broadcast(_order(counts))
    # a class is a row of the matrix; node is the hash of its set
    classes = materialize(rows.where("n_shingles > 0 and doc_id is not null").groupBy("node", "check").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n")))
    total = classes.agg(F.sum("n")).collect()[0][0] or 0
    blocks = max(1, -(-total * (100 - percent) // (100 * BLOCK_ENTRIES)))
    leaders = classes.select(F.col("least").alias("doc_id")).distinct()
    lead_docs = semi_by_id(docs, leaders)
    cells = entries(lead_docs, n, percent, shared, blocks).groupBy("block").applyInArrow(_recurring_columns, "h long, node long")
    sizes = classes.select("node", "least", "n")
    cells = materialize(cells.distinct())

    def whole_sets(nodes: DataFrame) -> DataFrame:
        """node, hs of the given nodes; only their documents are read again."""
        ids = materialize(sizes.join(nodes, "node").select(F.col("least").alias("doc_id")).distinct())
        return _sets(semi_by_id(docs, ids), n).join(nodes, "node", "left_semi").dropDuplicates(["node"])

    full = cells.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT)
    placed = materialize(cells.join(full, "h", "left"))
    hot = placed.where("m is not null")
    full_of = hot.groupBy("node").agg(F.count(F.lit(1)).alias("full"))
    sizes = materialize(sizes.join(full_of, "node", "left").withColumn("full", F.coalesce("full", F.lit(0))))

    # full columns: rows that they connect are one cluster, cut into bands by size and into tiles of whole sets
    cluster = components(hot.select(F.col("h").alias("x"), F.col("node").alias("y")))
    band = F.floor(F.ln("n") / math.log(100 / percent) / (1 + 1e-9)).cast("int")  # sizes that may link are in one band or in neighbouring ones
    nodes = materialize(cluster.join(sizes.where("full > 0").select("node", "n"), "node").select("node", "component", "n", band.alias("band")))
    tiles = nodes.groupBy("component", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_ENTRIES)).cast("int").alias("t"))
    tiles = materialize(tiles)
    here = nodes.join(tiles, ["component", "band"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("t")).cast("int"))
    tile = lambda c: F.struct(F.col("band").alias("band"), F.col(c).alias("i")).alias(c)
    within = here.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("t") - 1))).select("component", "node", tile("i"), tile("k"))
    beside = tiles.select("component", "band", F.col("t").alias("u"))
    pairs = [within]
    for step in (1, -1):
        other = here.withColumn("next", F.col("band") + step).join(beside.withColumnRenamed("band", "next"), ["component", "next"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("u") - 1)))
        pairs.append(other.select("component", "node", tile("i"), F.struct(F.col("next").alias("band"), F.col("k").alias("i")).alias("k")))
    tiled = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).select("component", "node", F.xxhash64("i").alias("i"), F.least("i", "k").alias("a"), F.greatest("i", "k").alias("b"))
    links = tiled.join(whole_sets(nodes.select("node")), "node").groupBy("component", "a", "b").applyInArrow(_tile(percent), "x long, y long").distinct()

    # the other columns: accumulated counts, bounds, whole sets of the pairs that are left
    rare = placed.where("m is null").select("h", "node")
    left, right = rare.withColumnRenamed("node", "x"), rare.withColumnRenamed("node", "y")
    pairs = left.join(right, "h").where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    pairs = materialize(_possible(pairs, sizes, percent).select("x", "y"))
    nodes = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    found = verify(pairs, materialize(whole_sets(materialize(nodes))), percent)
    links = materialize(links.unionByName(found.select("x", "y")))
    groups = materialize(components(links))
    # the component's least document
    named = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("node", "check", "component_id")
    linked = rows.where("n_shingles > 0 and doc_id is not null").join(named, ["node", "check"]).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
