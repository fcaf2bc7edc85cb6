"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

1. *Codes.* On a sample of at most FIT_ROWS vectors, PCA followed by iterative
   quantisation (the rotation that brings projections closest to their signs) is
   learned ROTATIONS times from different starts; every vector gets the concatenated
   sign bits, ROTATIONS x dimension of them.
2. *Index.* Every vector is indexed. The index is cut into blocks of at most BLOCK rows;
   in a block each 16-bit substring of the code has its own table: distinct values and,
   for each, the rows that hold it.
3. *Search.* A code within Hamming radius r of the query must be within floor(r / m) of it
   in at least one of the m substrings (pigeonhole), so probing all substring values in
   that smaller radius retrieves every code within r. Those whose whole code is within r
   are reranked by the inner product of the original vectors in double precision.
4. *Radius.* The least that covers TARGET of the true neighbours of sample queries within
   the fitting sample. Neighbours in the whole table are at least as near as those in a
   sample, so the radius errs towards more candidates.

Queries that end up with fewer than k candidates are answered again by comparing them
with every vector, in the same blocks, so each query has min(k, candidates) answers.

Equal vectors are indexed once, with the k+1 smallest ids of each (no query can use
more), so a group of copies never fills a block.

Nulls and edges: vectors that are null, all zero, hold a null or non-finite component, or
have not the table's most frequent dimension take no part, nor do null ids; of rows that repeat an id and a
vector one counts; of an id with several vectors the least one (as an array) is the query, and its best score
counts where it is a candidate; ties go to the smaller id; fewer than k candidates give fewer rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .common import arrow_map, materialize, ranges

#: Vectors that the rotations and the radius are fitted on, chosen by a hash of the id.
FIT_ROWS = 8192
#: Of those, the ones that serve as queries in setting the radius.
FIT_QUERIES = 256
#: Share of true neighbours that the radius must cover on the sample.
TARGET = 0.97
ROTATIONS = 4
BLOCK = 16384
QUERY_BLOCK = 32768
_POP16 = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


# ------------------------------------------------------------------ codes


def fit_rotations(sample: np.ndarray, count: int = ROTATIONS, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projections of shape dimension x (count * dimension)) by PCA and ITQ."""
    mean = sample.mean(0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x.T @ x)
    v = x @ axes.T
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        r, _ = np.linalg.qr(rng.normal(size=(v.shape[1],) * 2))
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (a @ b).T
        out.append(axes.T @ r)
    return mean, np.concatenate(out, 1)


def encode(x: np.ndarray, mean: np.ndarray, proj: np.ndarray) -> np.ndarray:
    """Codes as uint16 substrings, one row a vector; bits beyond the last are zero."""
    bits = (x - mean) @ proj > 0
    pad = -bits.shape[1] % 16
    packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)
    return np.ascontiguousarray(packed).view(np.uint16)


def hamming(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return _POP16[codes ^ code].sum(1, dtype=np.int32)


def fit_radius(sample: np.ndarray, codes: np.ndarray, k: int) -> int:
    """The least radius that covers TARGET of the k nearest of the sample's own queries."""
    q = min(FIT_QUERIES, len(sample))
    scores = sample[:q] @ sample.T
    scores[np.arange(q), np.arange(q)] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return codes.shape[1] * 16
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    dist = np.concatenate([hamming(codes[i], codes[near[i]]) for i in range(q)])
    return int(np.quantile(dist, TARGET, method="higher"))


# ------------------------------------------------------------------ index


class Block:
    """The substring tables of some vectors."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, first = np.unique(codes[order, j], return_index=True)
            self.tables.append((values, np.append(first, len(order)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within radius, found through the substring tables."""
        m = len(self.tables)
        # radius = m * part + rest: either one of rest+1 substrings is within part, or one of the others within part-1
        part, rest = divmod(radius, m)
        hit = np.zeros(len(self.codes), bool)
        for j, (values, first, order) in enumerate(self.tables):
            reach = part if j <= rest else part - 1
            if reach < 0:
                continue
            near = _POP16[values ^ code[j]] <= reach
            hit[order[np.repeat(near, np.diff(first))]] = True
        rows = np.flatnonzero(hit)
        return rows[hamming(code, self.codes[rows]) <= radius]


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((ids, -scores))
    return order[:k]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>), without the vectors that take no part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull()
        & v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
        & F.exists(v, lambda c: c != 0)
    )
    return rows


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query, its own id left out."""
    spark = vectors.sparkSession
    ship_code(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vec_col)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], schema)
    dim = dims[0]["d"]
    rows = rows.where(F.size("v") == dim)
    # copies collapse: of equal vectors no query can use more than the k+1 smallest ids
    distinct = materialize(
        rows.groupBy("v", "id").agg(F.lit(1).alias("one"))
        .groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
        .groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
        .withColumn("pick", F.xxhash64(F.element_at("ids", 1)))
    )
    sample = distinct.orderBy("pick").limit(FIT_ROWS).select("v").toArrow()
    fit = np.asarray(sample["v"].combine_chunks().flatten(), np.float64).reshape(-1, dim)
    mean, proj = fit_rotations(fit)
    codes = encode(fit, mean, proj)
    radius = fit_radius(fit, codes, k)
    everything = codes.shape[1] * 16

    def coded(df: DataFrame, schema: str) -> DataFrame:
        """df (v last) with the vectors' codes, each computed once."""

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column("v").flatten(), np.float64).reshape(-1, dim)
                raw = encode(x, mean, proj)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in raw], pa.binary())], [*batch.schema.names, "code"])

        return materialize(arrow_map(df, step, f"{schema}, v array<double>, code binary"))

    # an id with several vectors: the least of a query's, the best score of a candidate's
    several = not rows.select("id", "v").distinct().groupBy("id").count().where("count > 1").isEmpty()
    asked = usable(queries, id_col, vec_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    index = coded(distinct.select("ids", "pick", "v"), "ids array<long>, pick long")
    asked = coded(asked.select("id", "v"), "id long")
    n_blocks = max(1, -(-index.count() // BLOCK))
    q_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    # every block of queries meets every block of the index once: the stated query set against all rows
    base = index.select(
        F.pmod("pick", F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("part"), F.lit(-1).cast("long").alias("query_id"), "v", "code", "ids"
    )
    ask = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("part"), F.col("id").alias("query_id"), "v", "code",
        F.array().cast("array<long>").alias("ids"),
    )

    def meet(r: int):
        def step(table: pa.Table) -> pa.Table:
            x = np.asarray(table["v"].combine_chunks().flatten(), np.float64).reshape(-1, dim)
            qid = table["query_id"].to_numpy()
            lists = table["ids"].combine_chunks()
            is_q = np.asarray(table["is_query"])
            data = x[~is_q]
            out_q, out_v, out_s = [], [], []
            if len(data) and is_q.any():
                ids_list = lists.filter(pa.array(~is_q))
                flat, offs = ids_list.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids_list.value_lengths().to_numpy())])
                code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint16).reshape(len(x), -1)
                block = Block(code[~is_q])
                for vec, own, c in zip(x[is_q], qid[is_q], code[is_q], strict=True):
                    found = block.within(c, r)
                    score = data[found] @ vec
                    if len(found) > k + 1 and not several:  # of more vectors than that none below the (k+1)-th score can matter
                        keep = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                        found, score = found[keep], score[keep]
                    counts = offs[found + 1] - offs[found]
                    who = flat[ranges(offs[found], counts)]
                    score = np.repeat(score, counts)
                    other = who != own
                    who, score = who[other], score[other]
                    if several:
                        order = np.lexsort((-score, who))
                        first = np.ones(len(order), bool)
                        first[1:] = who[order[1:]] != who[order[:-1]]
                        who, score = who[order[first]], score[order[first]]
                    best = top(score, who, k)
                    out_q.append(np.full(len(best), own))
                    out_v.append(who[best])
                    out_s.append(score[best])
            cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
            return pa.table({"query_id": cat(out_q, np.int64), "vec_id": cat(out_v, np.int64), "score": cat(out_s, np.float64)})

        return step

    def run(ask: DataFrame, r: int) -> DataFrame:
        both = base.withColumn("is_query", F.lit(False)).unionByName(ask.withColumn("is_query", F.lit(True)))
        found = both.groupBy("block", "part").applyInArrow(meet(r), "query_id long, vec_id long, score double")
        if several:
            found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k)
        entry = F.struct((-F.col("score")).alias("m"), "vec_id")
        # k answers of each block are merged in two levels, about the root of the number of blocks at a time
        some = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(math.isqrt(n_blocks - 1) + 1)).alias("level")).agg(best(F.collect_list(entry)).alias("best"))
        return some.groupBy("query_id").agg(best(F.flatten(F.collect_list("best"))).alias("best"))

    first = materialize(run(ask, radius))
    possible = index.select(F.explode("ids").alias("i")).agg(F.count_distinct("i")).collect()[0][0] if several else index.select(F.sum(F.size("ids"))).collect()[0][0]
    enough = first.where(F.size("best") >= min(k, possible - 1))
    missed = asked.select(F.col("id").alias("query_id")).join(enough.select("query_id"), "query_id", "left_anti")
    if missed.isEmpty():
        result = enough
    else:
        rest = ask.join(enough.select("query_id"), "query_id", "left_anti")
        result = enough.unionByName(run(rest.select("block", "part", "query_id", "v", "code", "ids"), everything))
    return result.select("query_id", F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.m")).alias("score")
    )
