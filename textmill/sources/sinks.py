"""Writers: JSON lines, framed corpora, split outputs, token shards. None overwrites unless told to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..operators.ordered import sum_before


def write_json_lines(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """JSON lines in key order; parts are ranges of the order, so their names sort as their rows."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def write_corpus(df: DataFrame, path: str, name: str = "path", text: str = "text", mode: str = "errorifexists") -> None:
    """Documents behind '# file: name' lines, in order of name."""
    row: Column = F.concat(F.lit("\n\n# file: "), F.col(name), F.lit("\n"), F.col(text))
    df.repartitionByRange(name).sortWithinPartitions(name).select(row.alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def write_split(df: DataFrame, path: str, column: str = "split", mode: str = "errorifexists") -> None:
    """One folder a side. Spark commits the job as a whole: readers see all of it or none."""
    df.write.mode(mode).partitionBy(column).parquet(path)


def shard_bytes(df: DataFrame, key: str, ids: str, shard_tokens: int) -> DataFrame:
    """shard, first, n_tokens, content: documents in key order packed whole into shards of 16-bit tokens.

    Shards are cut where the running token count passes a multiple of shard_tokens (the count
    comes from sums over key ranges, then within each), so no document is split and every
    shard can be written by a task of its own.
    """
    session.ship_code(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), F.col(ids).alias("ids")).withColumn("n", F.size("ids").cast("long"))
    placed = sum_before(rows, "k", F.col("n"), ["k"]).withColumn("shard", F.floor(F.col("before") / shard_tokens)).drop("before")

    def pack(table: pa.Table) -> pa.Table:
        import numpy as np

        order = np.argsort(table["k"].to_numpy(), kind="stable")
        lists = table["ids"].to_pylist()
        data = np.concatenate([np.asarray(lists[i], "<u2") for i in order]) if len(order) else np.zeros(0, "<u2")
        return pa.table({"shard": table["shard"][:1], "first": pa.array([int(table["k"].to_numpy()[order[0]])]), "n_tokens": pa.array([len(data)]), "content": pa.array([data.tobytes()], pa.binary())})

    return placed.select("shard", "k", "ids").groupBy("shard").applyInArrow(pack, "shard long, first long, n_tokens long, content binary")


def write_shards(shards: DataFrame, folder: str) -> None:
    """Each shard's bytes as a file of its own, through Hadoop's file system, so any store will do."""
    conf_path = folder.rstrip("/")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist(), strict=True):
                store, base = fs.FileSystem.from_uri(conf_path) if "://" in conf_path else (fs.LocalFileSystem(), conf_path)
                store.create_dir(base, recursive=True)
                with store.open_output_stream(f"{base}/shard-{shard:06d}.bin") as out:
                    out.write(content)
            yield batch.select(["shard"])

    shards.select("shard", "content").mapInArrow(step, "shard long").count()


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A report of at most `most` rows as a Markdown table; an error if it has more."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", r"\|").replace("\n", " ")
    lines = ["| " + " | ".join(report.columns) + " |", "|" + "-|" * len(report.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def built_once(spark, path: str, fingerprint: str, build) -> DataFrame:
    """The table at path, built anew unless it was built with this input fingerprint (see functions.spans.stage_fingerprint).

    The fingerprint is written after the table, so a stage that broke off is built again.
    """
    try:
        if spark.read.text(f"{path}.fingerprint").first()["value"] == fingerprint:
            return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.fingerprint")
    return spark.read.parquet(path)
