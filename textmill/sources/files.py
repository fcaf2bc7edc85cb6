"""Readers: JSON lines in three strictnesses, framed text, folders, tables in Markdown, token shards."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.python_text import decode_text, python_udf, readable, sniff
from ..session import ship_code


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def json_lines(spark: SparkSession, path: str, schema: str, policy: str = "skip") -> DataFrame:
    """Rows of JSON lines; blank lines are skipped and a missing file is an empty table.

    policy for bad lines: 'skip', 'report' (kept, with the line in _corrupt_record), 'fail'.
    """
    fields = schema if policy != "report" else f"{schema}, _corrupt_record string"
    try:
        if policy == "fail":
            return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        # by way of text lines: Spark can't filter a JSON scan by its corrupt records alone
        lines = spark.read.text(path).where(F.trim("value") != "")
        parsed = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
        return parsed if policy == "report" else parsed.where("_corrupt_record is null").drop("_corrupt_record")
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], StructType.fromDDL(fields))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value; lines end at line feeds alone. Files are read whole, so they must be small ones."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n", -1).alias("l"))
    rows = whole.select("file", F.posexplode("l").alias("p", "value"))
    return rows.where("value <> ''").select("file", (F.col("p") + 1).alias("line"), "value")


def merged_json(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """Several files in order; of rows with one key the last line of the last file wins."""
    parts = None
    for n, path in enumerate(paths):
        lines = numbered_lines(spark, path).select(F.lit(n).alias("_f"), F.col("line").alias("_l"), F.from_json("value", schema).alias("r"))
        parts = lines if parts is None else parts.unionByName(lines)
    best = parts.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", F.struct("_f", "_l")).alias("r"))
    return best.select("r.*")


def framed(text: DataFrame, frame: str, column: str = "value") -> DataFrame:
    """pos (from 0), text of the non-blank documents of texts that a regular expression separates."""
    parts = text.select(F.posexplode(F.filter(F.split(column, frame, -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")).alias("pos", "text"))
    return parts


def delimited_stories(spark: SparkSession, path: str, mark: str = "<|endoftext|>") -> DataFrame:
    """Stories of a text file that a mark separates; split by the reader, so large files are read in parallel."""
    return spark.read.option("lineSep", mark).text(path).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select(F.trim("value").alias("text"))


def piped(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "|").option("quote", "").csv(path)


#: Folders that are never read, and suffixes that are no text.
SKIPPED_FOLDERS = r"(^|/)(\.git|node_modules|__pycache__|\.venv)(/|$)"
BINARY_SUFFIXES = r"\.(png|jpe?g|gif|ico|zip|gz|so|dll|exe|bin|pyc|woff2?|mp[34])$"
TOO_LARGE = 256 << 20


def folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, reason (null: accepted), encoding, text of every file below a folder."""
    ship_code(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    early = F.when(F.col("path").rlike(SKIPPED_FOLDERS), "folder").when(F.lower("path").rlike(BINARY_SUFFIXES), "suffix").when(F.col("length") > TOO_LARGE, "too large")  # Spark lists no empty files
    rows = files.select("path", F.col("length").alias("size"), early.alias("early"), "content")
    body = F.when(F.col("early").isNull(), F.col("content"))
    seen = rows.withColumn("kind", python_udf(sniff, "string")(body)).withColumn("d", python_udf(decode_text, "text string, encoding string, reason string")(body))
    late = F.when(~F.col("kind").isin("text", "html"), F.col("kind")).when(F.col("d.reason") != "ok", F.col("d.reason")).when(~python_udf(readable, "boolean")(F.col("d.text")), "unreadable")
    seen = seen.withColumn("reason", F.coalesce("early", late))
    return seen.select("path", "size", "reason", F.col("d.encoding").alias("encoding"), F.when(F.col("reason").isNull(), F.col("d.text")).alias("text"))


def search(files: DataFrame, needle: str, ignore_case: bool = False, most: int = 200) -> DataFrame:
    """path, line, value of lines with a literal text, at most `most` (the feature's own limit)."""
    lines = files.where("text is not null").select("path", F.posexplode(F.split("text", "\n", -1)).alias("p", "value"))
    hit = F.lower("value").contains(needle.lower()) if ignore_case else F.col("value").contains(needle)
    return lines.where(hit).select("path", (F.col("p") + 1).alias("line"), "value").orderBy("path", "line").limit(most)


def _tables(text: str) -> list[dict]:
    rows, header = [], None
    for line in text.split("\n"):
        cells = [c.strip() for c in line.strip().strip("|").split("|")] if line.strip().startswith("|") else None
        if cells is None:
            header = None
        elif header is None:
            header = cells
        elif not all(re.fullmatch(r":?-+:?", c) for c in cells):
            rows.append({"task": cells[0], "cells": [{"column": h, "value": v} for h, v in zip(header[1:], cells[1:], strict=False)]})
    return rows


def markdown_cells(spark: SparkSession, path: str) -> DataFrame:
    """file, task, column, real, twin of Markdown tables with cells 'real / twin'; each table has its own header."""
    ship_code(spark)
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = whole.select("file", F.explode(python_udf(_tables, "array<struct<task string, cells array<struct<column string, value string>>>>")("value")).alias("r"))
    cells = rows.select("file", "r.task", F.explode("r.cells").alias("c"))
    parts = F.split("c.value", r"\s*/\s*", 2)
    return cells.select("file", "task", F.col("c.column").alias("column"), F.get(parts, 0).alias("real"), F.get(parts, 1).alias("twin"))


def token_shards(spark: SparkSession, path: str) -> DataFrame:
    """file, ids of shards of little-endian 16-bit tokens."""
    import numpy as np

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(ids, pa.list_(pa.int32()))], ["file", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(step, "file string, ids array<int>")


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, status (ok, missing, size, digest, extra) of a folder against name, size, sha256."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("got_size"), F.sha2("content", 256).alias("got"))
    both = manifest.join(have, "name", "full_outer")
    status = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("size") != F.col("got_size"), "size").when(F.col("sha256") != F.col("got"), "digest").otherwise("ok")
    return both.select("name", status.alias("status"))


def key_text(spark: SparkSession, path: str) -> DataFrame:
    """key, text of lines 'key text …'; a line of one word has an empty text."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def git_stage(spark: SparkSession, path: str) -> DataFrame:
    """mode, object, stage, path of a `git ls-files --stage` listing; only regular files of stage 0 are content."""
    lines = spark.read.text(path).where("value <> ''")
    head = F.split(F.substring_index("value", "\t", 1), " ")
    return lines.select(
        F.get(head, F.lit(0)).alias("mode"), F.get(head, F.lit(1)).alias("object"), F.get(head, F.lit(2)).cast("int").alias("stage"), F.regexp_extract("value", "\t(.*)$", 1).alias("path"),
        (F.get(head, F.lit(0)).isin("100644", "100755") & (F.get(head, F.lit(2)) == "0")).alias("content"),
    )


def keyed_json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """key and the fields of a JSON object of objects; a missing file is an empty table."""
    schema = StructType.fromDDL(f"key string, {fields}")
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema)
    return whole.select(F.explode(F.from_json("value", f"map<string, struct<{fields}>>")).alias("key", "v")).select("key", "v.*")


def answer_set(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each problem of an answer folder: its stage and reason (extract.json), its tests (tests.json), its cells (kernels.md)."""
    extract = keyed_json(spark, f"{folder}/extract.json", "stage string, why string, name string")
    tests = keyed_json(spark, f"{folder}/tests.json", "overall string, name string").select("key", "overall", F.col("name").alias("test_name"))
    rows = extract.join(tests, "key", "full_outer").withColumn("name", F.coalesce("test_name", "name")).drop("test_name")
    try:
        cells = markdown_cells(spark, f"{folder}/kernels.md").groupBy(F.col("task").alias("name")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "real")))).alias("cells"))
    except AnalysisException as e:
        if not _missing(e):
            raise
        cells = spark.createDataFrame([], "name string, cells map<string, string>")
    return rows.join(cells, "name", "left")
