"""Extraction and fingerprints whose exact semantics are Python's; no SQL, tested against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import python_text as p
from ..operators import dedup, leakage, retrieval, transcripts
from ..session import ship_code, spread
from .registry import Tables, query


@query()
def html_to_text(t: Tables):
    ship_code(t.spark)
    return spread(t.pages.select("page_id", "html")).select("page_id", p.page_text("html").alias("text"))


@query()
def winnow_fingerprint_overlap(t: Tables):
    """fingerprints, shared: those of the validation side, and those of them that the training side has too."""
    return leakage.content_overlap(dedup.hash_split_rows(t.documents))


@query()
def sentence_windows(t: Tables):
    """doc_id, window, sentences, chars: non-overlapping windows of six sentences."""
    ship_code(t.spark)
    sizes = p.python_udf(p.window_sizes, "array<array<bigint>>")("text")
    rows = spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(sizes).alias("window", "w"))
    return rows.select("doc_id", F.col("window").cast("long").alias("window"), F.col("w")[0].alias("sentences"), F.col("w")[1].alias("chars"))


@query()
def text_chunks(t: Tables):
    ship_code(t.spark)
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(p.python_udf(p.chunks, "array<string>")("text")).alias("pos", "chunk"))


@query()
def word_error_rate(t: Tables):
    """One row: word edits from each benchmark text to its folded form, over all words."""
    ship_code(t.spark)
    folded = p.python_udf(p.ascii_fold, "string")("text")
    rows = t.benchmark.select(p.python_udf(p.word_edits, "int")("text", folded).alias("e"), F.size(F.split(F.trim("text"), r"\s+")).alias("n"))
    return rows.agg(F.sum("e").alias("edits"), F.sum("n").alias("words"), F.round(F.sum("e") / F.sum("n"), 6).alias("wer"))


@query()
def arithmetic_programs(t: Tables):
    ship_code(t.spark)
    text = F.concat_ws("", F.lit("round("), F.col("p_size"), F.lit(" / 7, 2) + max("), F.col("p_size") % 5, F.lit(", 3) // 2"))
    return t.part.select("p_partkey", p.python_udf(p.calculate, "string")(text).alias("value"))


@query()
def cited_passages(t: Tables):
    """The five windows of six sentences that answer each question best: BM25 over words of any script, all windows as one index."""
    ship_code(t.spark)
    words = p.python_udf(lambda text: [p.tokens_any(x) for x in p.passages(text)], "array<array<string>>")("text")
    windows = spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(words).alias("part", "w"))
    windows = windows.select(F.concat_ws(":", "doc_id", F.col("part") + 1).alias("passage"), "w")
    asked = lambda text: p.python_udf(p.tokens_any, "array<string>")(F.col(text))
    return retrieval.Postings(windows, t.benchmark, "passage", "item_id", asked, F.col("w")).best("index", 5)


@query()
def transcript_error_rates(t: Tables):
    """Per role, the words of each turn that the same turn of the next conversation gets wrong, both in lower case and without signs; turns without one are missing."""
    c = t.conversations.select("conv_id", "turn", "role", "text")
    said = c.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("text").alias("said"))
    plain = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}\s]", "")
    return transcripts.error_rate(c.join(said, ["conv_id", "turn"], "left"), "text", "said", plain, by=["role"])
