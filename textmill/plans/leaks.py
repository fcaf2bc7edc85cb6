"""Held-out items in training rows and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import programs
from ..functions.hashing import below, sha256
from ..operators import leaks
from .registry import Tables, query

ARTICLE, TITLE, HEAD, STEM = r"(?s)<article>(.*)</article>", r"(?s)<title>(.*?)</title>", r"(?s)^(.*?</title>)", "/([a-z]{2}/[0-9]+)"


@query(
    f"""WITH k AS (SELECT page_id, substr(sha256(url), 1, 4) < '4000' AS held, nullif(regexp_extract(url, '{STEM}', 1), '') AS stem, sha256(nullif(regexp_extract(html, '{ARTICLE}', 1), '')) AS program,
 sha256(nullif(regexp_extract(html, '{HEAD}', 1), '')) AS spec, sha256(nullif(regexp_extract(html, '{TITLE}', 1), '')) AS gateless FROM pages), h AS (SELECT * FROM k WHERE held)
SELECT page_id, reason FROM (SELECT page_id, CASE WHEN stem IN (SELECT stem FROM h WHERE stem IS NOT NULL) THEN 'stem' WHEN program IN (SELECT program FROM h WHERE program IS NOT NULL) OR spec IN (SELECT spec FROM h WHERE spec IS NOT NULL) THEN 'text'
 WHEN gateless IN (SELECT gateless FROM h WHERE gateless IS NOT NULL) THEN 'spec-without-gate' END AS reason FROM k WHERE NOT held) WHERE reason IS NOT NULL"""
)
def row_leaks(t: Tables):
    """Pages of the training side that a held-out page answers: same number in its language, same article or head, or same title once the head's other lines are left out."""
    part = lambda pattern: sha256(F.nullif(F.regexp_extract("html", pattern, 1), F.lit("")))
    rows = t.pages.select(
        "page_id", below(sha256("url"), 0.25, 4).alias("held"), F.nullif(F.regexp_extract("url", STEM, 1), F.lit("")).alias("stem"), part(ARTICLE).alias("program"), part(HEAD).alias("spec"), part(TITLE).alias("gateless")
    )
    keys = {"stem": [("stem", F.col("stem"))], "text": [("program", F.col("program")), ("spec", F.col("spec"))], "spec-without-gate": [("gateless", F.col("gateless"))]}
    return leaks.row_leaks(rows.where("not held"), rows.where("held"), "page_id", keys)


@query(
    """WITH s AS (SELECT page_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS s FROM pages)
SELECT page_id, sha256(regexp_replace(s, '^var [a-z]+="([^"]*)";track\\(([0-9]+)\\);$', 'var %1 = "\\1" ; track ( \\2 ) ;')) AS program_key FROM s"""
)
def script_keys(t: Tables):
    """The key of each page's script with the names that it binds erased."""
    return t.pages.select("page_id", programs.program_key(F.regexp_extract("html", "(?s)<script>(.*?)</script>", 1)).alias("program_key"))


@query(
    r"""WITH n AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{9,}')) AS needle FROM benchmark), w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS needle FROM documents),
c AS (SELECT doc_id, needle, count(*) AS hits FROM w GROUP BY ALL), b AS (SELECT doc_id, item_id, 'text' AS kind, sha256(b.text) AS needle FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '')
SELECT doc_id, item_id, 'name' AS kind, sha256(needle) AS needle FROM c JOIN n USING (needle) UNION ALL SELECT * FROM b"""
)
def leak_check(t: Tables):
    """Held-out items in documents: their long words, as words, and their whole texts, anywhere; all needles in one pass."""
    b = t.benchmark
    names = b.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]{9,})"), F.lit(1)))).alias("needle")).select("item_id", F.lit("name").alias("kind"), "needle", F.lit(True).alias("words"))
    texts = b.select("item_id", F.lit("text").alias("kind"), F.col("text").alias("needle"), F.lit(False).alias("words"))
    return leaks.leak_check(t.documents, names.unionByName(texts)).select("doc_id", "item_id", "kind", sha256("needle").alias("needle"))
