"""Exclusion policies, fill-in-the-middle rows, dates and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import stem_s
from ..operators import fim, policy
from .registry import Tables, query

ALIASES = "list_sort(list_distinct(list_concat(" + ", ".join(
    f"list_transform(regexp_extract_all(replace(p_name, ' ', '_') || '_' || p_partkey || ' MBPP-' || p_size, '(?i)(?:^|[^A-Za-z0-9]){name}[_-]?([0-9]{{1,9}})(?:$|[^0-9A-Za-z])', 1), lambda x: CAST(x AS BIGINT) + {base})"
    for name, base in policy.FAMILIES.items()
) + ")))"


@query(f"SELECT p_partkey, array_to_string({ALIASES}, ',') AS ids FROM part")
def alias_ids(t: Tables):
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey"), F.lit(" MBPP-"), F.col("p_size"))
    return t.part.select("p_partkey", F.array_join(F.transform(policy.aliases(text), lambda x: x.cast("string")), ",").alias("ids"))


@query(
    """SELECT doc_id, array_to_string(list_sort(list(policy)), ',') AS policies FROM (SELECT doc_id, 'toxic' AS policy FROM labels WHERE toxic = 1 UNION SELECT doc_id, 'poor' FROM labels WHERE quality = 0
UNION SELECT doc_id, 'short' FROM documents WHERE n_chars < 200) GROUP BY doc_id"""
)
def exclusion_union(t: Tables):
    sets = {"toxic": t.labels.where("toxic = 1"), "poor": t.labels.where("quality = 0"), "short": t.documents.where("n_chars < 200")}
    return policy.union(sets, "doc_id").select("doc_id", F.array_join("policies", ",").alias("policies"))


@query(
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'listed but not excluded' ELSE 'excluded but not listed' END AS problem
FROM (SELECT doc_id FROM labels WHERE toxic = 1) a FULL JOIN (SELECT doc_id FROM labels WHERE quality = 0) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL"""
)
def policy_consistency(t: Tables):
    return policy.inconsistent(t.labels.where("toxic = 1"), t.labels.where("quality = 0"), "doc_id")


@query("SELECT p_partkey FROM part WHERE p_size <= 20 ORDER BY sha256('17:' || p_partkey) LIMIT 40")
def panel_draw(t: Tables):
    rows = t.part.withColumn("removes", F.sequence(F.lit(1), F.col("p_size")))
    return policy.panel(rows, "p_partkey", "removes", 40, 20).select("p_partkey")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE i % greatest(n // 50, 1) = 0")
def systematic_control(t: Tables):
    return policy.systematic(t.documents.select("doc_id"), "doc_id", 50)


U = "CAST(('0x' || substr(sha256(sha256('17' || chr(0) || '{k}' || chr(0) || doc_id)), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query(
    f"""WITH u AS (SELECT doc_id, text, length(text) AS n, CAST(floor({U.format(k="first")} * (length(text) + 1)) AS INTEGER) AS x, CAST(floor({U.format(k="second")} * (length(text) + 1)) AS INTEGER) AS y, {U.format(k="use")} AS use, {U.format(k="layout")} AS lay FROM documents),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN use >= 0.5 THEN 'plain' WHEN lay < 0.5 THEN 'spm' ELSE 'psm' END AS layout FROM u),
p AS (SELECT doc_id, layout, text, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c)
SELECT doc_id, layout, sha256(CASE layout WHEN 'plain' THEN text WHEN 'psm' THEN '{fim.PREFIX}' || pre || '{fim.SUFFIX}' || suf || '{fim.MIDDLE}' || mid ELSE '{fim.SUFFIX}' || suf || '{fim.PREFIX}' || pre || '{fim.MIDDLE}' || mid END) AS digest FROM p"""
)
def fim_rows(t: Tables):
    return fim.rows(t.documents).select("doc_id", "layout", F.sha2("text", 256).alias("digest"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS utc, CASE WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN 'ambiguous' END AS reason,
CASE WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed, strftime(DATE '1899-12-30' + CAST(20000 + o_orderkey % 20000 AS INTEGER), '%Y-%m-%d') AS serial FROM orders"""
)
def date_functions(t: Tables):
    text = F.date_format("o_orderdate", "d/M/yyyy")
    p = dates.parse_date(text)
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return t.orders.select("o_orderkey", dates.utc_text("o_orderdate").alias("utc"), p["reason"].alias("reason"), day(p["date"]).alias("parsed"), day(dates.serial_date(20000 + F.col("o_orderkey") % 20000)).alias("serial"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS wrong FROM lineitem")
def number_conventions(t: Tables):
    english = F.format_number("l_extendedprice", 2)
    return t.lineitem.select("l_orderkey", "l_linenumber", dates.parse_number(english).alias("price"), dates.parse_number(F.concat(F.lit("x"), english), "continental").alias("wrong"))


@query(
    r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT w, CASE WHEN regexp_matches(w, 'ies$') AND NOT regexp_matches(w, '[ea]ies$') THEN left(w, length(w) - 3) || 'y' WHEN regexp_matches(w, 'es$') AND NOT regexp_matches(w, '[aeo]es$') THEN left(w, length(w) - 1)
WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '[us]s$') THEN left(w, length(w) - 1) ELSE w END AS stem FROM w"""
)
def stems(t: Tables):
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return words.select("w", stem_s(F.col("w")).alias("stem"))
