"""BM25, dense, fused and memory retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import cosine
from ..operators import leaks
from ..operators import retrieval as r
from .registry import Tables, query

TOK = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


def bm25_sql(idf: str, k1: float) -> str:
    return f"""d AS (SELECT doc_id, {TOK} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY doc_id, term),
q AS (SELECT item_id, unnest(list_distinct({TOK})) AS term FROM benchmark),
i AS (SELECT term, {idf} AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
sc AS (SELECT item_id, doc_id, round(sum(idf * tf * {k1 + 1} / (tf + {k1} * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN i USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank FROM sc)"""


def _postings(t: Tables):
    return r.Postings(t.documents, t.benchmark, "doc_id", "item_id")


INDEX = bm25_sql("ln((n - df + 0.5) / (df + 0.5))", 1.5)


@query(f"WITH {INDEX} SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(t: Tables):
    return _postings(t).best("index", 10)


@query(f"WITH {bm25_sql('ln(1 + (n - df + 0.5) / (df + 0.5))', 1.2)} SELECT item_id, doc_id, coalesce(score, 0) AS score FROM (SELECT item_id, doc_id FROM benchmark, documents) LEFT JOIN sc USING (item_id, doc_id)")
def bm25_memory_scores(t: Tables):
    scores = _postings(t).bm25("memory", every=True)  # the stated queries against all documents
    return scores.select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_sql('ln(1 + (n - df + 0.5) / (df + 0.5))', 1.5)} SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 5 AND score > 0")
def bm25_page_topk(t: Tables):
    return _postings(t).best("page", 5).where("score > 0")


OVERLAP = f"""dw AS (SELECT DISTINCT doc_id, unnest({TOK}) AS term FROM documents), qw AS (SELECT DISTINCT item_id, unnest({TOK}) AS term FROM benchmark),
ov AS (SELECT item_id, doc_id, CAST(count(*) AS DOUBLE) AS score FROM dw JOIN qw USING (term) GROUP BY item_id, doc_id),
oranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank FROM ov)"""


@query(f"WITH {OVERLAP} SELECT item_id, doc_id, score, rank FROM oranked WHERE rank <= 10")
def overlap_topk(t: Tables):
    return _postings(t).best("overlap", 10)


@query(
    f"""WITH {INDEX}, {OVERLAP}, f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM
 (SELECT item_id, doc_id, rank FROM ranked WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank FROM oranked WHERE rank <= 20) GROUP BY item_id, doc_id)
SELECT * FROM (SELECT item_id, doc_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank FROM f) WHERE rank <= 5"""
)
def rrf_fusion(t: Tables):
    """Both lists come from one table of postings."""
    p = _postings(t)
    return r.fuse([p.best(kind, 20) for kind in ("index", "overlap")], "item_id", "doc_id", 5)


@query(
    f"""WITH {INDEX}, truth AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT item_id, max(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS hit FROM truth LEFT JOIN ranked USING (item_id, doc_id) GROUP BY item_id)
SELECT count(*) AS queries, CAST(sum(hit) AS BIGINT) AS found, round(avg(hit), 6) AS recall FROM h"""
)
def recall_at_k(t: Tables):
    ranked = _postings(t).best("index", 10)
    truth = leaks.leak_check(t.documents, t.benchmark.select("item_id", F.col("text").alias("needle"), F.lit(False).alias("words"))).select("item_id", "doc_id")
    return r.recall(ranked, truth, "item_id", "doc_id")


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS score FROM v, q)
SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank FROM s) WHERE rank <= 5"""
)
def dense_topk(t: Tables):
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return r.nearest(t.embeddings, q, "vec_id", "query_id", 5)


@query("SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i")
def mean_pool_by_label(t: Tables):
    rows = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(
    """WITH x AS (SELECT user_id, event_id, value, (SELECT max(epoch_us(ts)) FROM events) AS now, epoch_us(ts) AS u, len(props) AS rel FROM events),
p AS (SELECT user_id, event_id, pow(0.5, (now - u) / 86400e6 / 30.0) AS a, value AS b, CAST(rel AS DOUBLE) AS c FROM x),
s AS (SELECT user_id, event_id, a, b, c, min(a) OVER w AS a0, max(a) OVER w AS a1, min(b) OVER w AS b0, max(b) OVER w AS b1, min(c) OVER w AS c0, max(c) OVER w AS c1 FROM p WINDOW w AS (PARTITION BY user_id))
SELECT user_id, event_id, round(CASE WHEN a1 - a0 <= 1e-12 THEN 0 ELSE (a - a0) / (a1 - a0) END + CASE WHEN b1 - b0 <= 1e-12 THEN 0 ELSE (b - b0) / (b1 - b0) END + CASE WHEN c1 - c0 <= 1e-12 THEN 0 ELSE (c - c0) / (c1 - c0) END, 5) AS score FROM s"""
)
def recency_importance_rank(t: Tables):
    now = t.events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("now"))
    e = t.events.withColumn("u", F.unix_micros(F.col("ts").cast("timestamp"))).crossJoin(F.broadcast(now))
    age = (F.col("now") - F.col("u")) / F.lit(86400e6)
    return r.memory_rank(e, "user_id", "event_id", age, F.col("value"), F.char_length("props")).select("user_id", "event_id", F.round("score", 5).alias("score"))


@query(
    """WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: avg_i[i]) AS m FROM (SELECT label, list(x ORDER BY i) AS avg_i FROM
 (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label))
SELECT vec_id, e.label AS label, round(list_dot_product(CAST(embedding AS DOUBLE[]), m) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(m, m))), 5) AS likeness
FROM embeddings e JOIN c ON e.label = c.label"""
)
def centroid_likeness(t: Tables):
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    return t.embeddings.join(F.broadcast(mean), "label").select("vec_id", "label", F.round(cosine("embedding", "m"), 5).alias("likeness"))
