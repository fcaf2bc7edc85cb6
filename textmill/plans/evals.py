"""Evaluation aggregates and statistics over events (users as problems, event types as judges) and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import pass_at_k as passed
from ..functions.numbers import safe_ratio, wilson
from ..functions.text import alnum_words
from ..operators import evals as e
from ..operators.ordered import median
from .registry import Tables, query

STAGES = {"long_enough": "n_chars >= 300", "known_language": "lang IN ('en', 'de', 'fr')", "labelled": "quality IS NOT NULL", "good": "quality = 1", "clean": "toxic = 0"}


@query(
    """SELECT source, count(*) AS replies, count(*) FILTER (n_chars >= 300) AS long_enough, count(*) FILTER (n_chars >= 300 AND lang IN ('en', 'de', 'fr')) AS known_language,
count(*) FILTER (n_chars >= 300 AND lang IN ('en', 'de', 'fr') AND quality IS NOT NULL) AS labelled, count(*) FILTER (n_chars >= 300 AND lang IN ('en', 'de', 'fr') AND quality = 1) AS good,
count(*) FILTER (n_chars >= 300 AND lang IN ('en', 'de', 'fr') AND quality = 1 AND toxic = 0) AS clean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""
)
def funnel_counts(t: Tables):
    rows = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id", "left")
    return e.funnel(rows, ["source"], {k: F.expr(v) for k, v in STAGES.items()})


@query(
    "WITH l AS (SELECT user_id, count(DISTINCT event_type) AS level FROM events GROUP BY 1) SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (level >= k) AS n FROM l, range(1, 8) r(k) GROUP BY k"
)
def level_curve(t: Tables):
    levels = t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("level"))
    return e.at_least_curve(levels, [], "level", 7)


VERDICT = "CASE WHEN value >= (SELECT median(value) FROM events) THEN 'verified' ELSE 'refuted' END"


@query(
    f"""WITH c AS (SELECT DISTINCT user_id, event_type, {VERDICT} AS v FROM events)
SELECT a.event_type AS judge_a, b.event_type AS judge_b, count(*) AS n FROM c a JOIN c b ON a.user_id = b.user_id WHERE a.v = 'verified' AND b.v = 'refuted' GROUP BY 1, 2"""
)
def contradiction_scan(t: Tables):
    mid = median(t.events, "value", "mid")
    cells = t.events.crossJoin(F.broadcast(mid)).select("user_id", "event_type", F.when(F.col("value") >= F.col("mid"), "verified").otherwise("refuted").alias("v"))
    return e.contradictions(cells, ["user_id"], "event_type", "v")


SAMPLES = "s AS (SELECT user_id, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (event_type = 'purchase') AS INTEGER) AS c FROM events GROUP BY 1)"
PASS = "CASE WHEN {k} > n THEN NULL WHEN c = 0 THEN 0 WHEN n - c < {k} THEN 1 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k} / i)) END"


def _samples(t: Tables):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col("event_type") == "purchase").cast("int").alias("c"))


@query(f"WITH {SAMPLES} SELECT user_id, n, c, round({PASS.format(k=1)}, 6) AS pass_1, round({PASS.format(k=3)}, 6) AS pass_3 FROM s")
def pass_at_k(t: Tables):
    s = _samples(t)
    return s.select("user_id", "n", "c", F.round(passed("n", "c", 1), 6).alias("pass_1"), F.round(passed("n", "c", 3), 6).alias("pass_3"))


@query(f"WITH {SAMPLES} SELECT CAST(k AS INTEGER) AS k, round(avg({PASS.format(k='k')}), 6) AS coverage, count(*) AS problems FROM s, range(1, 9) r(k) WHERE k <= n GROUP BY k")
def coverage_curve(t: Tables):
    return e.coverage(_samples(t), "n", "c", 8).select("k", F.round("coverage", 6).alias("coverage"), "problems")


Z = "1.959963984540054"


@query(
    f"""WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS s FROM documents JOIN labels USING (doc_id) GROUP BY source), x AS (SELECT source, n, s, s / n AS p FROM g)
SELECT source, n, s, round(greatest((p + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) - {Z} / (1 + {Z}*{Z}/n) * sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n)), 0), 6) AS low,
round(least((p + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) + {Z} / (1 + {Z}*{Z}/n) * sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n)), 1), 6) AS high FROM x"""
)
def wilson_interval(t: Tables):
    g = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("s"))
    w = wilson("s", "n")
    return g.select("source", "n", "s", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query(
    """WITH u AS (SELECT user_id, bool_or(event_type = 'click') AS a, bool_or(event_type = 'purchase') AS b FROM events GROUP BY 1)
SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM u"""
)
def mcnemar_counts(t: Tables):
    u = t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("a"), F.bool_or(F.col("event_type") == "purchase").alias("b"))
    return u.agg(F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("a and not b")).alias("only_a"), F.count_if(F.expr("b and not a")).alias("only_b"), F.count_if(F.expr("not a and not b")).alias("neither"))


SCORED = "x AS (SELECT doc_id, (n_chars % 1000) / 1000.0 AS s, quality AS y FROM documents JOIN labels USING (doc_id))"


def _scored(t: Tables):
    return t.documents.select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("s")).join(t.labels.select("doc_id", F.col("quality").alias("y")), "doc_id")


@query(f"WITH {SCORED} SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 6) AS auroc FROM x a, x b WHERE a.y = 1 AND b.y = 0")
def auroc(t: Tables):
    return e.auroc(_scored(t), "s", "y").select(F.round("auroc", 6).alias("auroc"))


@query(
    f"""WITH {SCORED}, k AS (SELECT *, row_number() OVER (ORDER BY s, doc_id) - 1 AS i, count(*) OVER () AS n FROM x), b AS (SELECT *, floor(((i + 1) * 10 - 1) / n) AS b FROM k),
g AS (SELECT b, any_value(n) AS n, count(*) AS m, avg(s) AS s, avg(y) AS y, sum((s - y) * (s - y)) AS q FROM b GROUP BY b)
SELECT round(sum(m / n * abs(s - y)), 6) AS ece, round(sum(q / n), 6) AS brier FROM g"""
)
def calibration(t: Tables):
    return e.calibration_error(_scored(t), "s", "y", "doc_id").select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@query(
    """WITH c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn
FROM (SELECT n_chars >= 1000 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id)))
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + fp) / (tp + fp + fn + tn), 6) AS yes_ratio FROM c"""
)
def confusion_report(t: Tables):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return e.confusion(rows, F.col("n_chars") >= 1000, F.col("quality") == 1)


@query(
    """WITH p AS (SELECT p.conv_id, p.turn, regexp_extract_all(lower(p.text), '[a-z0-9]+') AS a, regexp_extract_all(lower(g.text), '[a-z0-9]+') AS b FROM conversations p JOIN conversations g ON p.conv_id = g.conv_id AND p.turn + 1 = g.turn),
w AS (SELECT conv_id, turn, w, sum(x) AS x, sum(y) AS y FROM (SELECT conv_id, turn, unnest(a) AS w, 1 AS x, 0 AS y FROM p UNION ALL SELECT conv_id, turn, unnest(b), 0, 1 FROM p) GROUP BY 1, 2, 3),
s AS (SELECT conv_id, turn, sum(least(x, y)) AS s FROM w GROUP BY 1, 2)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE 0.0 END ELSE 2 * coalesce(s, 0) / (len(a) + len(b)) END, 6) AS f1 FROM p LEFT JOIN s USING (conv_id, turn)"""
)
def token_f1(t: Tables):
    c = t.conversations
    p = c.select("conv_id", "turn", F.col("text").alias("a")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])
    return e.token_f1(p, ["conv_id", "turn"], alnum_words("a"), alnum_words("b")).select("conv_id", "turn", F.round("f1", 6).alias("f1"))


@query(
    """WITH c AS (SELECT event_type, value, count(*) AS m FROM events GROUP BY 1, 2), u AS (SELECT event_type, value, m, sum(m) OVER (PARTITION BY event_type ORDER BY value) / sum(m) OVER (PARTITION BY event_type) AS hi, m / sum(m) OVER (PARTITION BY event_type) AS w FROM c)
SELECT event_type, round(sum(value * (pow(hi, 4) - pow(hi - w, 4))), 4) AS expected FROM u GROUP BY 1"""
)
def expected_best_of_n(t: Tables):
    return e.expected_best(t.events, ["event_type"], "value", 4).select("event_type", F.round("expected", 4).alias("expected"))


@query(
    """WITH a AS (SELECT value FROM events WHERE event_type = 'click'), n AS (SELECT value FROM events WHERE event_type = 'purchase')
SELECT round(avg(CASE WHEN a.value > n.value THEN 1.0 WHEN a.value = n.value THEN 0.5 ELSE 0.0 END), 6) AS probability FROM a, n"""
)
def prob_outperform(t: Tables):
    return e.outperforms(t.events, "event_type", "click", "purchase", "value").select(F.round("probability", 6).alias("probability"))


@query(
    """WITH c AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2), f AS (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n FROM c WHERE v < 50)
SELECT event_type, count(*) FILTER (n = 1) AS sole, count(*) FILTER (n > 1) AS shared FROM f GROUP BY 1"""
)
def blocker_counts(t: Tables):
    cells = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return e.blockers(cells, "user_id", "event_type", F.col("v") >= 50)


@query(
    """SELECT source, lang, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 6) AS good, round(count(*) FILTER (toxic = 1) / nullif(count(toxic), 0), 6) AS toxic
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source, lang)"""
)
def share_rollup(t: Tables):
    rows = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left")
    return rows.rollup("source", "lang").agg(
        F.round(safe_ratio(F.count_if(F.col("quality") == 1), F.count("quality")), 6).alias("good"), F.round(safe_ratio(F.count_if(F.col("toxic") == 1), F.count("toxic")), 6).alias("toxic")
    )
