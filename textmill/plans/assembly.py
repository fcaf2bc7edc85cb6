"""Training rows out of graded samples, and the reports and checks on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans
from ..functions.hashing import sha256
from ..functions.text import alnum_words, word_tokens
from ..operators import assembly as a
from ..operators import dedup, leakage, retrieval
from ..operators import review as r
from ..operators.chars import counts
from ..session import spread
from .corpus import GRAMS, SPLIT
from .registry import ORACLE_SQL, QUERIES, Tables, query
from .retrieval import INDEX


def _labelled(t: Tables):
    return t.documents.select("doc_id", "lang", "source", "n_chars", "text").join(t.labels, "doc_id")


LABELLED = "l AS (SELECT * FROM documents JOIN labels USING (doc_id))"


@query(
    f"""WITH {LABELLED}, g AS (SELECT *, CASE WHEN quality = 1 AND toxic = 0 THEN true WHEN quality = 0 THEN false END AS good FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, good ORDER BY doc_id) AS k FROM g WHERE good IS NOT NULL)
SELECT x.lang AS lang, x.doc_id AS chosen, y.doc_id AS rejected FROM n x JOIN n y ON x.lang = y.lang AND x.good AND NOT y.good AND x.k <= 6 AND y.k <= 6 WHERE sha256(x.text) <> sha256(y.text) AND x.n_chars >= y.n_chars"""
)
def evidence_pairs(t: Tables):
    rows = _labelled(t).select("doc_id", "lang", "n_chars", "quality", "toxic", sha256("text").alias("sha"))
    evidence = (F.col("g.sha") != F.col("b.sha")) & (F.col("g.n_chars") >= F.col("b.n_chars"))
    return a.evidence_pairs(rows, ["lang"], "doc_id", (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("quality") == 0, evidence, 6)


@query(
    """WITH i AS (SELECT conv_id + CASE WHEN turn % 5 = 4 THEN 1000000 ELSE 0 END AS conv_id, turn, sha256(CASE WHEN turn % 3 = 1 THEN text || '!' ELSE text END) AS digest FROM conversations),
c AS (SELECT conv_id, turn, sha256(text) AS now FROM conversations)
SELECT i.conv_id, i.turn, CASE WHEN now IS NULL THEN 'missing' WHEN now = digest THEN 'current' ELSE 'changed' END AS status FROM i LEFT JOIN c ON i.conv_id = c.conv_id AND i.turn = c.turn"""
)
def revalidated_pairs(t: Tables):
    """Pairs kept from an earlier import (some changed, some gone since) against the current ones."""
    now = t.conversations.select("conv_id", "turn", sha256("text").alias("digest"))
    kept = t.conversations.select(
        (F.col("conv_id") + F.when(F.col("turn") % 5 == 4, 1000000).otherwise(0)).alias("conv_id"), "turn", sha256(F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("digest")
    )
    return a.revalidated(kept, now, ["conv_id", "turn"], "digest").select("conv_id", "turn", "status")


@query(
    """WITH f AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error' UNION SELECT user_id + 100000 FROM events WHERE event_id < 3), s AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 90 GROUP BY 1)
SELECT count(*) AS flagged, count(*) FILTER (n = 1) AS once, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n IS NULL) AS absent FROM f LEFT JOIN s USING (id)"""
)
def referential_check(t: Tables):
    flagged = t.events.where("event_type = 'error'").select("user_id").union(t.events.where("event_id < 3").select(F.col("user_id") + 100000))
    return r.reencountered(flagged, t.events.where("event_type = 'purchase' and value > 90"), "user_id")


@query(f"WITH s AS {SPLIT}, {LABELLED} SELECT split, round(sum(quality * n_chars) / sum(n_chars), 6) AS ratio FROM l JOIN s USING (doc_id) GROUP BY split")
def weighted_ratio_by_split(t: Tables):
    rows = dedup.hash_split(t.documents).join(_labelled(t).select("doc_id", "n_chars", "quality"), "doc_id")
    return r.weighted_ratio(rows, ["split"], F.col("quality") * F.col("n_chars"), F.col("n_chars")).select("split", F.round("ratio", 6).alias("ratio"))


@query(
    r"""SELECT regexp_replace(regexp_replace(substr(w, 1, 110), '''[^'']*''', '''X''', 'g'), '\b\d+\b', 'N', 'g') AS reason, count(*) AS n FROM (SELECT event_type || ' at line ' || event_id || ': wanted ''' || user_id || ''' after ' || props AS w FROM events)
GROUP BY 1 ORDER BY n DESC, reason LIMIT 3"""
)
def top_reasons(t: Tables):
    c = F.col
    return r.top_reasons(t.events, F.concat(c("event_type"), F.lit(" at line "), c("event_id"), F.lit(": wanted '"), c("user_id"), F.lit("' after "), c("props")), 3)


@query(
    """WITH x AS (SELECT user_id, event_type, event_id, value >= 5 AS ok, CASE WHEN value >= 60 THEN 'pass' ELSE 'fail' END AS outcome FROM events),
g AS (SELECT user_id, event_type, count(*) FILTER (ok) AS n, count(DISTINCT outcome) FILTER (ok) AS k, arg_max(outcome, event_id) FILTER (ok) AS last FROM x GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN n = 0 THEN 'not admissible' WHEN k > 1 THEN 'conflict' ELSE 'graded' END AS state, CASE WHEN n > 0 AND k = 1 THEN last END AS outcome FROM g"""
)
def cell_states(t: Tables):
    rows = t.events.select("user_id", "event_type", "event_id", "value", F.when(F.col("value") >= 60, "pass").otherwise("fail").alias("outcome"))
    return r.cell_fold(rows, ["user_id", "event_type"], F.col("value") >= 5, "outcome", "event_id")


@query(
    f"""WITH s AS {SPLIT}, tr AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN s USING (doc_id) WHERE split = 'train'), {LABELLED},
x AS (SELECT source, n_chars >= 300 AS task, quality = 1 AS passed, toxic IS NOT NULL AS graded, toxic = 0 AS proven, sha256(text) IN (SELECT h FROM tr) AS recited FROM l JOIN s USING (doc_id)),
c AS (SELECT source, count(*) AS answered, count(*) FILTER (task) AS task, count(*) FILTER (passed) AS tests_pass, count(*) FILTER (graded) AS graded, count(*) FILTER (graded AND proven AND passed) AS clean,
 count(*) FILTER (graded AND proven AND NOT passed) AS wrong_but_proven, count(*) FILTER (graded AND proven AND passed AND recited) AS clean_recited, count(*) FILTER (graded AND proven AND passed AND NOT recited) AS clean_novel FROM x GROUP BY source)
SELECT *, clean || '/' || tests_pass || CASE WHEN tests_pass > 0 THEN ' (' || CAST(round(clean * 100 / tests_pass) AS INTEGER) || '%)' ELSE '' END AS converts FROM c"""
)
def held_out_scores(t: Tables):
    rows = _labelled(t).withColumn("h", sha256("text")).drop("text")
    seen = dedup.hash_split_rows(t.documents).where("split = 'train'").select(sha256("text").alias("h")).distinct().withColumn("recited", F.lit(True))
    rows = rows.join(seen, "h", "left").withColumn("recited", F.coalesce("recited", F.lit(False)))
    return r.held_out_scores(rows, ["source"], F.col("n_chars") >= 300, F.col("quality") == 1, F.col("toxic").isNotNull(), F.col("toxic") == 0, F.col("recited"))


@query("SELECT user_id, event_type, arg_max(event_id, value * 1000000 - event_id / 1e6) AS event_id, max(value) AS value, count(*) AS merged FROM events GROUP BY 1, 2")
def stronger_evidence(t: Tables):
    return a.stronger(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "value", "event_id")


ARMS = """w AS (SELECT user_id, max(value) FILTER (event_type = 'click') AS v0, max(value) FILTER (event_type = 'purchase') AS v1, max(props) FILTER (event_type = 'click') AS s0, max(props) FILTER (event_type = 'purchase') AS s1,
 count(value) FILTER (event_type = 'click') AS n0, count(value) FILTER (event_type = 'purchase') AS n1 FROM (SELECT user_id, event_type, value, props FROM events) GROUP BY 1),
y AS (SELECT *, n0 > 0 AND n1 > 0 AS b, n0 > 0 AND n1 > 0 AND s0 = s1 AS same FROM w WHERE n0 + n1 > 0)"""


@query(
    f"""WITH {ARMS} SELECT count(*) FILTER (same) AS paired, count(*) FILTER (same AND v1 > v0) AS wins, count(*) FILTER (same AND v1 < v0) AS losses, count(*) FILTER (same AND v1 = v0) AS ties,
round(avg(v1 - v0) FILTER (same), 6) AS difference, count(*) FILTER (NOT b) AS one_arm, count(*) FILTER (b AND NOT same) AS mismatched FROM y"""
)
def paired_arms(t: Tables):
    return r.paired_arms(t.events, "user_id", "event_type", "click", "purchase", "props", "value").withColumn("difference", F.round("difference", 6))


@query(
    """SELECT lang, n_chars % 50 AS chars, count(*) AS runs, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list_distinct(list(source)))[:20], ',') AS sources FROM documents GROUP BY 1, 2"""
)
def holdout_groups(t: Tables):
    rows = t.documents.select("lang", (F.col("n_chars") % 50).alias("chars"), "source")
    return r.holdout_groups(rows, ["lang", "chars"], {"sources": "source"}).withColumn("sources", F.array_join("sources", ","))


@query(
    f"""WITH {GRAMS}, x AS (SELECT source, count(*) AS before, count(pos) AS flagged FROM documents LEFT JOIN firsts USING (doc_id) GROUP BY source),
k AS (SELECT source, count(*) AS after FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM firsts) GROUP BY source)
SELECT source, before, flagged, coalesce(after, 0) AS after, before = flagged + coalesce(after, 0) AS proven FROM x LEFT JOIN k USING (source)"""
)
def exclusion_proof(t: Tables):
    flagged = leakage.first_matches(t.documents, t.benchmark).select("doc_id")
    kept = t.documents.join(flagged, "doc_id", "left_anti")
    return r.exclusion_proof(t.documents, kept, flagged, "doc_id", "source")


@query(
    f"""WITH {GRAMS}, m AS (SELECT f.doc_id, source, pos, gram, text, row_number() OVER (PARTITION BY source ORDER BY f.doc_id) AS n FROM firsts f JOIN documents USING (doc_id))
SELECT source, doc_id, CAST(pos AS INTEGER) AS pos, gram, left(text, 280) AS snippet FROM m WHERE n <= 25"""
)
def decontam_examples(t: Tables):
    """At most 25 examples a source for a reader, with the first 280 characters; flagged ids are not capped (ngram_decontam_flagged)."""
    hits = leakage.first_matches(t.documents, t.benchmark).join(t.documents.select("doc_id", "source", "text"), "doc_id")
    return leakage.examples(hits, "source", "doc_id", 25, 280).select("source", "doc_id", "pos", "gram", "snippet")


@query(
    f"""WITH s AS {SPLIT}, d AS (SELECT doc_id, split, sha256(text) AS body, sha256(source || split_part(text, chr(10), 1)) AS spec FROM documents JOIN s USING (doc_id)), tr AS (SELECT * FROM d WHERE split = 'train')
SELECT doc_id, CASE WHEN doc_id + 1 IN (SELECT doc_id FROM tr) AND doc_id % 10 = 0 THEN 'answered in training' WHEN body IN (SELECT body FROM tr) THEN 'same program' WHEN spec IN (SELECT spec FROM tr) THEN 'same specification' END AS reason FROM d WHERE split = 'val'"""
)
def held_out_cleaning(t: Tables):
    """A document's specification is its source and its head line."""
    rows = t.documents.select("doc_id", "source", "text").join(dedup.hash_split(t.documents), "doc_id")
    rows = rows.select("doc_id", "split", sha256("text").alias("body"), sha256(F.concat("source", F.substring_index("text", "\n", 1))).alias("spec"))
    held = rows.where("split = 'val'").withColumn("problem", F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") + 1))
    train = rows.where("split = 'train'").withColumn("problem", F.col("doc_id"))
    return r.cleaned(held, train, {"answered in training": "problem", "same program": "body", "same specification": "spec"}).select("doc_id", "reason")


@query(
    """WITH p AS (SELECT event_type AS gate, user_id % 7 AS problem, props, count(*) AS n FROM events WHERE value < 20 GROUP BY 1, 2, 3)
SELECT gate, problem, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_sort(list(props))[:5], ';') AS details FROM p GROUP BY 1, 2"""
)
def findings_by_problem(t: Tables):
    rows = t.events.where("value < 20").select(F.col("event_type").alias("gate"), (F.col("user_id") % 7).alias("problem"), "props")
    return r.findings_by_problem(rows, "gate", "problem", "props").withColumn("details", F.array_join("details", ";"))


@query("SELECT source, count(*) AS decodes, round(avg(CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM documents GROUP BY source")
def problem_fractions(t: Tables):
    return r.problem_fractions(t.documents, ["source"], F.col("n_chars") >= 500).withColumn("fraction", F.round("fraction", 6))


@query(
    """SELECT p_partkey, round(CASE WHEN p_size % 9 <> 0 AND p_size % 7 + 1 > 1 THEN (p_size % 7 + 1 - p_retailprice / 1000) / (p_size % 7) END, 6) AS fraction,
CASE WHEN p_size % 9 = 0 THEN 'not eligible' WHEN p_size % 7 + 1 <= 1 THEN 'no denominator' END AS reason FROM part"""
)
def closed_fractions(t: Tables):
    table = (F.col("p_size") % 7 + 1).cast("double")
    value, why = r.closed_fraction(table, F.col("p_retailprice") / 1000, F.when(F.col("p_size") % 9 == 0, "not eligible"))
    return t.part.select("p_partkey", F.round(value, 6).alias("fraction"), why.alias("reason"))


@query(f"""WITH s AS ({ORACLE_SQL['split_health']}), l AS ({ORACLE_SQL['leakage_verdict']})
SELECT s.verdict AS split, l.verdict AS leakage, CASE WHEN s.verdict <> 'healthy' THEN 'split: ' || s.verdict WHEN l.verdict <> 'CLEAN' THEN 'leakage: ' || l.verdict END AS reason FROM s, l""")
def holdout_eligibility(t: Tables):
    """Whether a number on the hash split's validation side may be reported: its health first, then what leaks."""
    split = QUERIES["split_health"](t.spark, t.sf_dir).select(F.col("verdict").alias("split"))
    both = split.crossJoin(QUERIES["leakage_verdict"](t.spark, t.sf_dir).select(F.col("verdict").alias("leakage")))
    return both.select("split", "leakage", r.eligible(F.col("split"), F.col("leakage"))[1].alias("reason"))


@query(
    f"""WITH {LABELLED} SELECT source, count(*) FILTER (quality = 1) AS answerable, count(*) FILTER (quality = 1 AND n_chars >= 400) AS shown, count(*) FILTER (quality = 1 AND n_chars >= 400 AND toxic = 0) AS "right",
count(*) FILTER (quality = 1 AND n_chars < 400) AS empty, count(*) FILTER (quality = 0) AS unanswerable, count(*) FILTER (quality = 0 AND n_chars >= 400) AS invented, count(*) FILTER (quality = 0 AND n_chars < 400) AS rightly_empty FROM l GROUP BY source"""
)
def shown_report(t: Tables):
    return r.shown_report(_labelled(t), "source", F.col("quality") == 1, F.col("n_chars") >= 400, F.col("toxic") == 0)


@query(
    """WITH p AS (SELECT conv_id, turn, string_split(text, '. ') AS s FROM conversations), c AS (SELECT conv_id, turn, unnest(s) AS s, unnest(range(0, len(s))) AS k FROM p),
w AS (SELECT c.conv_id AS conv_id, c.turn AS turn, c.k AS k, max(len(list_intersect(list_distinct(regexp_extract_all(lower(c.s), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(d.s), '[a-z0-9]+')))) / greatest(len(list_distinct(regexp_extract_all(lower(c.s), '[a-z0-9]+'))), 1)) AS best
 FROM c JOIN c d ON c.conv_id = d.conv_id AND d.turn = c.turn - 1 GROUP BY 1, 2, 3) SELECT conv_id, turn, round(avg(best), 6) AS support FROM w GROUP BY 1, 2"""
)
def sentence_support(t: Tables):
    """Each turn's mean support by the turn before: per sentence, the greatest share of its words in one sentence there (the scorer is a column)."""
    s = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", r"\. ")).alias("k", "s")).select("conv_id", "turn", "k", F.array_distinct(alnum_words("s")).alias("w"))
    before = s.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("p"))
    score = F.size(F.array_intersect("w", "p")) / F.greatest(F.size("w"), F.lit(1))
    return r.support(s.join(before, ["conv_id", "turn"]), ["conv_id", "turn"], "k", score).withColumn("support", F.round("support", 6))


# ------------------------------------------------------------------ rows


SAMPLES = "x AS (SELECT user_id AS task, event_id AS sample, props AS text, CAST(floor(value / 15) AS INTEGER) AS level FROM events)"


def _samples(t: Tables):
    return t.events.select(F.col("user_id").alias("task"), F.col("event_id").alias("sample"), F.col("props").alias("text"), F.floor(F.col("value") / 15).cast("int").alias("level"))


@query(
    f"""WITH {SAMPLES}, k AS (SELECT * FROM x WHERE task % 10 <> 3 AND level >= 2)
SELECT task, max(level) AS level, arg_max(sample, CAST(level AS BIGINT) * 100000000 - sample) AS sample, text, count(*) AS merged FROM k GROUP BY task, text"""
)
def graded_pool(t: Tables):
    s = _samples(t)
    return a.graded_pool(s, "task", "text", "level", "sample", 2, s.where("task % 10 = 3"))[0].select("task", "level", "sample", "text", "merged")


@query(
    f"""WITH {SAMPLES}, n AS (SELECT 'held out' AS reason, count(*) AS n FROM x WHERE task % 10 = 3 UNION ALL SELECT 'below the level', count(*) FROM x WHERE task % 10 <> 3 AND level < 2
 UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT (task, text)) FROM x WHERE task % 10 <> 3 AND level >= 2) SELECT * FROM n WHERE n > 0"""
)
def graded_pool_refusals(t: Tables):
    s = _samples(t)
    return a.graded_pool(s, "task", "text", "level", "sample", 2, s.where("task % 10 = 3"))[1]


@query(
    f"""WITH {SAMPLES}, g AS (SELECT task, text, min(sample) AS sample FROM x WHERE level >= 1 AND length(text) >= 8 GROUP BY 1, 2),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY task ORDER BY sample) AS INTEGER) AS place FROM g) SELECT task, sample, text, place FROM p WHERE place <= 3"""
)
def training_rows(t: Tables):
    gates = [("not graded", F.col("level") < 1), ("too short", F.char_length("text") < 8)]
    return a.training_rows(_samples(t), "task", "text", "sample", gates, 3).select("task", "sample", "text", "place")


@query(
    f"""WITH {SAMPLES}, y AS (SELECT *, sha256(text) AS digest FROM x), ok AS (SELECT DISTINCT task, digest FROM y WHERE level >= 4),
no AS (SELECT DISTINCT task, digest FROM y WHERE level = 0 AND task IN (SELECT task FROM ok) AND (task, digest) NOT IN (SELECT (task, digest) FROM ok))
SELECT task, digest FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY digest) AS k FROM no) WHERE k <= 4"""
)
def disagreeing_negatives(t: Tables):
    s = _samples(t).withColumn("digest", sha256("text"))
    return a.disagreeing(s.where("level >= 4"), s.where("level = 0"), "task", "digest", 4).select("task", "digest")


@query(
    """WITH x AS (SELECT event_type AS lane, user_id AS task, event_id AS sample, props AS text, sha256(concat_ws(chr(0), CAST(user_id AS VARCHAR), props)) AS row_hash FROM events WHERE event_type <> 'error'),
f AS (SELECT task, row_hash, lane, sample, row_number() OVER (PARTITION BY task, row_hash ORDER BY lane, sample) AS c FROM x)
SELECT task, row_hash, lane, sample FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY lane, sample) AS k FROM f WHERE c = 1) WHERE k <= 4"""
)
def merged_lanes(t: Tables):
    rows = t.events.select(F.col("event_type").alias("lane"), F.col("user_id").alias("task"), F.col("event_id").alias("sample"), F.col("props").alias("text"))
    return a.merged_lanes(rows, "lane", "task", "text", ["sample"], 4, ["error"]).select("task", "row_hash", "lane", "sample")


@query(
    """WITH x AS (SELECT conv_id AS task, turn AS sample, text, role = 'assistant' AS graded FROM conversations), asked AS (SELECT conv_id AS task, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1),
p AS (SELECT conv_id AS task, arg_max(text, turn) AS proved FROM conversations WHERE role = 'assistant' GROUP BY 1), d AS (SELECT task, text, min(sample) AS sample FROM x WHERE graded AND text <> '' GROUP BY 1, 2),
b AS (SELECT d.*, question, proved, CASE WHEN d.text <> proved THEN 'repair' ELSE 'pass' END AS built FROM d JOIN asked USING (task) JOIN p USING (task)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, built ORDER BY sample) AS k FROM b) WHERE k <= CASE built WHEN 'repair' THEN 2 ELSE 1 END)
SELECT task, sample, built, sha256(CASE built WHEN 'pass' THEN 'user:' || question || chr(0) || 'assistant:' || text ELSE 'user:' || question || chr(0) || 'assistant:' || text || chr(0) || 'user:The last answer differs from the proved one.' || chr(0) || 'assistant:' || proved END) AS conversation FROM k"""
)
def repair_conversations(t: Tables):
    """Conversations from a task's drafts: the assistant's turns; the last one is the proved answer, the first user turn asks."""
    c = t.conversations.select(F.col("conv_id").alias("task"), F.col("turn").alias("sample"), "role", "text")
    asked = c.where("role = 'user'").groupBy("task").agg(F.min_by("text", "sample").alias("question"))
    proved = c.where("role = 'assistant'").groupBy("task").agg(F.max_by("text", "sample").alias("proved"))
    drafts = c.where("role = 'assistant'").join(asked, "task").join(proved, "task")
    same = F.col("text") == F.col("proved")
    rows = a.repairs(drafts, "task", "sample", "text", same, same).withColumn("messages", a.repair_messages("question", "text", "proved", F.lit("The last answer differs from the proved one."), F.col("built") == "repair"))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\x00")
    return rows.select("task", "sample", "built", sha256(said).alias("conversation"))


@query(
    """WITH x AS (SELECT doc_id, lang, quality AS label FROM documents JOIN labels USING (doc_id)), n AS (SELECT doc_id, toxic AS new FROM labels WHERE doc_id % 2 = 0), b AS (SELECT * FROM x LEFT JOIN n USING (doc_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM b WHERE new <> label)
SELECT doc_id, lang, label, false AS relabelled FROM b WHERE new IS NULL OR new = label UNION ALL SELECT doc_id, lang, new, true FROM m WHERE k <= 5"""
)
def relabelled_rows(t: Tables):
    rows = _labelled(t).select("doc_id", "lang", F.col("quality").alias("label"))
    return a.relabelled(rows, t.labels.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("label")), "lang", "doc_id", 5).select("doc_id", "lang", "label", "relabelled")


@query(
    """WITH e AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS w FROM conversations WHERE text <> ''),
p AS (SELECT a.conv_id, a.turn, a.w AS p, list_append(b.w, 0) AS c, list_append(x.w, 0) AS r FROM e a JOIN e b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 JOIN e x ON x.conv_id = a.conv_id + 1 AND x.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN len(p) + greatest(len(c), len(r)) > 513 THEN 'longer than the block' END AS reason,
CASE WHEN len(p) + greatest(len(c), len(r)) <= 513 THEN array_to_string(list_concat(p, c)[:len(p) + len(c) - 1], ' ') END AS input,
CASE WHEN len(p) + greatest(len(c), len(r)) <= 513 THEN array_to_string(list_concat(list_transform(p, lambda x: CAST(-1 AS BIGINT)), c)[2:], ' ') END AS target FROM p"""
)
def preference_rows(t: Tables):
    """A turn as the prompt, its reply chosen, the same turn's reply of the next conversation rejected; ids are code points, 0 ends a reply."""
    points = F.transform(F.split("text", ""), lambda ch: F.ascii(ch))
    e = t.conversations.where("text <> ''").select("conv_id", "turn", points.alias("w"))
    reply = lambda off, name: e.select((F.col("conv_id") - off).alias("conv_id"), (F.col("turn") - 1).alias("turn"), F.concat("w", F.array(F.lit(0))).alias(name))
    pairs = e.join(reply(0, "chosen"), ["conv_id", "turn"]).join(reply(1, "rejected"), ["conv_id", "turn"])
    out = a.preference_rows(pairs, F.col("w"), F.col("chosen"), F.col("rejected"), 512)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return out.select("conv_id", "turn", "reason", text("chosen_row.input").alias("input"), text("chosen_row.target").alias("target"))


@query(
    """WITH k AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents), o AS (SELECT *, sum(n_chars) OVER (ORDER BY turn, lang) AS run FROM k),
f AS (SELECT min(run - n_chars) AS stop FROM o WHERE run > 300000), i AS (SELECT o.* FROM o, f WHERE run <= 300000 AND (stop IS NULL OR run - n_chars < stop)),
z AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY n_chars, doc_id) AS run FROM o WHERE doc_id NOT IN (SELECT doc_id FROM i))
SELECT doc_id, n_chars, 'round' AS part FROM i UNION ALL SELECT doc_id, n_chars, 'fill' FROM z WHERE run + (SELECT coalesce(sum(n_chars), 0) FROM i) <= 300000"""
)
def budget_fill(t: Tables):
    return a.budget_fill(t.documents.select("doc_id", "lang", "n_chars"), "lang", "doc_id", "n_chars", 300000).select("doc_id", "n_chars", "part")


@query(
    """WITH x AS (SELECT event_id, sha256(event_type || chr(0) || props) AS row_hash FROM events), o AS (SELECT * FROM x WHERE event_id < 100)
SELECT event_id, row_hash, true AS frozen FROM o UNION ALL SELECT min(event_id), row_hash, false FROM x WHERE event_id >= 100 AND row_hash NOT IN (SELECT row_hash FROM o) GROUP BY row_hash"""
)
def after_frozen(t: Tables):
    rows = t.events.select("event_id", "event_type", "props")
    return a.after_frozen(rows, rows.where("event_id < 100"), "event_id", "event_type", "props").select("event_id", "row_hash", "frozen")


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id DESC LIMIT 40")
def last_rows(t: Tables):
    return t.events.select("event_id", "user_id", "value").orderBy(F.desc("event_id")).limit(40)


# ------------------------------------------------------------------ texts


@query("WITH c AS (SELECT list(DISTINCT unicode(ch) ORDER BY unicode(ch)) AS v FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '') SELECT len(v) AS characters, sha256('[' || array_to_string(v, ',') || ']') AS fingerprint FROM c")
def tokenizer_fingerprint(t: Tables):
    """sha256 of a character tokenizer's canonical JSON: its code points in order (a vocabulary has a bounded size)."""
    points = counts(t.documents).agg(F.array_sort(F.collect_set(F.conv(F.hex(F.encode("ch", "UTF-32")), 16, 10).cast("int"))).alias("v"))
    return points.select(F.size("v").cast("long").alias("characters"), sha256(F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: x.cast("string")), ","), F.lit("]"))).alias("fingerprint"))


@query(
    """WITH v AS (SELECT ch, row_number() OVER (ORDER BY unicode(ch)) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark) WHERE ch <> ''),
d AS (SELECT item_id, unnest(string_split(text, '')) AS ch, unnest(range(0, len(string_split(text, '')))) AS i FROM benchmark)
SELECT item_id, sha256(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i)) AS ids, count(*) AS n FROM d JOIN v USING (ch) GROUP BY item_id"""
)
def char_codes(t: Tables):
    """Texts as ids of a character vocabulary (the rank of the code point); unknown characters are left out."""
    from ..operators.chars import codes, vocabulary

    ids = codes(t.benchmark, vocabulary(t.benchmark), "item_id")
    return ids.select("item_id", sha256(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("ids"), F.size("ids").cast("long").alias("n"))


@query(
    """WITH s AS (SELECT doc_id, string_split(text, '. ') AS s, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM documents), n AS (SELECT *, greatest(CAST(floor(len(s) / (floor(w / 350) + 1)) AS BIGINT), 1) AS n FROM s)
SELECT doc_id, CAST(ceil(len(s) / n) AS BIGINT) AS chunks, sha256(array_to_string(list_transform(range(1, len(s) + 1, n), lambda k: array_to_string(s[k:k + n - 1], ' ')), chr(10))) AS digest FROM n"""
)
def sentence_chunks(t: Tables):
    """About 350 words a chunk; the sentence splitter is the caller's."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    chunks = spans.sentence_chunks(F.split("text", r"\. "), words)
    return t.documents.select("doc_id", F.size(chunks).cast("long").alias("chunks"), F.sha2(F.array_join(chunks, "\n"), 256).alias("digest"))


@query(r"""SELECT item_id, nullif(trim(regexp_extract('Signature: f' || chr(10) || 'Problem: ' || text, '(?m)^Problem:[ \t]*(.*)$', 1)), '') AS title FROM benchmark""")
def problem_titles(t: Tables):
    """The rest of the line behind the label, the label being put before each text."""
    return t.benchmark.select("item_id", spans.title(F.concat(F.lit("Signature: f\nProblem: "), "text")).alias("title"))


@query("SELECT page_id, '[web:' || url || '#' || page_id || ']' AS citation FROM pages")
def citations(t: Tables):
    return t.pages.select("page_id", spans.citation(F.lit("web"), F.col("url"), F.col("page_id")).alias("citation"))


PATHS = "(SELECT doc_id, source, source || '/' || CASE doc_id % 4 WHEN 0 THEN 'data/test_x' WHEN 1 THEN 'vendor' WHEN 2 THEN 'src' ELSE 'tests' END || '/f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.rst' ELSE '' END AS path FROM documents)"


def _paths(t: Tables):
    folder = F.get(F.array(*map(F.lit, ("data/test_x", "vendor", "src", "tests"))), (F.col("doc_id") % 4).cast("int"))
    suffix = F.get(F.array(*map(F.lit, (".py", ".rst", ""))), (F.col("doc_id") % 3).cast("int"))
    return t.documents.select("doc_id", "source", F.concat("source", F.lit("/"), folder, F.lit("/f"), "doc_id", suffix).alias("path"))


@query(
    rf"""SELECT doc_id, path, (split_part(path, '/', 1) = 'src0' AND suffix(path, '.py')) OR (split_part(path, '/', 1) = 'src1' AND suffix(path, '.rst')) AS selected,
CASE WHEN path LIKE '%/vendor/%' THEN 'folder' WHEN path LIKE '%/data/test_x/%' THEN 'test data' END AS barred,
CASE WHEN suffix(path, '.rst') THEN 'documentation' WHEN path LIKE '%/tests/%' THEN 'test' ELSE 'code' END AS kind, source || ':' || split_part(path, '/', 2) AS family FROM {PATHS}"""
)
def path_rules(t: Tables):
    p, s = F.col("path"), F.col("source")
    rows = _paths(t)
    kind = spans.first_kind(p, [("documentation", r"\.rst$"), ("test", "/(tests|benches)/")], "code")
    family = spans.family(s, p, r"^[^/]+/([^/]+)/", {"src3": r"^[^/]+/([^/]+)/"})
    return rows.select("doc_id", "path", spans.in_scope(p, [("src0", ".py"), ("src1", ".rst")]).alias("selected"), spans.barred(p, ["vendor"], "(?i)human[_-]?eval").alias("barred"), kind.alias("kind"), family.alias("family"))


@query("SELECT event_id, CASE WHEN value >= 20 THEN user_id END AS user_id, event_type, CASE WHEN value >= 20 THEN value END AS value FROM events")
def claims_only(t: Tables):
    return t.events.select(*spans.claims_only(["event_id", "user_id", "event_type", "value"], ["event_id", "event_type"], F.col("value") >= 20))


@query(
    """WITH s AS (SELECT conv_id, turn, string_split(text, '. ') AS s FROM conversations), x AS (SELECT conv_id, turn, unnest(range(0, len(s))) AS sentence, regexp_extract_all(lower(unnest(s)), '[a-z0-9]+') AS w FROM s),
r AS (SELECT conv_id, turn, sentence, flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, least(i + 7, len(w) + 1)), lambda j: array_to_string(w[i:j], ' ')))) AS r FROM x),
g AS (SELECT conv_id, turn, sentence, len(r) AS runs, list_filter(r, lambda s: length(s) % 5 = 0) AS g FROM r)
SELECT conv_id, turn, CAST(sentence AS INTEGER) AS sentence, runs, array_to_string(list_sort(list_distinct(list_filter(g, lambda s: len(list_filter(g, lambda o: o <> s AND contains(o, s))) = 0))), '|') AS maximal FROM g"""
)
def maximal_runs(t: Tables):
    """Of every sentence, the runs of up to seven words that read as a kind, here of a length; the longest reading of each place."""
    rows = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", r"\. ")).alias("sentence", "s"))
    rows = rows.select("conv_id", "turn", "sentence", spans.runs(alnum_words("s")).alias("r"))
    rows = rows.select("conv_id", "turn", "sentence", F.size("r").cast("long").alias("runs"), F.filter("r", lambda s: F.char_length(s) % 5 == 0).alias("g"))
    return rows.select("conv_id", "turn", "sentence", "runs", F.array_join(F.array_sort(spans.maximal(F.col("g"))), "|").alias("maximal"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), u AS (SELECT doc_id, len(l) AS n, list_transform(range(1, len(l) + 1), lambda i: CAST(list_sum(list_transform(l[:i], lambda x: strlen(x) + 1)) - 1 AS BIGINT)) AS u FROM l)
SELECT doc_id, n AS lines, len(list_filter(u, lambda x: x <= 600)) AS kept FROM u"""
)
def whole_lines(t: Tables):
    lines = F.split("text", "\n", -1)
    return t.documents.select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(spans.whole_lines(lines, F.octet_length, 600)).cast("long").alias("kept"))


@query("SELECT conv_id, turn, CASE WHEN len(list_intersect(string_split(replace(split_part(text, '.', 1), ',', ''), ' '), ['No', 'no', 'not'])) > 0 THEN 'no' ELSE 'yes' END AS said FROM conversations WHERE role = 'assistant'")
def yes_no_replies(t: Tables):
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", spans.yes_no(F.col("text")).alias("said"))


@query(
    """WITH x AS (SELECT p_partkey, CAST(p_size AS DECIMAL(38, 10)) AS a, CAST(p_size * 0.01 AS DECIMAL(38, 10)) AS b, CAST(1 - p_size * 0.01 AS DECIMAL(38, 10)) AS c, CAST(p_size + 1 AS DECIMAL(38, 10)) AS d FROM part),
y AS (SELECT p_partkey, list_distinct([a, b, c, d]) AS u, list_concat([a, a / 100, a * 100], list_concat(list_transform(list_filter([a, a / 100, a * 100], lambda x: x > 0 AND x < 1), lambda x: 1 - x), list_transform(list_filter([a, a / 100, a * 100], lambda x: x > 0 AND x < 1), lambda x: 1 + x))) AS k FROM x)
SELECT p_partkey, len(list_filter(u, lambda v: NOT list_contains(list_transform(k, lambda x: round(CAST(x AS DOUBLE), 6)), round(CAST(v AS DOUBLE), 6)))) AS ungrounded FROM y"""
)
def ungrounded_numbers(t: Tables):
    """Numbers of a working that its question, 'p_size of them', does not state."""
    d, p = lambda c: c.cast("decimal(38,10)"), F.col("p_size")
    used = F.array(d(p), d(p * F.lit(0.01).cast("decimal(5,2)")), d(1 - p * F.lit(0.01).cast("decimal(5,2)")), d(p + 1))
    stated = spans.numbers_in(F.concat(p.cast("string"), F.lit(" of them, or v2.")))
    return t.part.select("p_partkey", F.size(spans.ungrounded(used, stated)).cast("long").alias("ungrounded"))


@query(
    """WITH o AS (SELECT l_orderkey, max(l_returnflag) FILTER (l_linenumber = 1) AS a, max(l_returnflag) FILTER (l_linenumber = 2) AS b, max(l_returnflag) FILTER (l_linenumber = 3) AS c FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2 AND len(list_distinct([a, b, c])) = 1 THEN coalesce(a, b, c) END AS agreed, CASE WHEN a = b OR a = c THEN a END AS confirmed FROM o"""
)
def agreement_gates(t: Tables):
    """The flags of an order's first three lines as three ways to a value: what all that say something agree on, and the first way's if another gives it."""
    way = [F.max(F.when(F.col("l_linenumber") == k, F.col("l_returnflag"))).alias(f"w{k}") for k in (1, 2, 3)]
    o = t.lineitem.groupBy("l_orderkey").agg(*way)
    return o.select("l_orderkey", spans.agreed(F.array("w1", "w2", "w3")).alias("agreed"), spans.confirmed(F.col("w1"), F.array("w2", "w3"), 1).alias("confirmed"))


@query(
    """SELECT p_partkey, len(list_filter(list_distinct([p_size + 1, p_size - 1, -p_size, 0, p_size * 2]), lambda x: x <> p_size)) AS wrong, regexp_full_match(p_name, '-?[0-9]+') AS is_int, TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) + 1 AS next FROM part"""
)
def wrong_outputs(t: Tables):
    p = F.col("p_size").cast("long")
    return t.part.select("p_partkey", F.size(spans.mutations(p)).cast("long").alias("wrong"), spans.is_int(F.col("p_name")).alias("is_int"), (spans.to_int(p.cast("string")) + 1).cast("double").alias("next"))


@query(
    """SELECT user_id, least(3 - neg, pos) AS positives, neg AS negatives FROM (SELECT user_id, pos, n, CASE WHEN 2 > n THEN n WHEN 3 - 2 > pos THEN least(3 - pos, n) ELSE 2 END AS neg FROM
 (SELECT user_id, count(*) FILTER (value >= 95) AS pos, count(*) FILTER (value < 2) AS n FROM events GROUP BY 1))"""
)
def noise_mix(t: Tables):
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("value") >= 95).alias("p"), F.count_if(F.col("value") < 2).alias("n"))
    pos, neg = spans.noise_mix(F.col("p"), F.col("n"), 0.6, 3)
    return g.select("user_id", pos.alias("positives"), neg.alias("negatives"))


@query(
    f"""WITH {INDEX} SELECT item_id, doc_id, CAST(5 - rank AS INTEGER) AS place FROM ranked WHERE rank <= 4 AND score > 0"""
)
def few_shot(t: Tables):
    """The four best examples for each question, the nearest last."""
    return retrieval.few_shot(retrieval.Postings(t.documents, t.benchmark, "doc_id", "item_id").best("index", 4).where("score > 0"), "item_id", 4).select("item_id", "doc_id", "place")


@query(
    """WITH p AS (SELECT doc_id % 500 AS id, source AS title, text, doc_id FROM documents), f AS (SELECT id, arg_min(title, doc_id) AS title, arg_min(text, doc_id) AS text FROM p GROUP BY id)
SELECT id, sha256(CASE WHEN title = 'src0' THEN text ELSE title || chr(10) || text END) AS indexed FROM f"""
)
def indexed_passages(t: Tables):
    """Passages added to an index: the first copy of each id wins; a title goes before the text."""
    rows = t.documents.select((F.col("doc_id") % 500).alias("id"), F.nullif("source", F.lit("src0")).alias("title"), "text", "doc_id")
    return retrieval.indexed(rows, "id", "doc_id", "title", "text").select("id", sha256("indexed").alias("indexed"))


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), p AS (SELECT doc_id, unnest(range(0, len(w), 100)) AS spot, w FROM w),
s AS (SELECT doc_id, spot, unnest(list_distinct(w[spot + 1:spot + 100])) AS term FROM p), q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM benchmark),
c AS (SELECT item_id, doc_id, spot, count(*) AS score FROM s JOIN q USING (term) GROUP BY 1, 2, 3)
SELECT item_id, doc_id, spot, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, spot) AS k FROM c) WHERE k <= 3"""
)
def passage_pick(t: Tables):
    """The three passages of 100 words that share most words with each question."""
    w = word_tokens("text")
    # passages are cut before they are exploded: a row holds its own words alone
    spots = F.sequence(F.lit(0), F.size("w") - 1, F.lit(100))
    cut = F.transform(spots, lambda k: F.struct(k.cast("long").alias("spot"), F.slice("w", k + 1, F.lit(100)).alias("words")))
    rows = spread(t.documents.select("doc_id", "text")).select("doc_id", w.alias("w")).where(F.size("w") > 0).select("doc_id", F.explode(cut).alias("p"))
    found = retrieval.Postings(rows.select("doc_id", "p.spot", "p.words"), t.benchmark, ["doc_id", "spot"], "item_id", words=F.col("words")).best("overlap", 3)
    return found.select("item_id", "doc_id", "spot", F.col("score").cast("long").alias("score"))


@query(
    """WITH x AS (SELECT event_id, props, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, sha256('{"a":' || event_id % 5 || ',"k":' || k || '}') AS digest FROM x"""
)
def json_digests(t: Tables):
    """Digests of JSON whose keys come in any order, some of it written twice over as a JSON string."""
    from ..functions.python_text import python_udf
    from ..session import ship_code

    ship_code(t.spark)
    k = F.get_json_object("props", "$.k")
    plain = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "a": '), F.col("event_id") % 5, F.lit("}"))).otherwise(F.concat(F.lit('{"a":'), F.col("event_id") % 5, F.lit(',"k":'), k, F.lit("}")))
    twice = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(plain)
    return t.events.select("event_id", python_udf(spans.json_digest, "string")(twice).alias("digest"))
