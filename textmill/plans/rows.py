"""Training rows: caps, tiers, pairs, conversations, padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs
from ..operators import rows as r
from ..operators.ordered import sum_before
from .registry import Tables, query


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def cap_per_group(t: Tables):
    return r.cap_per_group(t.documents.select("doc_id", "source"), ["source"], [F.col("doc_id")], 3)


@query("WITH f AS (SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY text, source) SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM f) WHERE n <= 5")
def dedup_then_cap(t: Tables):
    firsts = t.documents.groupBy("source", F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")
    return r.cap_per_group(firsts, ["source"], [F.col("doc_id")], 5)


@query("SELECT doc_id, lang, CAST(n AS INTEGER) AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) ORDER BY n, lang LIMIT 100")
def round_robin_kinds(t: Tables):
    return r.round_robin(t.documents.select("doc_id", "lang"), "lang", [F.col("doc_id")], 100).select("doc_id", "lang", "turn")


TIER = "CASE WHEN quality = 1 AND toxic = 0 THEN 'good' WHEN quality = 1 THEN 'mixed' ELSE 'poor' END"


@query(
    f"""WITH l AS (SELECT d.doc_id, source, {TIER} AS tier FROM documents d JOIN labels USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY source, tier ORDER BY doc_id) AS a FROM l),
c AS (SELECT * FROM k WHERE a <= CASE tier WHEN 'good' THEN 4 WHEN 'mixed' THEN 2 ELSE 1 END)
SELECT doc_id, source, tier, place FROM (SELECT doc_id, source, tier, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE tier WHEN 'good' THEN 1 WHEN 'mixed' THEN 2 ELSE 3 END, doc_id) AS INTEGER) AS place FROM c) WHERE place <= 5"""
)
def tiered_caps(t: Tables):
    tier = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").when(F.col("quality") == 1, "mixed").otherwise("poor")
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id").select("doc_id", "source", tier.alias("tier"))
    return r.tiered(rows, ["source"], "tier", [F.col("doc_id")], {"good": 4, "mixed": 2, "poor": 1}, 5)


@query(
    """WITH x AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, event_id, CASE event_type WHEN 'purchase' THEN 'twin' WHEN 'click' THEN 'failed' WHEN 'error' THEN 'unparsed' END AS tier FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, tier ORDER BY event_id) AS a FROM x WHERE tier IS NOT NULL), c AS (SELECT *, count(*) FILTER (tier = 'failed') OVER (PARTITION BY user_id, day) AS b FROM k WHERE a <= CASE tier WHEN 'unparsed' THEN 1 ELSE 2 END)
SELECT user_id, event_id, tier, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, day ORDER BY CASE tier WHEN 'twin' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END, event_id) AS INTEGER) AS place FROM c WHERE tier <> 'unparsed' OR b < 2) WHERE place <= 4"""
)
def negatives_by_tier(t: Tables):
    """A problem's (user's day's) negatives: twins, then failed samples; samples that did not parse only where fewer than two failed."""
    tier = F.when(F.col("event_type") == "purchase", "twin").when(F.col("event_type") == "click", "failed").when(F.col("event_type") == "error", "unparsed")
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), "event_id", tier.alias("tier"))
    return r.tiered(rows, ["user_id", "day"], "tier", [F.col("event_id")], {"twin": 2, "failed": 2, "unparsed": 1}, 4, {"unparsed": ("failed", 2)}).select("user_id", "event_id", "tier", "place")


@query("SELECT user_id, arg_max(event_id, value * 1000000 - event_id / 1e6) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def best_per_group(t: Tables):
    best = F.min(F.struct((-F.col("value")).alias("m"), "event_id")).alias("b")
    return t.events.groupBy("user_id").agg(best).select("user_id", F.col("b.event_id").alias("event_id"), (-F.col("b.m")).alias("value"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_wins(t: Tables):
    e = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return logs.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), v AS (SELECT user_id, sum(n) AS votes FROM c GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, event_type, CAST(votes AS BIGINT) AS votes, round(n / votes, 6) AS share FROM b JOIN v USING (user_id) WHERE k = 1 AND votes >= 3 AND n / votes >= 0.25"""
)
def majority_vote(t: Tables):
    return r.majority(t.events, ["user_id"], "event_type", 3, 0.25)


@query(
    """WITH l AS (SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)), k AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) AS i FROM l)
SELECT a.lang AS lang, CAST(a.i AS INTEGER) AS i, a.doc_id AS chosen, b.doc_id AS rejected FROM k a JOIN k b ON a.lang = b.lang AND a.i = b.i AND a.quality = 1 AND b.quality = 0 WHERE a.i <= 4"""
)
def preference_pairs_positional(t: Tables):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return r.positional_pairs(rows, ["lang"], F.col("quality") == 1, "doc_id", "doc_id", 4)


@query(
    """SELECT conv_id, len(list(turn)) AS turns, array_to_string(list(role ORDER BY turn), ',') AS roles, sha256(array_to_string(list(text ORDER BY turn), chr(10))) AS digest FROM conversations GROUP BY conv_id"""
)
def conversation_rows(t: Tables):
    m = F.col("messages")
    return r.conversations(t.conversations).select(
        "conv_id", F.size(m).cast("long").alias("turns"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), F.sha2(F.array_join(F.transform(m, lambda x: x["content"]), "\n"), 256).alias("digest")
    )


@query(
    """SELECT conv_id, turn, prompt, reply FROM (SELECT conv_id, turn, role, text AS prompt, lead(role) OVER w AS r2, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r2 = 'assistant'"""
)
def conversation_pairs(t: Tables):
    return r.exchange_pairs(t.conversations)


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) WHERE used <= 2000")
def conversation_fit(t: Tables):
    return r.fit_recent(t.conversations, 2000)


@query(
    """WITH a AS (SELECT item_id, list_transform(list_filter(string_split(substr(text, 1, 65), ''), lambda x: x <> ''), lambda x: unicode(x)) AS ids FROM benchmark),
b AS (SELECT item_id, ids[:len(ids) - 1] AS x, ids[2:] AS y FROM a)
SELECT item_id, array_to_string(list_concat(x, list_transform(range(0, 64 - len(x)), lambda i: 0)), ' ') AS input, array_to_string(list_concat(y, list_transform(range(0, 64 - len(y)), lambda i: -100)), ' ') AS target FROM b"""
)
def pack_rows_pad_mask(t: Tables):
    ids = F.transform(F.filter(F.split(F.substring("text", 1, 65), ""), lambda x: x != ""), lambda x: F.expr("0") + _code(x))
    p = r.padded(ids, 64)
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return t.benchmark.select("item_id", p.alias("p")).select("item_id", join(F.col("p.input")).alias("input"), join(F.col("p.target")).alias("target"))


def _code(x):
    """The code point of a one-character text."""
    return F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("int")


@query("SELECT sum(length(text)) / sum(len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS chars_per_token FROM documents")
def chars_per_token(t: Tables):
    from ..functions.text import alnum_words

    return t.documents.agg((F.sum(F.char_length("text")) / F.sum(F.size(alnum_words("text")))).alias("chars_per_token"))


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 200000")
def prefix_by_budget(t: Tables):
    """Documents in id order until a budget is reached."""
    d = t.documents.select("doc_id", "n_chars")
    return sum_before(d, "doc_id", F.col("n_chars"), ["doc_id"]).where("before < 200000").select("doc_id", "n_chars")
