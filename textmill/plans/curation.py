"""Curation and report queries: norms, checks, sweeps, distinctness, tiers, shapes, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import alnum_words, word_tokens
from ..operators import dedup, retrieval
from ..operators.chars import counts
from ..operators.ordered import ranked, sum_before
from ..session import spread
from .registry import Tables, query

NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({NORM}) AS answer_norm, sha256(regexp_replace(text, '[[:cntrl:]]', '', 'g')) AS clean, CASE WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END AS cut FROM documents")
def text_norms(t: Tables):
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", " "), r"\b(a|an|the)\b", " "), r"\s+", " "))
    cut = F.when(F.char_length("text") > 500, F.concat(F.substring("text", 1, 497), F.lit("..."))).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.sha2(norm, 256).alias("answer_norm"), F.sha2(F.regexp_replace("text", r"[\x00-\x1F\x7F]", ""), 256).alias("clean"), cut.alias("cut"))


@query(
    """WITH p AS (SELECT a.conv_id, a.turn, a.text AS claim, b.text AS source FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, trim(regexp_replace(claim, '\\s+', ' ', 'g')) <> '' AND contains(regexp_replace(source, '\\s+', ' ', 'g'), trim(regexp_replace(claim, '\\s+', ' ', 'g'))) AS quoted,
len(list_filter(list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]+')), lambda w: NOT list_contains(regexp_extract_all(lower(source), '[a-z0-9]+'), w))) AS unsupported FROM p"""
)
def quote_check(t: Tables):
    c = t.conversations
    p = c.select("conv_id", "turn", F.col("text").alias("claim")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("source")), ["conv_id", "turn"])
    squeeze = lambda x: F.regexp_replace(x, r"\s+", " ")
    whole = F.trim(squeeze(F.col("claim")))
    return p.select(
        "conv_id", "turn", ((whole != "") & F.contains(squeeze(F.col("source")), whole)).alias("quoted"), F.size(F.array_except(alnum_words("claim"), alnum_words("source"))).cast("long").alias("unsupported")
    )


@query(
    """SELECT CAST(th AS DOUBLE) AS threshold, count(*) FILTER (n_chars / 1000.0 >= th AND quality = 1) AS shown_good, count(*) FILTER (n_chars / 1000.0 >= th AND quality = 0) AS shown_poor, count(*) FILTER (n_chars / 1000.0 < th) AS hidden
FROM documents JOIN labels USING (doc_id), (VALUES (0.25), (0.5), (1.0), (2.0), (4.0)) v(th) GROUP BY th"""
)
def threshold_sweep(t: Tables):
    """One pass: the thresholds are a literal array, not a join partner of every row."""
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").groupBy("n_chars", "quality").agg(F.count(F.lit(1)).alias("m"))
    rows = rows.select("n_chars", "quality", "m", F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 1.0, 2.0, 4.0)])).alias("threshold"))
    on = F.col("n_chars") / 1000.0 >= F.col("threshold")
    total = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("m"))), F.lit(0))
    return rows.groupBy("threshold").agg(total(on & (F.col("quality") == 1)).alias("shown_good"), total(on & (F.col("quality") == 0)).alias("shown_poor"), total(~on).alias("hidden"))


@query(
    """SELECT coalesce(lang, 'all') AS kind, count(*) AS rows, count(DISTINCT text) AS texts, count(DISTINCT lower(text)) AS folded, count(DISTINCT source) AS sources FROM documents GROUP BY GROUPING SETS ((lang), ())"""
)
def distinctness_report(t: Tables):
    keyed = t.documents.select("lang", "source", F.sha2("text", 256).alias("x"), F.sha2(F.lower("text"), 256).alias("y"))
    part = lambda d, k: d.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("x").alias("texts"), F.countDistinct("y").alias("folded"), F.countDistinct("source").alias("sources")).select(k.alias("kind"), "rows", "texts", "folded", "sources")
    return part(keyed.groupBy("lang"), F.col("lang")).unionByName(part(keyed.groupBy(), F.lit("all")))


@query("SELECT text_key, copies, doc_ids FROM (SELECT sha256(text) AS text_key, count(*) AS copies, array_to_string(list_sort(list(doc_id))[:10], ',') AS doc_ids FROM documents GROUP BY 1) WHERE copies > 1")
def repeated_targets(t: Tables):
    keyed = t.documents.select("doc_id", F.sha2("text", 256).alias("text_key"))
    # the ten smallest ids of each group, kept small while they are gathered
    ten = lambda x: F.slice(F.array_sort(x), 1, 10)
    part = keyed.groupBy("text_key", F.pmod("doc_id", F.lit(64)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), ten(F.collect_list("doc_id")).alias("d"))
    rows = part.groupBy("text_key").agg(F.sum("n").alias("copies"), ten(F.flatten(F.collect_list("d"))).alias("d")).where("copies > 1")
    return rows.select("text_key", "copies", F.array_join(F.transform("d", lambda x: x.cast("string")), ",").alias("doc_ids"))


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 50.0 END, 1.0), -p_retailprice, p_partkey) AS INTEGER) AS place FROM part")
def weakest_first(t: Tables):
    """A missing strength counts as full; of equal strengths the highest price comes first."""
    strength = F.coalesce(F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 50.0), F.lit(1.0))
    rows = t.part.select("p_partkey", strength.alias("strength"), (-F.col("p_retailprice")).alias("price"))
    return ranked(rows, "strength", ["price", "p_partkey"]).select("p_partkey", F.col("place").cast("int").alias("place"))


@query(
    """SELECT bucket, count(*) AS users FROM (SELECT user_id, CASE WHEN bool_and(value >= 20) THEN 'all' WHEN bool_or(value >= 20) THEN 'some' ELSE 'none' END AS bucket FROM events WHERE event_type <> 'error' GROUP BY 1) GROUP BY 1"""
)
def all_some_none(t: Tables):
    u = t.events.where("event_type <> 'error'").groupBy("user_id").agg(F.bool_and(F.col("value") >= 20).alias("a"), F.bool_or(F.col("value") >= 20).alias("s"))
    return u.groupBy(F.when(F.col("a"), "all").when(F.col("s"), "some").otherwise("none").alias("bucket")).agg(F.count(F.lit(1)).alias("users"))


@query("SELECT source, good, chars FROM (SELECT source, count(*) FILTER (quality = 1) AS good, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY source) ORDER BY good DESC, chars DESC, source LIMIT 1")
def best_step(t: Tables):
    rows = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id")
    return rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("good"), F.sum("n_chars").alias("chars")).orderBy(F.desc("good"), F.desc("chars"), "source").limit(1)


@query("SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN -1.0 WHEN quality = 0 THEN 0.0 WHEN toxic = 1 THEN 0.25 WHEN n_chars >= 1000 THEN 1.0 ELSE 0.5 END::DOUBLE AS reward FROM documents JOIN labels USING (doc_id)")
def reward_tiers(t: Tables):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    q, x = F.col("quality"), F.col("toxic")
    return rows.select("doc_id", F.when((q == 0) & (x == 1), -1.0).when(q == 0, 0.0).when(x == 1, 0.25).when(F.col("n_chars") >= 1000, 1.0).otherwise(0.5).alias("reward"))


@query("SELECT m * 1000000 AS parameters, m * 1000000 * 20 AS tokens_20, m * 1000000 * 192 AS tokens_192 FROM (VALUES (1::BIGINT), (10), (30), (124), (350)) v(m)")
def token_budget_table(t: Tables):
    p = F.col("parameters")
    return t.spark.createDataFrame([(m * 1_000_000,) for m in (1, 10, 30, 124, 350)], "parameters long").select("parameters", (p * 20).alias("tokens_20"), (p * 192).alias("tokens_192"))


@query("SELECT ch, n, n < 10 AS rare FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch) WHERE n < 100")
def rare_chars(t: Tables):
    n = counts(t.documents)
    return n.where("n < 100").select("ch", "n", (F.col("n") < 10).alias("rare"))


@query("SELECT page_id, sha256(CASE WHEN s > 0 AND e > s THEN substr(html, s + 6, e - s - 6) ELSE html END) AS body FROM (SELECT page_id, html, strpos(html, '<body>') AS s, strpos(html, '</body>') AS e FROM pages)")
def boilerplate_strip(t: Tables):
    s, e = F.instr("html", "<body>"), F.instr("html", "</body>")
    body = F.when((s > 0) & (e > s), F.substring(F.col("html"), s + 6, e - s - 6)).otherwise(F.col("html"))
    return t.pages.select("page_id", F.sha2(body, 256).alias("body"))


TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"


@query(
    f"""WITH q AS (SELECT item_id, {TOK.format('text')} AS q FROM benchmark), d AS (SELECT doc_id, {TOK.format("split_part(text, chr(10), 1)")} AS title, {TOK.format("substr(text, length(split_part(text, chr(10), 1)) + 1)")} AS snippet FROM documents),
s AS (SELECT item_id, doc_id, 3 * len(list_intersect(q, title)) + len(list_intersect(q, snippet)) AS score FROM q, d)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0) WHERE k <= 10"""
)
def fixture_search(t: Tables):
    """3 x title overlap + snippet overlap, through the shared terms alone; the first line is the title, all the rest the snippet."""
    first = F.substring_index("text", "\n", 1)
    cut = spread(t.documents.select("doc_id", "text")).select("doc_id", first.alias("title"), F.substring(F.col("text"), F.char_length(first) + 1, F.char_length("text")).alias("snippet"))
    part = lambda c: F.coalesce(F.array_distinct(word_tokens(c)), F.array().cast("array<string>"))
    words = F.concat(*[part("title")] * 3, part("snippet"))  # a word of the title counts three times
    found = retrieval.Postings(cut, t.benchmark, ["doc_id"], "item_id", words=words).best("hits", 10)
    return found.select("item_id", "doc_id", F.col("score").cast("long").alias("score"))


@query(
    """WITH p AS (SELECT a.conv_id, a.turn, lower(b.text) AS reply, list_transform(string_split(lower(a.text), '. '), lambda s: list_filter(regexp_extract_all(s, '[a-z0-9]+'), lambda x: length(x) >= 6)) AS w FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
l AS (SELECT conv_id, turn, reply, list_transform(w, lambda alts: len(list_filter(alts, lambda x: contains(reply, x))) > 0) AS labels FROM p)
SELECT conv_id, turn, array_to_string(list_transform(labels, lambda x: CAST(x AS INTEGER)), ',') AS labels, list_bool_and(labels) AND NOT contains(reply, 'insufficient information') AS "right", contains(reply, 'insufficient information') AS rejected FROM l"""
)
def answer_containment(t: Tables):
    """A label for each part of an answer, here a sentence with its long words as alternatives (any is in the reply): right if all are and the reply does not refuse."""
    c = t.conversations
    parts = F.transform(F.split(F.lower("text"), r"\. "), lambda s: F.filter(F.regexp_extract_all(s, F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.char_length(x) >= 6))
    p = c.select("conv_id", "turn", parts.alias("w")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lower("text").alias("reply")), ["conv_id", "turn"])
    labels = F.transform("w", lambda alts: F.exists(alts, lambda x: F.contains("reply", x)))
    refused = F.contains("reply", F.lit("insufficient information"))
    return p.select("conv_id", "turn", F.array_join(F.transform(labels, lambda x: x.cast("int").cast("string")), ",").alias("labels"), (F.forall(labels, lambda x: x) & ~refused).alias("right"), refused.alias("rejected"))


DIGITS = "list_sum(list_transform(string_split(sha256(CAST(doc_id AS VARCHAR)), ''), lambda c: strpos('0123456789abcdef', c) - 1))"


@query(f"SELECT doc_id, CAST({DIGITS} % 3 AS INTEGER) AS third, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) < 429496730 AS tenth FROM documents")
def digest_thirds(t: Tables):
    """A 256-bit digest mod 3 is the sum of its hex digits mod 3, as 16 = 1 mod 3."""
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    digits = F.aggregate(F.split(h, ""), F.lit(0), lambda s, c: s + F.coalesce(F.conv(F.nullif(c, F.lit("")), 16, 10).cast("int"), F.lit(0)))
    return t.documents.select("doc_id", (digits % 3).alias("third"), (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < 429496730).alias("tenth"))


@query(
    r"""SELECT conv_id, turn, len(w) AS tokens, len(list_filter(w, lambda x: NOT regexp_matches(x, '^[+-]?[0-9]+$'))) = 0 AS all_int FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations)"""
)
def input_shapes(t: Tables):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return t.conversations.select("conv_id", "turn", F.size(w).cast("long").alias("tokens"), F.forall(w, lambda x: x.rlike("^[+-]?[0-9]+$")).alias("all_int"))


@query(
    """WITH g AS (SELECT user_id, list_aggregate(list_sort(list_distinct(list(event_type))), 'string_agg', '+') AS signature, max(value) AS best FROM events GROUP BY 1)
SELECT signature, count(*) AS members, min(user_id) AS first, round(max(best), 4) AS best FROM g GROUP BY 1"""
)
def behaviour_clusters(t: Tables):
    g = t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("signature"), F.max("value").alias("best"))
    return g.groupBy("signature").agg(F.count(F.lit(1)).alias("members"), F.min("user_id").alias("first"), F.round(F.max("best"), 4).alias("best"))


@query(
    """WITH l AS (SELECT a.doc_id, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM documents a JOIN (SELECT text AS t, min(doc_id) AS k, any_value(text) AS text FROM documents GROUP BY t) b ON a.text = b.t)
SELECT doc_id, len(x) AS lines, len(list_filter(range(1, len(x) + 1), lambda i: x[i] = y[i])) AS matched FROM l"""
)
def prefix_lines(t: Tables):
    """Lines that each document shares from the start with the first of its text: all of them."""
    first = dedup.first_per_key(t.documents.select(F.sha2("text", 256).alias("k"), "doc_id", "text"), ["k"], ["doc_id"]).select("k", F.split("text", "\n", -1).alias("y"))
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("k"), F.split("text", "\n", -1).alias("x")).join(first, "k")
    same = F.zip_with("x", "y", lambda a, b: a == b)
    stop = F.array_position(same, F.lit(False))
    return rows.select("doc_id", F.size("x").cast("long").alias("lines"), F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("long").alias("matched"))


@query(
    """WITH c AS (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_chars) OVER () AS total FROM documents)
SELECT doc_id, CASE WHEN before < 0.9 * total THEN 'train' ELSE 'val' END AS split FROM c"""
)
def positional_split(t: Tables):
    d = t.documents.select("doc_id", "n_chars")
    total = F.broadcast(d.agg(F.sum("n_chars").alias("total")))
    return sum_before(d, "doc_id", F.col("n_chars"), ["doc_id"]).crossJoin(total).select("doc_id", F.when(F.col("before") < 0.9 * F.col("total"), "train").otherwise("val").alias("split"))
