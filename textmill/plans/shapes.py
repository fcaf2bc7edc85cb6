"""Table functions, drawn inputs, twins, numbers, budgets and reachable sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans
from ..functions.hashing import sha256
from ..functions.text import word_tokens
from ..functions.udtfs import Elements, lateral
from ..operators import draws, retrieval, subset, twins
from .registry import Tables, query


@query(
    r"""WITH e AS (SELECT page_id, regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS p FROM pages)
SELECT page_id, CAST(i AS INTEGER) AS place, length(p[i]) AS chars, sha256(p[i]) AS digest FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM e)"""
)
def page_elements(t: Tables):
    """The paragraphs of every page, by a lateral table function."""
    rows = lateral(t.pages.select("page_id", "html"), Elements, "html", F.lit("p"), F.lit("place,text,chars"), keep=["page_id"])
    return rows.select("page_id", "place", "chars", sha256("text").alias("digest"))


U = "CAST('0x' || substr(sha256('7:' || conv_id || '-' || turn || ':' || draw || ':' || {}), 1, 13) AS BIGINT)"
TOP = "greatest(3, len(w) + 2)"
N = f"""CASE WHEN larger AND {U.format("'pick'")} < {round(draws.LARGER * 16**13)} THEN CASE WHEN {U.format("'reach'")} < {round(draws.FAR * 16**13)}
 THEN greatest(28, {TOP} + 1) + {U.format("'size'")} % (greatest(40, {TOP} + 12) - greatest(28, {TOP} + 1) + 1) ELSE {TOP} + 1 + {U.format("'size'")} % (greatest({TOP} * 3, 12) - {TOP}) END ELSE {U.format("'size'")} % ({TOP} + 1) END"""


@query(
    f"""WITH s AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[^ \n]+'), lambda x: length(x)) AS w FROM conversations), d AS (SELECT *, unnest([1, 2, 3]) AS draw FROM s), e AS (SELECT *, unnest([false, true]) AS larger FROM d),
n AS (SELECT *, {N} AS n, CASE WHEN len(w) > 0 THEN list_min(w) - 2 ELSE -6 END AS lo, CASE WHEN len(w) > 0 THEN list_max(w) + 2 ELSE 6 END AS hi FROM e),
v AS (SELECT *, list_transform(range(1, n + 1), lambda i: lo + {U.format('i')} % (hi - lo + 1)) AS v FROM n)
SELECT conv_id, turn, draw, larger, CASE WHEN len(v) = 0 THEN '' ELSE array_to_string(CASE WHEN len(w) > 0 AND list_sort(w) = w THEN list_sort(v) ELSE v END, ',') END AS value FROM v"""
)
def drawn_inputs(t: Tables):
    """For each turn, three inputs in the shape of its word lengths, and three of which most are larger."""
    key = F.concat_ws("-", "conv_id", "turn")
    samples = t.conversations.select(key.alias("key"), F.transform(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0)), lambda x: F.char_length(x).cast("long")).alias("w"))
    both = [draws.drawn(samples, "key", "w", "seq", 3, 7, larger).withColumn("larger", F.lit(larger)) for larger in (False, True)]
    part = F.split("key", "-")
    value = F.array_join(F.transform("value", lambda x: x.cast("string")), ",")
    return both[0].unionByName(both[1]).select(F.get(part, F.lit(0)).cast("long").alias("conv_id"), F.get(part, F.lit(1)).cast("long").alias("turn"), "draw", "larger", value.alias("value"))


@query(
    """WITH a AS (SELECT user_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS draw, max(props) AS answer FROM events WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT user_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS draw, max(props) AS answer FROM events WHERE event_type = 'view' GROUP BY 1, 2),
p AS (SELECT user_id, draw, a.answer AS mine, b.answer AS theirs FROM a FULL JOIN b USING (user_id, draw)),
s AS (SELECT user_id, count(*) AS draws, count(*) FILTER (mine IS NOT NULL AND theirs IS NOT NULL) AS answered_by_both, count(*) FILTER (mine = theirs) AS agreed, count(*) FILTER (mine <> theirs) AS differed, count(*) FILTER (mine IS NULL) AS program_silent,
 count(*) FILTER (mine IS NOT NULL AND theirs IS NULL) AS reference_silent, min(draw) FILTER (mine <> theirs) AS witness FROM p GROUP BY user_id),
v AS (SELECT *, CASE WHEN differed > 0 THEN round(differed / answered_by_both, 4) END AS differ_fraction, CASE WHEN answered_by_both = 0 THEN 'no draw answered by both' WHEN differed = 0 THEN 'agrees' WHEN differed / answered_by_both < 0.1 THEN 'near twin' ELSE 'differs' END AS verdict FROM s)
SELECT *, verdict <> 'differs' AS twin FROM v"""
)
def twin_audit(t: Tables):
    """Two kinds of a user's events as two programs, hours as draws, props as answers."""
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    arm = lambda kind: t.events.where(F.col("event_type") == kind).groupBy("user_id", hour.alias("draw")).agg(F.max("props").alias("answer"))
    return twins.verdicts(twins.pair_answers(arm("click"), arm("view"), ["user_id"], "draw", "answer"), ["user_id"], "draw")


SPACED_SQL = r"[\p{L}\p{N}_]+(?:[.,''’:/-][\p{L}\p{N}_]+)*"


def _full(pattern: str) -> str:
    return f"regexp_full_match(x, '{pattern.strip('^$')}')"


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{SPACED_SQL}'), lambda x: regexp_full_match(x, '[0-9](?:[0-9.,]*[0-9])?')) AS p FROM documents),
c AS (SELECT doc_id, p, len(list_filter(p, lambda x: {_full(spans.SURELY_ENGLISH)})) > 0 AS e, len(list_filter(p, lambda x: {_full(spans.SURELY_CONTINENTAL)})) > 0 AS c FROM p),
v AS (SELECT doc_id, CASE WHEN e AND c THEN 'mixed' WHEN c THEN 'continental' ELSE 'english' END AS convention, unnest(p) AS x FROM c),
r AS (SELECT doc_id, convention, CASE WHEN {_full(spans.ENGLISH)} THEN TRY_CAST(replace(x, ',', '') AS DECIMAL(38, 10)) END AS e, CASE WHEN {_full(spans.CONTINENTAL)} THEN TRY_CAST(replace(replace(x, '.', ''), ',', '.') AS DECIMAL(38, 10)) END AS c FROM v),
z AS (SELECT doc_id, convention, e, c, CASE WHEN e IS NULL AND c IS NULL THEN 'unreadable' WHEN e <> c AND convention = 'mixed' THEN 'two readings' END AS refused FROM r)
SELECT doc_id, convention, count(*) AS numbers, count(refused) AS refused, CAST(round(sum(CASE WHEN refused IS NULL THEN CASE WHEN e IS NULL OR (convention = 'continental' AND c IS NOT NULL) THEN c ELSE e END END), 4) AS DOUBLE) AS total FROM z GROUP BY ALL"""
)
def document_numbers(t: Tables):
    """How each document with numbers writes them, from all of them, and its numbers read that way."""
    rows = t.documents.select("doc_id", spans.number_pieces("text").alias("p")).where("size(p) > 0")
    rows = rows.select("doc_id", spans.number_convention(F.col("p")).alias("convention"), "p")
    read = rows.select("doc_id", "convention", F.transform("p", lambda x: spans.read_number(x, F.col("convention"))).alias("r"))
    total = F.aggregate(F.filter("r", lambda r: r["value"].isNotNull()), F.lit(0).cast("decimal(38,10)"), lambda s, r: (s + r["value"]).cast("decimal(38,10)"))
    some = F.exists("r", lambda r: r["value"].isNotNull())
    refused = F.size(F.filter("r", lambda r: r["refused"].isNotNull()))
    return read.select("doc_id", "convention", F.size("r").cast("long").alias("numbers"), refused.cast("long").alias("refused"), F.when(some, F.round(total, 4).cast("double")).alias("total"))


LINE_SQL = "concat_ws(' ', event_type, props)"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS a, CASE WHEN event_type = 'signup' THEN epoch_us(ts) / 1e6 ELSE -value END AS b, strlen({LINE_SQL}) AS n FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, b, event_id) AS k FROM e), f AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST({300 - 3 - 9} AS BIGINT) AS room, CAST(NULL AS BIGINT) AS event_id, false AS took FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT f.user_id, o.k, CASE WHEN o.n + 1 <= room THEN room - o.n - 1 ELSE room END, o.event_id, o.n + 1 <= room FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS INTEGER) AS place FROM f WHERE took"""
)
def memory_recall(t: Tables):
    """What 300 bytes recall of each user's events: signups as notes, the oldest first, then the others by value."""
    kind = F.when(F.col("event_type") == "signup", "note").otherwise("event")
    created = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = t.events.select("user_id", "event_id", kind.alias("kind"), created.alias("created"), "value", F.concat_ws(" ", "event_type", "props").alias("line"))
    return retrieval.memory_recall(rows, "user_id", "event_id", "kind", "created", "value", "line", "# records", 300)


@query(
    r"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS para, unnest(l) AS text FROM l), w AS (SELECT doc_id, para, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM p),
z AS (SELECT doc_id, count(*) AS n, avg(len(w)) AS avgdl FROM w GROUP BY 1), q AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_]+'))) AS term FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents) JOIN benchmark b USING (item_id)),
tf AS (SELECT doc_id, para, term, dl, count(*) AS tf FROM (SELECT doc_id, para, len(w) AS dl, unnest(w) AS term FROM w) JOIN q USING (doc_id, term) GROUP BY ALL), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT doc_id, para, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (doc_id, term) JOIN z USING (doc_id) GROUP BY ALL),
o AS (SELECT doc_id, para, least(length(text), 400) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, para) AS k FROM s JOIN p USING (doc_id, para) WHERE score > 0),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(NULL AS INTEGER) AS para, false AS took FROM (SELECT DISTINCT doc_id FROM o)
 UNION ALL SELECT f.doc_id, o.k, CASE WHEN used < 360 AND used + size <= 400 THEN used + size ELSE used END, o.para, used < 360 AND used + size <= 400 FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1)
SELECT doc_id, para, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para) AS INTEGER) AS given FROM f WHERE took"""
)
def page_passages(t: Tables):
    """The lines of each document that answer its benchmark question best within 400 characters, in the document's order."""
    paras = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para", "text"))
    n = t.benchmark.agg(F.count(F.lit(1)).alias("n"))
    ids = t.documents.select("doc_id").crossJoin(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"))  # the count is one row
    asked = ids.join(t.benchmark, "item_id").select("doc_id", F.explode(F.array_distinct(word_tokens("text"))).alias("term"))
    scores = retrieval.page_scores(paras, asked, "doc_id", "para")
    return retrieval.page_pick(scores, paras, "doc_id", "para", 400)


@query()
def reachable_share(t: Tables):
    """The share nearest below a tenth of all characters that some set of whole documents makes up."""
    return subset.best_share(t.documents, "n_chars", 0.1)
