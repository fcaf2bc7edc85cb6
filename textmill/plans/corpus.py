"""Deduplication, splits, leakage and decontamination over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import fold, sample_order, sha256
from ..functions.text import alnum_words, ngrams, spdx_ids
from ..operators import chars, dedup, leakage, rows
from .registry import Tables, query

WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
GRAMS = f"""
grams AS (SELECT item_id, array_to_string(list_slice(w, i + 1, i + 13), ' ') AS gram
  FROM (SELECT item_id, {WORDS} AS w FROM benchmark), range(0, 100000) r(i) WHERE i <= len(w) - 13),
owners AS (SELECT gram, list_sort(list_distinct(list(item_id))) AS owners FROM grams GROUP BY gram),
spots AS (SELECT doc_id, unnest(range(0, len(w) - 12)) AS pos, w FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= 13),
texts AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos + 1, pos + 13), ' ') AS gram FROM spots),
hits AS (SELECT doc_id, pos, gram, owners FROM texts JOIN owners USING (gram)),
firsts AS (SELECT doc_id, arg_min(pos, pos) AS pos, arg_min(gram, pos) AS gram, arg_min(owners, pos) AS owners FROM hits GROUP BY doc_id)"""


@query(f"WITH {GRAMS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, gram, array_to_string(owners, ',') AS owners FROM firsts")
def ngram_first_match(t: Tables):
    m = leakage.first_matches(t.documents, t.benchmark)
    return m.select("doc_id", "pos", "gram", F.array_join(F.transform("owners", lambda x: x.cast("string")), ",").alias("owners"))


@query(f"WITH {GRAMS} SELECT doc_id FROM firsts")
def ngram_decontam_flagged(t: Tables):
    return leakage.first_matches(t.documents, t.benchmark).select("doc_id")


@query(f"WITH {GRAMS} SELECT source, count(*) AS documents, count(pos) AS contaminated FROM documents LEFT JOIN firsts USING (doc_id) GROUP BY source")
def ngram_decontam_report(t: Tables):
    hit = leakage.first_matches(t.documents, t.benchmark).select("doc_id", F.lit(1).alias("hit"))
    return t.documents.select("doc_id", "source").join(hit, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("hit").alias("contaminated"))


@query(f"WITH {GRAMS} SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM firsts)")
def decontam_kept(t: Tables):
    return t.documents.select("doc_id", "n_chars").join(leakage.first_matches(t.documents, t.benchmark).select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {GRAMS} SELECT item_id, count(DISTINCT gram) AS grams FROM grams GROUP BY item_id")
def benchmark_gram_counts(t: Tables):
    return t.benchmark.select("item_id", F.explode(F.array_distinct(ngrams(alnum_words("text"), 13))).alias("g")).groupBy("item_id").agg(F.count(F.lit(1)).alias("grams"))


@query("SELECT sha1(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def exact_dedup_first(t: Tables):
    return dedup.exact_first(t.documents)


@query(r"SELECT sha1(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def normalized_dedup(t: Tables):
    return dedup.exact_first(t.documents, "stripped")


NORM = r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(
    f"""WITH r AS (SELECT doc_id, sha256(text) AS sha, sha256({NORM}) AS norm FROM documents),
k AS (SELECT norm, min(doc_id) AS kept, arg_min(sha, doc_id) AS ksha FROM r GROUP BY norm)
SELECT doc_id, kept AS duplicate_of, CASE WHEN sha = ksha THEN 'exact' ELSE 'normalized' END AS reason FROM r JOIN k USING (norm) WHERE doc_id > kept"""
)
def duplicate_of(t: Tables):
    return dedup.duplicate_of(t.documents)


@query(
    """SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS records, count(*) FILTER (s > 1) AS across, count(*) FILTER (s = 1) AS within
FROM (SELECT count(*) AS n, count(DISTINCT source) AS s FROM documents GROUP BY text) WHERE n > 1"""
)
def dedup_group_report(t: Tables):
    return dedup.group_report(t.documents)


@query(
    """WITH h AS (SELECT DISTINCT text, source FROM documents)
SELECT a.source AS a, b.source AS b, count(*) AS shared FROM h a JOIN h b ON a.text = b.text AND a.source < b.source GROUP BY 1, 2"""
)
def cross_source_pairs(t: Tables):
    return dedup.source_pairs(t.documents)


STATEMENT = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""SELECT doc_id, item_id FROM (SELECT doc_id, {STATEMENT} AS k FROM documents) JOIN (SELECT item_id, {STATEMENT} AS k FROM benchmark) USING (k) WHERE length(k) >= 24"""
)
def statement_contamination(t: Tables):
    return leakage.statement_contamination(t.documents, t.benchmark)


STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
LIMIT16 = f"{-(-16**16 // 10):016x}"
SPLIT = f"(SELECT doc_id, CASE WHEN substr(sha256('split' || chr(0) || '1337' || chr(0) || {STRIP}), 1, 16) < '{LIMIT16}' THEN 'val' ELSE 'train' END AS split FROM documents)"


@query(SPLIT[1:-1])
def hash_holdout_split(t: Tables):
    return dedup.hash_split(t.documents)


LIMIT64 = f"{-(-16**64 // 10):064x}"


@query(f"SELECT doc_id, source, CASE WHEN sha256(source || ':' || lang) < '{LIMIT64}' THEN 'val' ELSE 'train' END AS split FROM documents")
def group_split(t: Tables):
    return dedup.family_split(t.documents.select("doc_id", "source", "lang"), F.concat_ws(":", "source", "lang")).drop("lang")


@query(
    f"""SELECT CAST(coalesce(sum(length(text)) FILTER (split = 'val'), 0) AS BIGINT) AS val_chars, CAST(sum(length(text)) AS BIGINT) AS chars,
round(coalesce(sum(length(text)) FILTER (split = 'val'), 0) / sum(length(text)), 6) AS reached,
CASE WHEN coalesce(sum(length(text)) FILTER (split = 'val'), 0) / sum(length(text)) >= 0.08 THEN 'healthy' WHEN max(length(text)) > 0.1 * sum(length(text)) THEN 'corpus' ELSE 'splitter' END AS verdict
FROM documents JOIN {SPLIT} USING (doc_id)"""
)
def split_health(t: Tables):
    return dedup.split_health(dedup.hash_split(t.documents), t.documents)


@query(
    """WITH r AS (SELECT doc_id, length(text) AS n, sha256('1337:' || doc_id) AS o FROM documents),
s AS (SELECT doc_id, sum(n) OVER (ORDER BY o) AS run, sum(n) OVER () AS total FROM r) SELECT doc_id, CASE WHEN run <= total * 0.1 THEN 'val' ELSE 'train' END AS split FROM s"""
)
def order_split(t: Tables):
    return dedup.greedy_split(t.documents.select("doc_id", F.char_length("text").alias("n")), 0.1)


@query(
    """WITH RECURSIVE r AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY sha256('1337:' || doc_id)) AS k FROM documents), z AS (SELECT sum(n) * 0.1 AS target FROM r),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS HUGEINT) AS used, CAST(NULL AS BIGINT) AS doc_id, false AS val UNION ALL SELECT r.k, CASE WHEN used + n <= target THEN used + n ELSE used END, r.doc_id, used + n <= target FROM f JOIN r ON r.k = f.k + 1, z)
SELECT doc_id, CASE WHEN val THEN 'val' ELSE 'train' END AS split FROM f WHERE k > 0"""
)
def filled_split(t: Tables):
    """Documents that do not fit the validation side are passed over, and later ones that do are taken."""
    return dedup.filled_split(t.documents.select("doc_id", F.char_length("text").alias("n")), 0.1)


@query("SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UHUGEINT % 5 AS INTEGER) AS fold FROM documents")
def fold_assign(t: Tables):
    return t.documents.select("doc_id", fold(F.col("doc_id").cast("string"), 5).alias("fold"))


@query("SELECT doc_id FROM documents ORDER BY sha256('17:' || doc_id) LIMIT 50")
def hash_sample_topk(t: Tables):
    return t.documents.select("doc_id").orderBy(sample_order("doc_id", 17)).limit(50)


@query(
    f"""WITH s AS {SPLIT}, r AS (SELECT split, {STRIP} AS x FROM documents JOIN s USING (doc_id))
SELECT count(*) AS documents, count(*) FILTER (x IN (SELECT x FROM r WHERE split = 'train')) AS shared FROM r WHERE split = 'val'"""
)
def split_overlap_docs(t: Tables):
    return leakage.document_overlap(dedup.hash_split_rows(t.documents))


LINES = rf"""s AS {SPLIT}, lines AS (SELECT split, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c]')) AS l FROM documents JOIN s USING (doc_id))"""
LINE_COUNTS = r"SELECT count(*) AS lines, count(*) FILTER (l IN (SELECT l FROM lines WHERE split = 'train')) AS shared FROM lines WHERE split = 'val' AND NOT regexp_full_match(l, '\s*')"


@query(f"WITH {LINES} {LINE_COUNTS}")
def split_overlap_lines(t: Tables):
    return leakage.line_overlap(dedup.hash_split_rows(t.documents))


# md5 instead of blake2b, which SQL doesn't have; grams are byte ranges, here of the hexadecimal text
PRINTS = """b AS (SELECT doc_id, split, hex(encode(text)) AS x, length(text) AS n, strlen(text) AS m FROM documents JOIN s USING (doc_id)),
h AS (SELECT doc_id, split, i, substr(md5(unhex(substr(x, CAST(2 * i + 1 AS BIGINT), 100))), 1, 16) AS h, m - 49 AS grams FROM b, LATERAL (SELECT unnest(range(0, m - 49)) AS i) WHERE n >= 50),
w AS (SELECT split, i, grams, min(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS least, h FROM h),
prints AS (SELECT DISTINCT split, least AS h FROM w WHERE grams >= 25 AND i <= grams - 25 UNION SELECT split, h FROM w WHERE grams < 25
 UNION SELECT split, substr(md5(unhex(x)), 1, 16) FROM b JOIN documents d USING (doc_id) WHERE n < 50 AND NOT regexp_full_match(d.text, '\\s*')),
p AS (SELECT count(*) AS n, count(*) FILTER (h IN (SELECT h FROM prints WHERE split = 'train')) AS h FROM prints WHERE split = 'val')"""


@query(
    f"""WITH {LINES}, c AS ({LINE_COUNTS}), {PRINTS}, x AS (SELECT split, {STRIP} AS x FROM documents JOIN s USING (doc_id)),
d AS (SELECT count(*) AS n, count(*) FILTER (x IN (SELECT x FROM x WHERE split = 'train')) AS h FROM x WHERE split = 'val'),
v AS (SELECT p.h / greatest(p.n, 1) AS cs, d.h / greatest(d.n, 1) AS ds, shared / greatest(lines, 1) AS ls, lines FROM p, c, d),
a AS (SELECT *, CASE WHEN cs >= .2 THEN 2 WHEN cs >= .05 THEN 1 ELSE 0 END AS ca, CASE WHEN ds >= .1 THEN 2 WHEN ds >= .01 THEN 1 ELSE 0 END AS da,
  CASE WHEN NOT (lines >= 20 OR (lines >= 3 AND ls >= .9)) THEN 0 WHEN ls >= .9 THEN 2 WHEN ls >= .5 THEN 1 ELSE 0 END AS la FROM v),
z AS (SELECT *, greatest(ca, da, la) AS level FROM a)
SELECT round(cs, 6) AS content_share, round(ds, 6) AS document_share, round(ls, 6) AS line_share, CASE level WHEN 2 THEN 'CONTAMINATED' WHEN 1 THEN 'SUSPECT' ELSE 'CLEAN' END AS verdict,
array_to_string(list_filter([CASE WHEN ca = level AND level > 0 THEN 'content' END, CASE WHEN da = level AND level > 0 THEN 'document' END, CASE WHEN la = level AND level > 0 THEN 'line' END], lambda x: x IS NOT NULL), ',') AS reason FROM z"""
)
def leakage_verdict(t: Tables):
    r = dedup.hash_split_rows(t.documents)
    return leakage.verdict(leakage.content_overlap(r, "md5"), leakage.document_overlap(r), leakage.line_overlap(r))


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def vocab_report(t: Tables):
    return chars.counts(t.documents, "text")


CHARS = "c AS (SELECT doc_id, string_split(text, '') AS s FROM documents)"


@query(
    f"WITH {CHARS}, n AS (SELECT ch, count(*) AS n FROM (SELECT unnest(s) AS ch FROM c) WHERE ch <> '' GROUP BY ch) SELECT round(-sum(n * ln(n / (SELECT sum(n) FROM n))) / sum(n) / ln(2), 6) AS bits FROM n"
)
def char_entropy_unigram(t: Tables):
    n = vocab_report(t)
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).agg(F.round(-F.sum(F.col("n") * F.ln(F.col("n") / F.col("total"))) / F.sum("n") / F.ln(F.lit(2.0)), 6).alias("bits"))


@query(
    """WITH g AS (SELECT substr(text, CAST(i AS BIGINT), 3) AS g FROM documents, range(1, 200000) r(i) WHERE i <= length(text) - 2),
n AS (SELECT g, count(*) AS n FROM g GROUP BY g), p AS (SELECT substr(g, 1, 2) AS p, sum(n) AS m FROM n GROUP BY 1),
v AS (SELECT count(DISTINCT substr(g, 3, 1)) AS v FROM n)
SELECT round(-sum(n * ln((n + 1) / (m + v))) / sum(n) / ln(2), 6) AS bits FROM n JOIN p ON substr(g, 1, 2) = p, v"""
)
def char_entropy_trigram(t: Tables):
    n = chars.trigram_counts(t.documents, "text")  # a, b, c, n: counted by tasks, then summed
    ctx = n.groupBy("a", "b").agg(F.sum("n").alias("m"))
    v = n.agg(F.countDistinct("c").alias("v"))
    rows_ = n.join(ctx, ["a", "b"]).crossJoin(F.broadcast(v))
    return rows_.agg(F.round(-F.sum(F.col("n") * F.ln((F.col("n") + 1) / (F.col("m") + F.col("v")))) / F.sum("n") / F.ln(F.lit(2.0)), 6).alias("bits"))


@query(
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)licen[cs]e[d]?\s+([A-Za-z0-9.+-]+)', 1))), ',') AS terms,
len(regexp_extract_all(text, 'SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)', 1)) AS spdx FROM documents"""
)
def licence_terms(t: Tables):
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)licen[cs]e[d]?\s+([A-Za-z0-9.+-]+)"), F.lit(1))))
    return t.documents.select("doc_id", F.array_join(terms, ",").alias("terms"), F.size(spdx_ids("text")).cast("long").alias("spdx"))


#: Markers of generated files and names of benchmarks that must not be trained on.
GENERATED = r"(?i)(auto-?generated|generated by|do not edit)"
BENCHMARKS = r"(?i)(human[_-]?eval|mbpp|code[_-]?contests|apps)"


@query(
    rf"""SELECT doc_id, regexp_matches(array_to_string(list_slice(string_split(text, chr(10)), 1, 80), chr(10)), '{GENERATED}') AS generated,
regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(human[_-]?eval|mbpp|code[_-]?contests|apps)($|[^A-Za-z0-9])') AS benchmark FROM documents"""
)
def header_screens(t: Tables):
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 80), "\n")
    return t.documents.select("doc_id", head.rlike(GENERATED).alias("generated"), F.col("text").rlike(rf"(?<![A-Za-z0-9]){BENCHMARKS}(?![A-Za-z0-9])").alias("benchmark"))


GATES = """CASE WHEN n_chars < 200 THEN 'too short' WHEN n_chars > 20000 THEN 'too long' WHEN lang NOT IN ('en', 'de') THEN 'language'
WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'address' END"""


def _gates():
    return rows.first_reason(
        [("too short", F.col("n_chars") < 200), ("too long", F.col("n_chars") > 20000), ("language", ~F.col("lang").isin("en", "de")), ("address", F.col("text").rlike("[A-Za-z0-9._]+@[A-Za-z0-9.]+"))]
    )


@query(f"SELECT doc_id, {GATES} AS reason FROM documents")
def gate_reasons(t: Tables):
    return t.documents.select("doc_id", _gates().alias("reason"))


@query(f"SELECT coalesce({GATES}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def gate_tally(t: Tables):
    return t.documents.select(F.coalesce(_gates(), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(text) AS sha, sha1(text) AS sha1, substr(sha1(text), 1, 12) AS short, strlen(text) AS bytes, length(text) AS chars, len(string_split(text, chr(10))) AS lines FROM documents")
def provenance_digests(t: Tables):
    return t.documents.select(
        "doc_id", sha256("text").alias("sha"), F.sha1("text").alias("sha1"), F.substring(F.sha1("text"), 1, 12).alias("short"),
        F.octet_length("text").cast("long").alias("bytes"), F.char_length("text").cast("long").alias("chars"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"),
    )


@query(
    f"""WITH {GRAMS} SELECT split, count(*) AS documents, count(pos) AS contaminated, round(count(pos) / count(*), 6) AS share
FROM {SPLIT} LEFT JOIN firsts USING (doc_id) GROUP BY split"""
)
def contamination_by_split(t: Tables):
    hit = leakage.first_matches(t.documents, t.benchmark).select("doc_id", F.lit(1).alias("hit"))
    r = dedup.hash_split(t.documents).join(hit, "doc_id", "left")
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.count("hit").alias("contaminated"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("share"))


@query(
    """WITH s AS (SELECT doc_id FROM labels WHERE toxic = 1), r AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM s))
SELECT doc_id FROM s UNION SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT h FROM r)"""
)
def family_closure(t: Tables):
    return rows.family_closure(t.documents.select("doc_id", sha256("text").alias("h")), t.labels.where("toxic = 1"), "doc_id", "h")
