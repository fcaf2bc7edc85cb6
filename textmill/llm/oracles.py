"""SQL (DuckDB) for the queries whose whole result SQL can express."""

from __future__ import annotations

from .sharding import BASE, Node, grown_tree

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spaces between words, for RE2.
GAP = r"[\x20\x09-\x0D]+"


def _draw(node: Node) -> str:
    return f"(-ln((('0x' || substr(md5('{node.name}:' || key), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {node.weight!r})"


def _descend(node: Node) -> str:
    if node.shard >= 0:
        return str(node.shard)
    if len(node.children) == 1:
        return _descend(node.children[0])
    least = f"least({', '.join(map(_draw, node.children))})"
    cases = " ".join(f"WHEN {_draw(c)} = {least} THEN {_descend(c)}" for c in node.children[:-1])
    return f"CASE {cases} ELSE {_descend(node.children[-1])} END"


SHARDS = f"""WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, encode(coalesce(text, '')) AS b FROM documents),
x AS (SELECT doc_id, key, octet_length(b) + 1 AS size, list_prepend(4294967295, list_transform(range(0, octet_length(b)), lambda i: CAST('0x' || substr(hex(b), 2 * i + 1, 2) AS BIGINT))) AS bytes FROM d),
c AS (SELECT doc_id, key, size, xor(list_reduce(bytes, lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM x, t),
s AS (SELECT doc_id, size, text_crc32, CAST({_descend(grown_tree(BASE))} AS INTEGER) AS shard, CAST({_descend(grown_tree(BASE + 1))} AS INTEGER) AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', doc_id, size, text_crc32)), 1, 3), doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s"""

REPEATS = f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{GAP}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + k AS pos FROM g JOIN f USING (h), range(0, 50) r(k) WHERE least < doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM w ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i + 1, i + 5), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * s >= 75 * (x.n + y.n - s)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

#: Runs by their definition. Periods up to 8 are tried everywhere; a longer one is tried in a document where some 16 words
#: without a period up to 8 stand twice at that distance, as in every run of such a period. Of the stretches that several periods
#: give, the least period counts.
RUNS = f"""WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, encode(CAST(doc_id AS VARCHAR)) AS b, list_filter(regexp_split_to_array(coalesce(text, ''), '{GAP}'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, w, len(w) AS n, list_prepend(4294967295, list_transform(range(0, octet_length(b)), lambda i: CAST('0x' || substr(hex(b), 2 * i + 1, 2) AS BIGINT))) AS bytes FROM d),
h AS (SELECT doc_id, w, n, xor(list_reduce(bytes, lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) AS h FROM x, t),
g AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS changed, h // 10 AS g FROM h),
a AS (SELECT doc_id, w, n, changed, CASE WHEN changed THEN g % n END AS a, CASE WHEN changed THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
m AS (SELECT doc_id, n, CASE WHEN changed THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM a),
e AS (SELECT doc_id, unnest(w) AS word, CAST(unnest(range(0, n)) AS INTEGER) AS i FROM m),
k AS (SELECT doc_id, CAST(i AS INTEGER) AS i, list_slice(w, i + 1, i + 16) AS s FROM (SELECT doc_id, w, unnest(range(0, n - 15)) AS i FROM m WHERE n >= 24)),
r AS (SELECT doc_id, i, md5(array_to_string(s, ' ')) AS x FROM k WHERE len(list_filter(range(1, 9), lambda d: list_slice(s, 1, 16 - d) = list_slice(s, d + 1, 16))) = 0),
q AS (SELECT DISTINCT r.doc_id, b.i - r.i AS q FROM r JOIN r b ON r.doc_id = b.doc_id AND r.x = b.x AND b.i - r.i > 8 JOIN m ON m.doc_id = r.doc_id AND (b.i - r.i) * 3 <= n UNION SELECT doc_id, CAST(unnest(range(1, 9)) AS INTEGER) FROM m WHERE n >= 24),
s AS (SELECT q.doc_id, q, y.i, y.i - row_number() OVER (PARTITION BY q.doc_id, q ORDER BY y.i) AS isle FROM q JOIN e y ON y.doc_id = q.doc_id JOIN e z ON z.doc_id = y.doc_id AND z.i = y.i + q AND z.word = y.word),
l AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(24, 3 * q)),
u AS (SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(min(q) AS BIGINT) AS period FROM l GROUP BY doc_id, start, length),
v AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY doc_id),
f AS (SELECT DISTINCT ON (doc_id) doc_id, start, length, period FROM u ORDER BY doc_id, CAST(length AS HUGEINT) * 1000000000000 // period DESC, start, period),
c AS (SELECT DISTINCT doc_id, CAST(unnest(range(start + period, start + length)) AS INTEGER) AS i FROM u),
o AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN v USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN o USING (doc_id)"""
