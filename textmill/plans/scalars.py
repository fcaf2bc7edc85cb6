"""Scalar libraries: strings, arrays, maps, integers, quantifiers, compiled expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions, numbers, text
from .registry import Tables, query


@query(
    """SELECT p_partkey, len(regexp_split_to_array(trim(p_name), '\\s+')) AS words, strpos(p_name, 'e') - 1 AS first_e, (length(p_name) - length(replace(p_name, 'an', ''))) // 2 AS an,
translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') AS swapped,
upper(p_name[1]) || lower(p_name[2:]) AS capital, starts_with(p_name, 'P') AS p, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded, regexp_matches(p_brand, '^[A-Za-z0-9]+$') AS alnum, rtrim(p_type, 'ERSTD') AS stripped FROM part"""
)
def string_lib(t: Tables):
    n = "p_name"
    return t.part.select(
        "p_partkey", F.size(text.split_words_py(n)).cast("long").alias("words"), text.find(n, "e").cast("long").alias("first_e"), text.count_text(n, "an").cast("long").alias("an"), text.swapcase(n).alias("swapped"),
        text.capitalize(n).alias("capital"), F.startswith(F.col(n), F.lit("P")).alias("p"), text.zfill(F.col("p_size").cast("string"), 5).alias("padded"), text.is_class("p_brand", "alnum").alias("alnum"),
        F.rtrim("p_type", F.lit("ERSTD")).alias("stripped"),
    )


@query(
    """WITH a AS (SELECT o_custkey, list(CAST(o_orderkey % 97 AS BIGINT) ORDER BY o_orderkey) AS a FROM orders GROUP BY 1)
SELECT o_custkey, len(a) AS n, list_sum(a)::BIGINT AS s, list_min(a) AS lo, list_max(a) AS hi, array_to_string(list_sort(a), ',') AS sorted, array_to_string(list_reverse(a), ',') AS reversed,
array_to_string(list_transform(list_filter(a, lambda x: x % 2 = 0), lambda x: x * x), ',') AS squares, len(list_distinct(a)) AS kinds FROM a"""
)
def array_lib(t: Tables):
    a = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 97).alias("v")))), lambda s: s["v"])
    rows = t.orders.groupBy("o_custkey").agg(a.alias("a"))
    show = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    x = F.col("a")
    return rows.select(
        "o_custkey", F.size(x).cast("long").alias("n"), F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v).alias("s"), F.array_min(x).alias("lo"), F.array_max(x).alias("hi"), show(F.array_sort(x)).alias("sorted"),
        show(F.reverse(x)).alias("reversed"), show(F.transform(F.filter(x, lambda v: v % 2 == 0), lambda v: v * v)).alias("squares"), F.size(F.array_distinct(x)).cast("long").alias("kinds"),
    )


@query(
    """WITH m AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2)
SELECT user_id, array_to_string(list(event_type ORDER BY event_type), ',') AS keys, count(*) AS n, bool_or(event_type = 'click') AS has_click, coalesce(max(v) FILTER (event_type = 'view'), -1) AS view_value FROM m GROUP BY 1"""
)
def map_lib(t: Tables):
    m = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "v")))).alias("m"))
    return m.select(
        "user_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.size("m").cast("long").alias("n"), F.map_contains_key("m", F.lit("click")).alias("has_click"), F.coalesce(F.try_element_at("m", F.lit("view")), F.lit(-1.0)).alias("view_value")
    )


@query(
    """WITH x AS (SELECT event_id, CAST(event_id % 37 AS BIGINT) - 18 AS a, CAST(user_id % 7 AS BIGINT) - 3 AS b FROM events)
SELECT event_id, CASE WHEN b <> 0 THEN ((a % abs(b)) + abs(b)) % abs(b) END AS m, CASE WHEN b <> 0 THEN CAST((a - ((a % abs(b)) + abs(b)) % abs(b)) / b AS BIGINT) END AS d, gcd(a, b) AS g FROM x"""
)
def euclid_divmod(t: Tables):
    x = t.events.select("event_id", (F.col("event_id") % 37 - 18).cast("long").alias("a"), (F.col("user_id") % 7 - 3).cast("long").alias("b"))
    return x.select("event_id", numbers.euclid_mod("a", "b").alias("m"), numbers.euclid_div("a", "b").alias("d"), numbers.gcd("a", "b").alias("g"))


@query(
    """SELECT p_partkey, len(list_filter(range(2, CAST(p_size AS BIGINT)), lambda i: p_size % i = 0)) = 0 AS no_divisor, len(list_filter(range(0, CAST(p_size AS BIGINT)), lambda i: i * i = p_size)) > 0 AS is_square FROM part"""
)
def quantifiers(t: Tables):
    n = F.col("p_size").cast("int")
    return t.part.select("p_partkey", numbers.forall_range(F.lit(2), n, lambda i: n % i != 0).alias("no_divisor"), numbers.exists_range(F.lit(0), n, lambda i: i * i == n).alias("is_square"))


@query("SELECT p_partkey, CAST((p_size * 7 + 3) // gcd(p_size * 7 + 3, 21) AS BIGINT) AS num, CAST(21 // gcd(p_size * 7 + 3, 21) AS BIGINT) AS den FROM part")
def rational_sums(t: Tables):
    """p_size / 3 + 1 / 7 in lowest terms."""
    x = numbers.rational_add(numbers.rational(F.col("p_size"), F.lit(3)), numbers.rational(F.lit(1), F.lit(7)))
    return t.part.select("p_partkey", x.alias("x")).select("p_partkey", "x.num", "x.den")


@query(
    """SELECT o_orderkey, CAST(o_orderkey % 10 * 3 + 1 AS BIGINT) AS value, (o_orderkey % 10) > 4 AND o_orderstatus = 'F' AS flag, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(100 // (o_orderkey % 10) AS BIGINT) END AS quotient,
CAST(list_sum(list_transform(range(0, o_orderkey % 10), lambda i: i * i)) AS BIGINT) AS squares FROM orders"""
)
def compiled_expressions(t: Tables):
    """Programs of the expression language, compiled to columns; undefined values are null."""
    env = {"k": (F.col("o_orderkey") % 10).cast("long"), "s": F.col("o_orderstatus")}
    value = ["+", ["*", ["var", "k"], 3], 1]
    flag = ["and", [">", ["var", "k"], 4], ["=", ["var", "s"], ["str", "F"]]]
    squares = ["fold", ["range", 0, ["var", "k"]], 0, ["acc", "i"], ["+", ["var", "acc"], ["*", ["var", "i"], ["var", "i"]]]]
    rows = expressions.with_values(t.orders, {"_value": value, "_flag": flag, "_quotient": ["div", 100, ["var", "k"]], "_squares": squares}, env)
    run = lambda name: F.when(F.col(name)["o"], F.col(name)["v"])
    return rows.select("o_orderkey", run("_value").alias("value"), run("_flag").alias("flag"), run("_quotient").alias("quotient"), F.when(env["k"] > 0, run("_squares")).alias("squares"))


@query(
    """WITH k AS (SELECT o_orderkey, o_orderkey % 10 AS k, o_custkey % 7 AS m FROM orders), r AS (SELECT *, (k * 3 + 2) AS num, gcd(k * 3 + 2, 6 * (m + 1)) AS g FROM k)
SELECT o_orderkey, k = 0 OR m = 0 AS undefined, CASE WHEN m <> 0 THEN 10 // nullif(k, 0) > m END AS holds, coalesce(m = 0 AND 10 // nullif(k, 0) > 3, false) AS reached,
CASE WHEN k < 5 THEN 'no value' WHEN m = 6 THEN 'true' ELSE 'false' END AS searched, CAST(num // g AS VARCHAR) || CASE WHEN 6 * (m + 1) // g = 1 THEN '' ELSE '/' || CAST(6 * (m + 1) // g AS VARCHAR) END AS exact FROM r"""
)
def total_expressions(t: Tables):
    """Programs with functions, exact fractions, and values that may be missing, which differ from false."""
    env = {"k": (F.col("o_orderkey") % 10).cast("long"), "m": (F.col("o_custkey") % 7).cast("long")}
    k, m = ["var", "k"], ["var", "m"]
    functions = [
        expressions.Function("over", ["x", "y"], [">", ["div", 10, ["var", "x"]], ["var", "y"]]),
        expressions.Function("both", ["x", "y"], ["and", ["!=", ["mod", ["var", "x"], ["var", "y"]], -1], ["call", "over", ["var", "x"], ["var", "y"]]]),
        expressions.Function("share", ["x", "y"], ["div", ["toreal", ["var", "x"]], ["toreal", ["var", "y"]]]),
    ]
    trees = {
        "both": ["call", "both", k, m],
        "reached": ["and", ["!=", k, 0], ["and", ["=", m, 0], ["call", "over", k, 3]]],
        "found": ["exists", "i", ["seq", 5, ["at", ["range", 0, k], 4], m], ["and", [">", ["var", "i"], 3], ["!=", ["var", "i"], 5], ["!=", ["var", "i"], 4]]],
        "exact": ["tostr", ["+", ["call", "share", k, ["*", 2, ["+", m, 1]]], ["call", "share", 1, ["*", 3, ["+", m, 1]]]]],
    }
    both, reached, found, exact = (F.col(name) for name in trees)
    said = F.when(~found["o"], "no value").when(found["v"], "true").otherwise("false")
    return expressions.with_values(t.orders, trees, env, functions).select(
        "o_orderkey", (~both["o"]).alias("undefined"), F.when(both["o"], both["v"]).alias("holds"), F.when(reached["o"], reached["v"]).alias("reached"), said.alias("searched"), F.when(exact["o"], exact["v"]).alias("exact")
    )
