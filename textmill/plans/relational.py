"""Join semantics, set operations and grouped reports on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Tables, query


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join(t: Tables):
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join(t: Tables):
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "SELECT count(*) FILTER (s_nationkey IS NULL) AS only_customers, count(*) FILTER (c_nationkey IS NULL) AS only_suppliers, count(*) AS keys FROM (SELECT DISTINCT c_nationkey FROM customer) FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON c_nationkey = s_nationkey"
)
def full_outer_check(t: Tables):
    a, b = t.customer.select("c_nationkey").distinct(), t.supplier.select("s_nationkey").distinct()
    return a.join(b, F.col("c_nationkey") == F.col("s_nationkey"), "full_outer").agg(
        F.count_if(F.col("s_nationkey").isNull()).alias("only_customers"), F.count_if(F.col("c_nationkey").isNull()).alias("only_suppliers"), F.count(F.lit(1)).alias("keys")
    )


@query(
    "SELECT a.p_partkey AS part, count(*) AS twins FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey GROUP BY 1"
)
def signature_fanout(t: Tables):
    """Each part with how many others share its signature: from group sizes, no pair is formed."""
    sizes = t.part.groupBy("p_brand", "p_type", "p_size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return t.part.join(sizes, ["p_brand", "p_type", "p_size"]).select(F.col("p_partkey").alias("part"), (F.col("n") - 1).alias("twins"))


@query("SELECT n_name, p.p_type AS type FROM nation, (SELECT DISTINCT p_type FROM part) p WHERE length(n_name) > length(p.p_type)")
def theta_pairs(t: Tables):
    """A pair of dimension tables, each of bounded size, under an inequality."""
    return t.nation.crossJoin(F.broadcast(t.part.select(F.col("p_type").alias("type")).distinct())).where(F.char_length("n_name") > F.char_length("type")).select("n_name", "type")


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_returnflag) + grouping(l_linestatus) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"
)
def sum_by_grouping_sets(t: Tables):
    t.lineitem.createOrReplaceTempView("_lineitem")
    return t.spark.sql(
        """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, cast(grouping(l_returnflag) + grouping(l_linestatus) AS bigint) AS level
FROM _lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"""
    )


@query(
    """SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o,
round(sum(o_totalprice) FILTER (o_orderstatus = 'F') - sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS difference FROM orders GROUP BY 1"""
)
def factorial_pivot(t: Tables):
    p = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.sum("o_totalprice"))
    return p.select("o_orderpriority", F.round("F", 2).alias("f"), F.round("O", 2).alias("o"), F.round(F.col("F") - F.col("O"), 2).alias("difference"))


@query(
    """SELECT k, array_to_string(list_sort(list(policy)), ',') AS policies FROM (SELECT DISTINCT c_nationkey AS k, 'customer' AS policy FROM customer WHERE c_acctbal < 0
UNION ALL SELECT DISTINCT s_nationkey, 'supplier' FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT n_nationkey, 'region' FROM nation WHERE n_regionkey = 1) GROUP BY k"""
)
def union_attribution(t: Tables):
    sets = t.customer.where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("policy")).distinct()
    sets = sets.unionByName(t.supplier.where("s_acctbal < 0").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("policy")).distinct())
    sets = sets.unionByName(t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), F.lit("region").alias("policy")))
    return sets.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("policy")), ",").alias("policies"))


@query(
    "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW') SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS both, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either, round((SELECT count(*) FROM a JOIN b USING (k)) / (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)), 6) AS iou"
)
def set_iou(t: Tables):
    per = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"))
    return per.agg(F.count_if(F.col("n") == 2).alias("both"), F.count(F.lit(1)).alias("either"), F.round(F.count_if(F.col("n") == 2) / F.count(F.lit(1)), 6).alias("iou"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def set_difference(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).distinct().join(t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("k")), "k", "left_anti")


@query(
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
)
def lookup_chain(t: Tables):
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("o_orderkey", "c_name", "n_name", "r_name")
    )


@query("SELECT o.o_orderkey AS k, CASE WHEN c_custkey IS NULL THEN 'no customer' WHEN c_acctbal < 0 THEN 'in debt' ELSE 'ok' END AS status FROM orders o LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_with_reason(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select(F.col("o_orderkey").alias("k"), F.when(F.col("c_custkey").isNull(), "no customer").when(F.col("c_acctbal") < 0, "in debt").otherwise("ok").alias("status"))


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def pricing_summary(t: Tables):
    return t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"),
    )
