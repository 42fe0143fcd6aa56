"""Sorting, limits and set operations (O)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.operators import graph, ranks
from swathkit.plans.registry import Tables, query


@query("o1_o2_total_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def o1(t: Tables) -> DataFrame:
    order = ranks.placed(t.orders.select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"])
    return order.select("o_orderkey", (F.col("place") + 1).alias("place"))


@query("o3_first_eligible", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_custkey LIMIT 5")
def o3(t: Tables) -> DataFrame:
    ok = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(ok, "c_custkey", "left_semi").orderBy("c_custkey").limit(5).select("c_custkey")


@query(
    "o4_top_five_share",
    "SELECT round(sum(s) FILTER (WHERE k <= 5) / sum(s), 8) AS share FROM (SELECT s, row_number() OVER (ORDER BY s DESC, block) AS k FROM (SELECT block, regr_sxx(x, x) AS s FROM {cells} GROUP BY 1))",
)
def o4(t: Tables) -> DataFrame:
    from swathkit.operators import aggregates

    c = aggregates.concentration(aggregates.information_shares(t.cells, "block", "x"))
    return c.select(F.round("top_five", 8).alias("share"))


@query("o5_union_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def o5(t: Tables) -> DataFrame:
    k = t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k")))
    return k.groupBy("k").agg(F.count("*").alias("n"))


def ids(t: Tables) -> tuple[DataFrame, DataFrame]:
    return (
        t.lineitem.where("l_quantity > 48").select("l_partkey"),
        t.lineitem.where("l_discount > 0.09").select("l_partkey"),
    )


A, B = "SELECT l_partkey FROM lineitem WHERE l_quantity > 48", "SELECT l_partkey FROM lineitem WHERE l_discount > 0.09"


@query("o6_union_distinct", f"{A} UNION {B}")
def o6(t: Tables) -> DataFrame:
    a, b = ids(t)
    return a.union(b).distinct()


@query("o7_intersect", f"{A} INTERSECT {B}")
def o7(t: Tables) -> DataFrame:
    a, b = ids(t)
    return a.intersect(b)


@query("o8_o9_differences_both_ways", f"SELECT l_partkey, 'a' AS side FROM ({A} EXCEPT {B}) UNION ALL SELECT l_partkey, 'b' FROM ({B} EXCEPT {A})")
def o8(t: Tables) -> DataFrame:
    a, b = ids(t)
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))


@query("o10_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def o10(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").dropDuplicates()


@query(
    "o11_frame_equality",
    "SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_partkey FROM lineitem EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem)) AS only_left, (SELECT count(*) FROM (SELECT l_orderkey, l_partkey FROM lineitem EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 50)) AS only_right",
)
def o11(t: Tables) -> DataFrame:
    a = t.lineitem.select("l_orderkey", "l_partkey")
    b = t.lineitem.where("l_quantity < 50").select("l_orderkey", "l_partkey")
    same = a.exceptAll(a).agg(F.count("*").alias("only_left"))
    return same.join(F.broadcast(a.exceptAll(b).agg(F.count("*").alias("only_right"))))  # one row each


@query(
    "o12_largest_component_share",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
 r(x, y) AS (SELECT x, x FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x), c AS (SELECT x, min(y) AS root FROM r GROUP BY 1)
 SELECT count(DISTINCT root) AS n_components, round((SELECT max(n) FROM (SELECT count(*) AS n FROM e JOIN c ON e.a = c.x GROUP BY c.root)) / (SELECT count(*) FROM e)::DOUBLE, 8) AS share FROM c""",
)
def o12(t: Tables) -> DataFrame:
    edges = t.lineitem.where("l_quantity = 50 and l_discount = 0.1").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1_000_000).alias("v")).distinct()
    return graph.largest_component_share(edges).withColumn("share", F.round("share", 8))
