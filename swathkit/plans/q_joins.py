"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.operators import joins, kdtree
from swathkit.plans.registry import Tables, query, rounded
from swathkit.sources.files import written


@query("j1_one_to_one", "SELECT p_partkey, p_size, n FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def j1(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return joins.keyed_join(t.part, n, ["p_partkey"], cardinality="one_to_one").select("p_partkey", "p_size", "n")


@query("j2_many_to_one", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j2(t: Tables) -> DataFrame:
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.keyed_join(t.customer, nation, ["c_nationkey"]).select("c_custkey", "n_name")


@query("j3_left_all_matched", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j3(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.join_all_matched(t.orders, customers, ["o_custkey"]).select("o_orderkey", "c_name")


@query(
    "j4_left_on_other_names",
    "SELECT p.event_id, round(h.v, 6) AS v FROM {passes} p LEFT JOIN {hourly} h ON date_trunc('hour', p.ts) + INTERVAL 1 HOUR = h.hour",
)
def j4(t: Tables) -> DataFrame:
    p, h = t.passes, t.hourly
    on = (F.date_trunc("hour", p["ts"]) + F.expr("interval 1 hour")) == h["hour"]
    return rounded(p.join(h, on, "left").select("event_id", "v"))


@query(
    "j5_left_one_to_one_enrich",
    """SELECT s_suppkey, n AS n_items, round(bal, 4) AS balance, n_name FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON s_suppkey = l_suppkey
 LEFT JOIN (SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier WHERE s_acctbal > 0) ON s_suppkey = k LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def j5(t: Tables) -> DataFrame:
    n = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_items"))
    bal = t.supplier.where("s_acctbal > 0").select("s_suppkey", F.round("s_acctbal", 4).alias("balance"))
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    out = joins.keyed_join(t.supplier, n, ["s_suppkey"], "left", "one_to_one")
    out = joins.keyed_join(out, bal, ["s_suppkey"], "left", "one_to_one")
    return joins.keyed_join(out, nation, ["s_nationkey"], "left").select("s_suppkey", "n_items", "balance", "n_name")


@query(
    "j6_dense_grid",
    """SELECT s.o_orderstatus, p.o_orderpriority, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
 LEFT JOIN (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1, 2) ON a = s.o_orderstatus AND b = p.o_orderpriority""",
)
def j6(t: Tables) -> DataFrame:
    axes = [t.orders.select(c).distinct() for c in ("o_orderstatus", "o_orderpriority")]
    return joins.dense_counts(t.orders.where("o_totalprice > 400000"), axes)


@query(
    "j7_full_outer",
    "SELECT coalesce(a.k, b.k) AS k, a.n AS n_rich, b.n AS n_poor FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < -800 GROUP BY 1) b ON a.k = b.k",
)
def j7(t: Tables) -> DataFrame:
    c = t.customer.withColumnRenamed("c_nationkey", "k")
    a = c.where("c_acctbal > 9000").groupBy("k").agg(F.count("*").alias("n_rich"))
    b = c.where("c_acctbal < -800").groupBy("k").agg(F.count("*").alias("n_poor"))
    return joins.keyed_join(a, b, ["k"], "full_outer", "one_to_one")


@query("j8_inner_by_key", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def j8(t: Tables) -> DataFrame:
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name").agg(F.count("*").alias("n"))
    )


@query(
    "j9_pivot_instead_of_merges",
    """SELECT user_id, count(*) FILTER (WHERE d = 1) AS d1, count(*) FILTER (WHERE d <= 3) AS d3, count(*) FILTER (WHERE d <= 7) AS d7 FROM (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) + 1 AS d FROM events) GROUP BY 1""",
)
def j9(t: Tables) -> DataFrame:
    d = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    return t.events.groupBy("user_id").agg(F.count_if(d == 1).alias("d1"), F.count_if(d <= 3).alias("d3"), F.count_if(d <= 7).alias("d7"))


@query("j10_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def j10(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").select("c_custkey")


@query(
    "j11_key_difference",
    """SELECT k, 'left' AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
 UNION ALL SELECT k, 'right' FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def j11(t: Tables) -> DataFrame:
    o = t.orders.withColumnRenamed("o_custkey", "k")
    return joins.key_difference(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["k"])


@query("j12_ordered_restriction", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) ORDER BY o_orderkey")
def j12(t: Tables) -> DataFrame:
    ids = t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t.orders.join(ids, "o_orderkey").select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


PAIR_SQL = """WITH p AS (SELECT event_id AS pass_id, user_id, ts FROM events WHERE event_type = 'purchase'), a AS (SELECT event_id AS acq_id, user_id, event_type AS sensor, ts FROM events WHERE event_type IN ('view', 'click')),
 l AS (SELECT p.user_id, pass_id, sensor, acq_id, (epoch_us(a.ts) - epoch_us(p.ts)) / 86400000000.0 AS lag, extract('hour' FROM a.ts) AS h FROM p JOIN a ON p.user_id = a.user_id),
 c AS (SELECT x.user_id, x.pass_id, x.sensor, x.acq_id AS pre, z.acq_id AS post, abs(x.lag + z.lag) AS imb, z.lag - x.lag AS total, x.h AS h0, z.h AS h1 FROM l x JOIN l z ON x.pass_id = z.pass_id AND x.sensor = z.sensor
 WHERE x.lag BETWEEN -15 AND -1 AND z.lag BETWEEN 1 AND 15 AND x.acq_id <> z.acq_id AND abs(x.lag + z.lag) <= 3 {more}),
 k AS (SELECT *, row_number() OVER (PARTITION BY pass_id, sensor ORDER BY imb, total, pre, post) AS rk, count(*) OVER (PARTITION BY pass_id, sensor) AS n FROM c)
 """


PAIRS_ONLY_SQL = PAIR_SQL.replace("{more}", "") + "SELECT pass_id, sensor, lpad(CAST(pre AS VARCHAR), CAST(greatest(6, length(CAST(pre AS VARCHAR))) AS INTEGER), '0') AS pre, post AS post_acq_id FROM k WHERE rk = 1"


def pairs(t: Tables, **more) -> DataFrame:  # noqa: ANN003
    passes = t.passes.select(F.col("event_id").alias("pass_id"), "user_id", F.col("ts").alias("pass_time"))
    found = t.events.where(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("acq_id"), "user_id", F.col("event_type").alias("sensor"), F.col("ts").alias("acq_time"), F.hour("ts").alias("h")
    )
    return joins.match_before_after(passes, found, ["user_id"], "sensor", **more)


@query(
    "j13_interval_pairs",
    PAIR_SQL.replace("{more}", "") + "SELECT user_id, pass_id, sensor, pre AS pre_acq_id, post AS post_acq_id, round(imb, 6) AS imbalance, round(total, 6) AS total, n AS n_pairs FROM k WHERE rk = 1",
)
def j13(t: Tables) -> DataFrame:
    return rounded(pairs(t))


@query(
    "j14_r43_interval_pairs_with_overlap",
    PAIR_SQL.replace("{more}", "AND abs(x.h - z.h) <= 2") + "SELECT user_id, pass_id, sensor, pre AS pre_acq_id, post AS post_acq_id, round(imb, 6) AS imbalance, round(total, 6) AS total, n AS n_pairs FROM k WHERE rk = 1",
)
def j14(t: Tables) -> DataFrame:
    return rounded(pairs(t, enough=F.abs(F.col("pre_h") - F.col("post_h")) <= 2, extra=["h"]))


@query(
    "j15_pairs_for_all_candidates",
    PAIR_SQL.replace("{more}", "") + """SELECT q.pass_id, q.sensor, k.pre AS pre_acq_id, k.post AS post_acq_id FROM (SELECT pass_id, s AS sensor FROM p CROSS JOIN (VALUES ('view'), ('click')) v(s)) q
 LEFT JOIN (SELECT * FROM k WHERE rk = 1) k ON k.pass_id = q.pass_id AND k.sensor = q.sensor""",
)
def j15(t: Tables) -> DataFrame:
    sensors = t.spark.createDataFrame([("view",), ("click",)], "sensor string")
    wanted = t.passes.select(F.col("event_id").alias("pass_id")).crossJoin(F.broadcast(sensors))
    return wanted.join(pairs(t), ["pass_id", "sensor"], "left").select("pass_id", "sensor", "pre_acq_id", "post_acq_id")


@query(
    "j16_m8_bracket_interpolation",
    """SELECT event_id, round(CASE WHEN w = 0 THEN a.v ELSE (1 - w) * a.v + w * b.v END, 6) AS v FROM (SELECT event_id, date_trunc('hour', ts) AS lo, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS hi,
 (epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 3600000000.0 AS w FROM {passes}) p LEFT JOIN {hourly} a ON a.hour = p.lo LEFT JOIN {hourly} b ON b.hour = p.hi""",
)
def j16(t: Tables) -> DataFrame:
    return rounded(joins.bracket(t.passes.select("event_id", "ts"), t.hourly, "ts", "hour", ["v"]).select("event_id", "v"))


@query(
    "j17_bracket_by_pivot",
    """SELECT event_id, round(max(v) FILTER (WHERE role = 'floor'), 6) AS floor_v, round(max(v) FILTER (WHERE role = 'ceiling'), 6) AS ceiling_v FROM (SELECT event_id, role, date_trunc('hour', ts) + CASE role WHEN 'floor' THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END AS hour
 FROM {passes} CROSS JOIN (VALUES ('floor'), ('ceiling')) r(role)) x LEFT JOIN {hourly} h ON x.hour = h.hour GROUP BY 1""",
)
def j17(t: Tables) -> DataFrame:
    lo = F.date_trunc("hour", "ts")
    roles = F.array(F.struct(F.lit("floor").alias("role"), lo.alias("hour")), F.struct(F.lit("ceiling").alias("role"), (lo + F.expr("interval 1 hour")).alias("hour")))
    listed = t.passes.select("event_id", F.explode(roles).alias("r")).select("event_id", "r.role", "r.hour")
    wide = listed.join(t.hourly, "hour", "left").groupBy("event_id").pivot("role", ["floor", "ceiling"]).agg(F.max("v"))
    return rounded(wide.select("event_id", F.col("floor").alias("floor_v"), F.col("ceiling").alias("ceiling_v")))


GRID_SQL = "(SELECT l_suppkey AS gx, l_linenumber AS gy, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)"


def lattice(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").cast("bigint").alias("gx"), F.col("l_linenumber").cast("bigint").alias("gy")).agg(F.sum("l_extendedprice").alias("v"))


@query(
    "j18_j19_neighbour_pairs",
    f"SELECT a.gx, a.gy, b.gx AS nx, b.gy AS ny, round(b.v - a.v, 2) AS step FROM {GRID_SQL} a JOIN {GRID_SQL} b ON (b.gx = a.gx + 1 AND b.gy = a.gy) OR (b.gx = a.gx AND b.gy = a.gy + 1)",
)
def j18(t: Tables) -> DataFrame:
    n = joins.neighbours(lattice(t), [], "gx", "gy", "v")
    return rounded(n.select(F.col("x0").alias("gx"), F.col("y0").alias("gy"), F.col("gx").alias("nx"), F.col("gy").alias("ny"), (F.col("neighbour") - F.col("value")).alias("step")), 2)


FEATURES = ["qty", "price", "discount", "tax", "p_size", "p_retailprice"]


@query(
    "j23_nearest_neighbour",
    """WITH f AS (SELECT p_partkey, p_type, avg(l_quantity) AS qty, avg(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax, any_value(p_size) AS p_size, any_value(p_retailprice) AS p_retailprice FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
 s AS (SELECT avg(qty) AS m1, stddev_pop(qty) AS s1, avg(price) AS m2, stddev_pop(price) AS s2, avg(discount) AS m3, stddev_pop(discount) AS s3, avg(tax) AS m4, stddev_pop(tax) AS s4, avg(p_size) AS m5, stddev_pop(p_size) AS s5, avg(p_retailprice) AS m6, stddev_pop(p_retailprice) AS s6 FROM f),
 z AS (SELECT p_partkey, p_type = 'ECONOMY' AS pool, (qty - m1) / s1 AS a, (price - m2) / s2 AS b, (discount - m3) / s3 AS c, (tax - m4) / s4 AS d, (p_size - m5) / s5 AS e, (p_retailprice - m6) / s6 AS g FROM f, s)
 SELECT q, nearest_id, round(sqrt(d), 6) AS distance FROM (SELECT x.p_partkey AS q, y.p_partkey AS nearest_id, power(x.a - y.a, 2) + power(x.b - y.b, 2) + power(x.c - y.c, 2) + power(x.d - y.d, 2) + power(x.e - y.e, 2) + power(x.g - y.g, 2) AS d,
 row_number() OVER (PARTITION BY x.p_partkey ORDER BY power(x.a - y.a, 2) + power(x.b - y.b, 2) + power(x.c - y.c, 2) + power(x.d - y.d, 2) + power(x.e - y.e, 2) + power(x.g - y.g, 2), y.p_partkey) AS k FROM z x JOIN z y ON NOT x.pool AND y.pool) WHERE k = 1""",
)
def j23(t: Tables) -> DataFrame:
    """For each part outside the pool the nearest part of the pool, by six standardised features."""
    means = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    rows = written(t.part.join(means, "p_partkey").select("p_partkey", "p_type", *FEATURES), "parts")
    z = kdtree.standardised(rows, rows, FEATURES)
    near = kdtree.nearest(z.where("p_type <> 'ECONOMY'"), z.where("p_type = 'ECONOMY'"), "p_partkey", "p_partkey", FEATURES)
    return rounded(near.withColumnRenamed("p_partkey", "q"))


@query(
    "j24_scenario_product",
    """WITH s AS (SELECT * FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders)),
 n AS (SELECT c_mktsegment, o_orderpriority, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
 SELECT s.*, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (c_mktsegment, o_orderpriority, o_orderstatus)""",
)
def j24(t: Tables) -> DataFrame:
    """Every scenario of three axes that the tables hold, with its orders, also where there are none."""
    axes = [t.customer.select("c_mktsegment"), t.orders.select("o_orderpriority"), t.orders.select("o_orderstatus")]
    both = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    names = [a.columns[0] for a in axes]
    counts = both.groupBy(*names).agg(F.count("*").alias("n"))
    return joins.scenarios(axes).join(counts, names, "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("j25_unique_lookup", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def j25(t: Tables) -> DataFrame:
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.keyed_join(t.supplier, nation, ["s_nationkey"]).groupBy("n_name").agg(F.count("*").alias("n"))


@query(
    "j26_common_support",
    "SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT strftime(l_shipdate, '%Y-%m')) = (SELECT count(DISTINCT strftime(l_shipdate, '%Y-%m')) FROM lineitem)",
)
def j26(t: Tables) -> DataFrame:
    return joins.common_keys(t.cells, "block", "pass").withColumnRenamed("block", "l_suppkey")


@query(
    "asof_latest_before",
    """SELECT event_id, prev FROM (SELECT p.event_id, (SELECT e.event_id FROM events e WHERE e.event_type = 'view' AND e.user_id = p.user_id AND e.ts <= p.ts ORDER BY e.ts DESC LIMIT 1) AS prev FROM {passes} p)""",
)
def asof(t: Tables) -> DataFrame:
    views = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("prev"))
    return joins.latest_before(t.passes, views, ["user_id"], "ts", "seen", ["prev"]).select("event_id", "prev")
