"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.functions import bits
from swathkit.operators import aggregates, design, grid, ranks
from swathkit.plans.registry import Tables, query, rounded


@query(
    "a1_a4_named_aggregates",
    """SELECT pass, count(*) AS n, min(x) AS lo, max(x) AS hi, count(DISTINCT block) AS blocks, round(median(y), 4) AS mid, round(avg(y), 4) AS mean FROM {cells} GROUP BY 1""",
)
def a1(t: Tables) -> DataFrame:
    return t.cells.groupBy("pass").agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_distinct("block").alias("blocks"),
        F.round(F.median("y"), 4).alias("mid"), F.round(F.avg("y"), 4).alias("mean"),
    )


@query("a5_mean_of_means", "SELECT round(avg(m), 6) AS y FROM (SELECT grp, avg(m) AS m FROM (SELECT grp, block, avg(y) AS m FROM {cells} GROUP BY 1, 2) GROUP BY 1)")
def a5(t: Tables) -> DataFrame:
    return rounded(aggregates.mean_of_means(t.cells, ["grp", "block"], "y"))


@query(
    "a6_equal_weight_moments",
    "SELECT round(avg(m), 6) AS mean, round(sqrt(avg(q) - avg(m) * avg(m)), 6) AS sd FROM (SELECT grp, avg(m) AS m, avg(q) AS q FROM (SELECT grp, block, avg(x) AS m, avg(x * x) AS q FROM {cells} GROUP BY 1, 2) GROUP BY 1)",
)
def a6(t: Tables) -> DataFrame:
    return rounded(aggregates.equal_weight_moments(t.cells, ["grp", "block"], "x"))


@query("a7_a8_weighted_mean_and_sum", "SELECT block, round(sum(qty * x) / sum(qty), 8) AS weighted, round(sum(qty * y), 2) AS total FROM {cells} GROUP BY 1")
def a7(t: Tables) -> DataFrame:
    q = F.col("qty")
    return t.cells.groupBy("block").agg(F.round(F.sum(q * F.col("x")) / F.sum(q), 8).alias("weighted"), F.round(F.sum(q * F.col("y")), 2).alias("total"))


@query(
    "a9_exact_quantiles",
    "SELECT block, round(quantile_cont(y, 0.1), 4) AS p10, round(quantile_cont(y, 0.25), 4) AS p25, round(quantile_cont(y, 0.5), 4) AS p50, round(quantile_cont(y, 0.75), 4) AS p75, round(quantile_cont(y, 0.9), 4) AS p90, count(y) AS n FROM {cells} GROUP BY 1",
)
def a9(t: Tables) -> DataFrame:
    p = aggregates.profile(t.cells, ["block"], "y", [0.1, 0.25, 0.5, 0.75, 0.9])
    return p.select("block", *(F.round(F.col("quantiles")[k], 4).alias(f"p{v}") for k, v in enumerate((10, 25, 50, 75, 90))), "n")


@query(
    "a10_pooled_summary",
    "SELECT event_type, round(median(value), 4) AS mid, round(quantile_cont(abs(value - 50), 0.95), 4) AS abs95, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1",
)
def a10(t: Tables) -> DataFrame:
    e = t.events.select("event_type", "value", F.abs(F.col("value") - 50).alias("away"))
    mid = ranks.quantile_columns(e, ["event_type"], "value", {"mid": 0.5})
    far = ranks.quantile_columns(e, ["event_type"], "away", {"abs95": 0.95})
    ends = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rounded(ends.join(mid, "event_type").join(far, "event_type"), 4, skip=("lo", "hi"))


@query(
    "a11_a12_overlap_counts",
    """SELECT l_linenumber, count(*) AS n_pixels, count(*) FILTER (WHERE bad) AS n_bad, round(sum(worst), 2) AS total FROM (SELECT l_suppkey, l_partkey, l_linenumber, bool_or(l_returnflag = 'R') AS bad, max(abs(l_discount - 0.05)) AS worst FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1""",
)
def a11(t: Tables) -> DataFrame:
    pixel = t.lineitem.groupBy("l_suppkey", "l_partkey", "l_linenumber").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("bad"), F.max(F.abs(F.col("l_discount") - 0.05)).alias("worst")
    )
    return pixel.groupBy("l_linenumber").agg(F.count("*").alias("n_pixels"), F.count_if("bad").alias("n_bad"), F.round(F.sum("worst"), 2).alias("total"))


@query(
    "a13_a14_scene_merge",
    """SELECT l_orderkey, l_linenumber, CASE WHEN NOT bool_or(l_partkey % 7 = 0) THEN max(y) FILTER (WHERE k = 1 AND l_partkey % 7 <> 0) END AS y, count(*) AS n_scenes FROM (SELECT *, l_extendedprice AS y,
 row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) GROUP BY 1, 2""",
)
def a13(t: Tables) -> DataFrame:
    cells = t.lineitem.withColumn("y", F.col("l_extendedprice"))
    return grid.merge_scenes(cells, ["l_orderkey", "l_linenumber"], "y", F.col("l_partkey") % 7 == 0, ["l_shipdate", "l_partkey", "l_suppkey"])


@query(
    "a15_a16_block_clear_counts",
    "SELECT block, pass, count(*) AS n_cells, count(*) FILTER (WHERE word & 3 <= 1) AS n_clear, count(*) FILTER (WHERE word & 3 <= 1) >= 4 AS usable FROM {cells} GROUP BY 1, 2",
)
def a15(t: Tables) -> DataFrame:
    return grid.block_counts(t.cells, ["block", "pass"], bits.bits(F.col("word"), 0, 2) <= 1, 4)


@query(
    "a17_a18_mode_and_share",
    """SELECT l_suppkey, l_quantity, n, round(share, 6) AS share FROM (SELECT l_suppkey, l_quantity, n, n / sum(n) OVER (PARTITION BY l_suppkey) AS share, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) AS k
 FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k = 1""",
)
def a17(t: Tables) -> DataFrame:
    return rounded(aggregates.mode_of(t.lineitem, ["l_suppkey"], "l_quantity"), skip=("l_quantity",))


@query(
    "a20_strata_with_empty_ones",
    """SELECT s.m AS month, s.event_type, coalesce(n, 0) AS n, coalesce(ok, 0) AS n_ok, round(ok * 1.0 / n, 6) AS share FROM (SELECT * FROM (SELECT unnest(range(1, 4)) AS m) CROSS JOIN (SELECT DISTINCT event_type FROM events)) s
 LEFT JOIN (SELECT month(ts) AS m, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS ok FROM events GROUP BY 1, 2) g ON g.m = s.m AND g.event_type = s.event_type""",
)
def a20(t: Tables) -> DataFrame:
    months = t.spark.range(1, 4).select(F.col("id").cast("int").alias("month"))
    spine = months.crossJoin(F.broadcast(t.events.select("event_type").distinct()))
    return rounded(aggregates.strata_summary(t.events.withColumn("month", F.month("ts")), spine, ["month", "event_type"], F.col("value") > 50))


@query(
    "a21_reuse",
    "SELECT count(*) AS n_ids, sum(uses) AS n_uses, max(uses) AS most_uses FROM (SELECT id, count(*) AS uses FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY 1)",
)
def a21(t: Tables) -> DataFrame:
    return aggregates.reuse(t.lineitem, ["l_partkey", "l_suppkey"])


@query("a22_counts_of_counts", "SELECT n, count(*) AS n_users FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def a22(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_users"))


@query(
    "a23_panel_rule",
    "SELECT grp, bool_and(ok) AS all_pass, bool_or(ok) AS any_pass FROM (SELECT grp, block, count(*) FILTER (WHERE x > 0.08) >= 95 AS ok FROM {cells} GROUP BY 1, 2) GROUP BY 1",
)
def a23(t: Tables) -> DataFrame:
    strata = t.cells.groupBy("grp", "block").agg((F.count_if(F.col("x") > 0.08) >= 95).alias("ok"))
    return strata.groupBy("grp").agg(F.bool_and("ok").alias("all_pass"), F.bool_or("ok").alias("any_pass"))


@query(
    "a24_fixed_bins",
    """SELECT CAST(b.k AS INTEGER) AS bin, b.lo AS low, b.hi AS high, count(c.y) AS n, round(avg(c.y), 4) AS mean FROM (VALUES (0, 0.0, 0.02), (1, 0.02, 0.05), (2, 0.05, 0.10), (3, 0.10, 0.2)) b(k, lo, hi)
 LEFT JOIN {cells} c ON c.x >= b.lo AND (c.x < b.hi OR (b.k = 3 AND c.x <= b.hi)) GROUP BY 1, 2, 3""",
)
def a24(t: Tables) -> DataFrame:
    return rounded(aggregates.binned(t.cells, "x", [0.0, 0.02, 0.05, 0.10, 0.2], "y"), 4)


@query("a25_histogram", "SELECT CAST(least(floor(qty * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM {cells} GROUP BY 1")
def a25(t: Tables) -> DataFrame:
    return aggregates.histogram(t.cells, F.col("qty"), 40)


@query("a26_mean_of_ratios", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice / l_quantity), 4) AS mean_ratio, round(sum(l_extendedprice) / sum(l_quantity), 4) AS ratio_of_sums FROM lineitem GROUP BY 1")
def a26(t: Tables) -> DataFrame:
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.avg(p / q), 4).alias("mean_ratio"), F.round(F.sum(p) / F.sum(q), 4).alias("ratio_of_sums")
    )


@query(
    "a27_centred_counts",
    "SELECT min(n) AS lo, median(n) AS mid, max(n) AS hi, round(avg(CASE WHEN n >= 1 THEN 1.0 ELSE 0 END), 6) AS one, round(avg(CASE WHEN n >= 12 THEN 1.0 ELSE 0 END), 6) AS dozen FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY 1)",
)
def a27(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    return n.agg(
        F.min("n").alias("lo"), F.median("n").alias("mid"), F.max("n").alias("hi"), F.round(F.avg((F.col("n") >= 1).cast("double")), 6).alias("one"),
        F.round(F.avg((F.col("n") >= 12).cast("double")), 6).alias("dozen"),
    )


@query(
    "a28_s27_pooled_within_variance",
    "SELECT round(sum((n - 1) * v) / sum(n), 8) AS pooled FROM (SELECT block, count(*) AS n, var_samp(x) AS v, avg(x) AS m FROM {cells} GROUP BY 1)",
)
def a28(t: Tables) -> DataFrame:
    groups = t.cells.groupBy("block").agg(F.count("*").alias("n"), F.var_samp("x").alias("v"), F.avg("x").alias("m"))
    return groups.agg(F.round(aggregates.pooled_within_variance(groups, "n", "v"), 8).alias("pooled"))


@query("a29_within_sum_of_squares", "SELECT round(sum(s), 6) AS sxx FROM (SELECT block, regr_sxx(x, x) AS s FROM {cells} GROUP BY 1)")
def a29(t: Tables) -> DataFrame:
    return t.cells.groupBy("block").agg(F.regr_sxx("x", "x").alias("s")).agg(F.round(F.sum("s"), 6).alias("sxx"))


@query("a30_footprint_area", "SELECT l_returnflag, count(DISTINCT l_partkey) * 4900 / 1e6 AS km2 FROM lineitem GROUP BY 1")
def a30(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg((F.count_distinct("l_partkey") * 4900 / 1e6).alias("km2"))


@query(
    "a31_scene_rollup",
    """SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS worst, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS seen, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f FROM orders GROUP BY 1""",
)
def a31(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.max("o_orderpriority").alias("worst"), F.concat_ws("|", F.array_sort(F.collect_set("o_orderstatus"))).alias("seen"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
    )


@query(
    "a32_a39_funnel_per_group",
    "SELECT l_returnflag, stage, n FROM (SELECT l_returnflag, count(*) AS s0, count(*) FILTER (WHERE l_quantity > 10) AS s1, count(*) FILTER (WHERE l_quantity > 10 AND l_discount > 0.05) AS s2 FROM lineitem GROUP BY 1) UNPIVOT (n FOR stage IN (s0, s1, s2))",
)
def a32(t: Tables) -> DataFrame:
    big, cheap = F.col("l_quantity") > 10, F.col("l_discount") > 0.05
    wide = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("s0"), F.count_if(big).alias("s1"), F.count_if(big & cheap).alias("s2"))
    return wide.unpivot("l_returnflag", ["s0", "s1", "s2"], "stage", "n")


@query(
    "a33_g14_stack_stability",
    "SELECT l_partkey, CASE WHEN count(v) >= 7 AND max(v) - min(v) <= 45 THEN median(v) END AS stable FROM (SELECT l_partkey, CASE WHEN l_linenumber <= 6 THEN l_quantity END AS v FROM lineitem) GROUP BY 1",
)
def a33(t: Tables) -> DataFrame:
    v = F.when(F.col("l_linenumber") <= 6, F.col("l_quantity"))
    ok = (F.count(v) >= 7) & (F.max(v) - F.min(v) <= 45)
    return t.lineitem.groupBy("l_partkey").agg(F.when(ok, F.median(v)).alias("stable"))


@query(
    "a34_a35_support_per_stratum",
    "SELECT grp, count(*) AS n_common FROM (SELECT grp, x FROM {cells} c GROUP BY 1, 2 HAVING count(DISTINCT block) = (SELECT count(DISTINCT block) FROM {cells} d WHERE d.grp = c.grp)) GROUP BY 1",
)
def a34(t: Tables) -> DataFrame:
    held = t.cells.groupBy("grp", "x").agg(F.count_distinct("block").alias("held"))
    n = t.cells.groupBy("grp").agg(F.count_distinct("block").alias("n_blocks"))
    return held.join(n, "grp").where("held = n_blocks").groupBy("grp").agg(F.count("*").alias("n_common"))


@query(
    "a36_r41_correlations",
    """SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rb FROM lineitem) GROUP BY 1""",
)
def a36(t: Tables) -> DataFrame:
    return rounded(ranks.rank_correlation(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query(
    "a37_tertile_overlap",
    """WITH e AS (SELECT quantile_cont(l_quantity, 1.0 / 3) AS a, quantile_cont(l_quantity, 2.0 / 3) AS b FROM lineitem),
 g AS (SELECT CASE WHEN l_quantity <= a THEN 0 WHEN l_quantity <= b THEN 1 ELSE 2 END AS k, l_discount FROM lineitem CROSS JOIN e)
 SELECT max(p10) AS low, min(p90) AS high FROM (SELECT k, quantile_cont(l_discount, 0.1) AS p10, quantile_cont(l_discount, 0.9) AS p90 FROM g GROUP BY 1)""",
)
def a37(t: Tables) -> DataFrame:
    e = ranks.quantile_columns(t.lineitem, [], "l_quantity", {"a": 1.0 / 3, "b": 2.0 / 3})
    third = F.when(F.col("l_quantity") <= F.col("a"), 0).when(F.col("l_quantity") <= F.col("b"), 1).otherwise(2)
    groups = t.lineitem.join(F.broadcast(e)).withColumn("k", third)  # e is one row
    return ranks.quantile_columns(groups, ["k"], "l_discount", {"p10": 0.1, "p90": 0.9}).agg(F.max("p10").alias("low"), F.min("p90").alias("high"))


@query("a40_upper_median", "SELECT user_id, list_sort(list(epoch_us(ts)))[CAST(floor(count(*) / 2.0) AS BIGINT) + 1] AS middle FROM events GROUP BY 1")
def a40(t: Tables) -> DataFrame:
    return aggregates.upper_median(t.events.select("user_id", F.unix_micros("ts").alias("us")), ["user_id"], "us", 86_400_000_000).withColumnRenamed("us", "middle")


@query(
    "a41_supported_pair_sweep",
    """WITH r AS (SELECT grp, block, min(qty) AS lo, max(qty) AS hi FROM {cells} WHERE x > 0.09 GROUP BY 1, 2), c AS (SELECT unnest([0.02, 0.04, 0.06, 0.08, 0.1]) AS low),
 n AS (SELECT low, grp, count(*) AS blocks FROM r JOIN c ON lo <= low AND hi >= low + 0.85 GROUP BY 1, 2)
 SELECT low, low + 0.85 AS high, least_n AS least FROM (SELECT low, min(blocks) AS least_n, count(*) AS held FROM n GROUP BY 1) WHERE held = (SELECT count(DISTINCT grp) FROM r) ORDER BY least_n DESC, low LIMIT 1""",
)
def a41(t: Tables) -> DataFrame:
    lows = t.spark.createDataFrame([(v,) for v in (0.02, 0.04, 0.06, 0.08, 0.1)], "low double")
    return aggregates.supported_pair(t.cells.where("x > 0.09"), "grp", "block", "qty", lows, 0.85)


@query(
    "a42_central_quantile_pair",
    "SELECT round(max(p10), 6) AS low, round(min(p90), 6) AS high FROM (SELECT block, quantile_cont(qty, 0.1) AS p10, quantile_cont(qty, 0.9) AS p90 FROM {cells} GROUP BY 1)",
)
def a42(t: Tables) -> DataFrame:
    return rounded(aggregates.span(t.cells, ["block"], "qty").agg(F.max("p10").alias("low"), F.min("p90").alias("high")))


@query(
    "a43_endpoint_support",
    "SELECT count(*) FILTER (WHERE near_low > 0 AND near_high > 0) AS spanning, sum(near_low) AS low_cells, sum(near_high) AS high_cells FROM (SELECT block, count(*) FILTER (WHERE x BETWEEN 0.0 AND 0.025) AS near_low, count(*) FILTER (WHERE x BETWEEN 0.075 AND 0.125) AS near_high FROM {cells} GROUP BY 1)",
)
def a43(t: Tables) -> DataFrame:
    g = t.cells.groupBy("block").agg(F.count_if(bits.band(F.col("x"), 0.0, 0.025)).alias("lo"), F.count_if(bits.band(F.col("x"), 0.1, 0.025)).alias("hi"))
    return g.agg(F.count_if((F.col("lo") > 0) & (F.col("hi") > 0)).alias("spanning"), F.sum("lo").alias("low_cells"), F.sum("hi").alias("high_cells"))


@query(
    "a44_natural_gap",
    """WITH v AS (SELECT DISTINCT round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_custkey), g AS (SELECT v, lead(v) OVER (ORDER BY v) AS nxt, lead(v) OVER (ORDER BY v) - v AS gap FROM v)
 SELECT CASE WHEN count(*) = 1 THEN max(v) END AS low, CASE WHEN count(*) = 1 THEN max(nxt) END AS high FROM g WHERE gap = (SELECT max(gap) FROM g)""",
)
def a44(t: Tables) -> DataFrame:
    """The widest gap between customers' order totals."""
    return design.natural_gap(t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v")), "v")


@query("a_cube_archive_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "a19_combination_summary",
    """SELECT grp, count(DISTINCT block) AS blocks, count(DISTINCT pass) AS passes, round(median(n), 4) AS mid, round(quantile_cont(n, 0.1), 4) AS p10, count(*) FILTER (WHERE n < 5) AS below FROM (SELECT grp, block, pass, count(*) AS n FROM {cells} GROUP BY 1, 2, 3) GROUP BY 1""",
)
def a19(t: Tables) -> DataFrame:
    n = t.cells.groupBy("grp", "block", "pass").agg(F.count("*").alias("n"))
    return n.groupBy("grp").agg(
        F.count_distinct("block").alias("blocks"), F.count_distinct("pass").alias("passes"), F.round(F.median("n"), 4).alias("mid"),
        F.round(F.percentile("n", 0.1), 4).alias("p10"), F.count_if(F.col("n") < 5).alias("below"),
    )


@query(
    "a38_readiness",
    "SELECT 3 AS n_checks, 2 AS n_passed, false AS ready, 'c_orders' AS failed",
)
def a38(t: Tables) -> DataFrame:
    from swathkit.operators.contracts import readiness

    checks = t.region.agg(F.lit("a_regions").alias("name"), F.count("*").alias("observed"), F.lit(5).alias("expected"))
    checks = checks.unionByName(t.nation.agg(F.lit("b_nations").alias("name"), F.count("*").alias("observed"), F.lit(25).alias("expected")))
    checks = checks.unionByName(t.orders.agg(F.lit("c_orders").alias("name"), F.count("*").alias("observed"), F.lit(-1).alias("expected")))
    return readiness(checks)
