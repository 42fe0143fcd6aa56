"""Composite pipelines and contracts (R, C, S)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.functions import clock, ident, physics
from swathkit.operators import aggregates, design, distance, graph, joins, ranks, select, within
from swathkit.plans.q_joins import GRID_SQL, PAIRS_ONLY_SQL, lattice, pairs
from swathkit.plans.q_windows import ARMS, arms
from swathkit.plans.registry import Tables, query, rounded
from swathkit.streaming import windows


@query(
    "s17_latest_complete_bundle",
    """SELECT k, v FROM (SELECT l_partkey AS k, l_suppkey AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey DESC) AS r FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) = 2) WHERE r = 1""",
)
def s17(t: Tables) -> DataFrame:
    layers = t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("v"), F.col("l_returnflag").alias("layer"))
    return select.complete_bundles(layers, ["k"], ["v"], "layer", ["A", "N"])


@query(
    "r1_exact_time_weather",
    """SELECT event_id, round(CASE WHEN tc IS NOT NULL THEN greatest(0.6108 * exp(17.27 * tc / (tc + 237.3)) - 0.6108 * exp(17.27 * (tc - 5) / (tc - 5 + 237.3)), 0) END, 6) AS vpd FROM (SELECT p.event_id, CASE WHEN w = 0 THEN a.v ELSE (1 - w) * a.v + w * b.v END / 4 AS tc FROM
 (SELECT event_id, date_trunc('hour', ts) AS lo, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hi, (epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 3600000000.0 AS w FROM {passes}) p LEFT JOIN {hourly} a ON a.hour = p.lo LEFT JOIN {hourly} b ON b.hour = p.hi)""",
)
def r1(t: Tables) -> DataFrame:
    at = joins.bracket(t.passes.select("event_id", "ts"), t.hourly, "ts", "hour", ["v"])
    kelvin = F.col("v") / 4 + 273.15
    return rounded(at.select("event_id", F.when(F.col("v").isNotNull(), physics.vpd_kpa(kelvin, kelvin - 5)).alias("vpd")))


@query(
    "r2_r42_analysis_loader",
    """WITH m AS (SELECT c_nationkey, avg(c_acctbal) >= 4400 AS admitted FROM customer GROUP BY 1)
 SELECT o_orderkey, n_name, o_totalprice IS NOT NULL AND c_acctbal > 0 AS complete, round(sin(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) AS doy_cos
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN m ON m.c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND admitted""",
)
def r2(t: Tables) -> DataFrame:
    """Orders of admitted nations (a manifest by nation) with place, completeness and season."""
    manifest = t.customer.groupBy("c_nationkey").agg((F.avg("c_acctbal") >= 4400).alias("admitted"))
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    n = joins.keyed_join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), manifest, ["c_nationkey"], cardinality="one_to_one").where("admitted")
    out = joins.keyed_join(joins.keyed_join(t.orders.where("o_orderstatus = 'F'"), c, ["o_custkey"]), n, ["c_nationkey"])
    sin, cos = clock.cyclic(F.dayofyear("o_orderdate"), 365.25)
    return out.select(
        "o_orderkey", "n_name", (F.col("o_totalprice").isNotNull() & (F.col("c_acctbal") > 0)).alias("complete"), F.round(sin, 6).alias("doy_sin"), F.round(cos, 6).alias("doy_cos")
    )


@query("r3_r4_span", "SELECT block, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.9) - quantile_cont(x, 0.1), 6) AS span FROM {cells} GROUP BY 1")
def r4(t: Tables) -> DataFrame:
    return rounded(aggregates.span(t.cells, ["block"], "x"))


@query(
    "r5_required_grid",
    "SELECT r_regionkey AS a, b, 'left' AS side FROM region CROSS JOIN (VALUES (0), (1), (2), (3), (4), (30)) v(b) WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey = b)",
)
def r5(t: Tables) -> DataFrame:
    wanted = t.region.select(F.col("r_regionkey").alias("a")).crossJoin(t.spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 30)], "b int"))
    there = t.nation.select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"))
    return joins.key_difference(wanted, there, ["a", "b"]).where("side = 'left'")


@query(
    "r6_r7_window_plan",
    f"""WITH a AS {ARMS}, s AS (SELECT stratum FROM a WHERE arm <> 'outside' GROUP BY 1 HAVING count(DISTINCT arm) = 2), n AS (SELECT stratum, arm, count(*) AS n FROM a WHERE arm <> 'outside' AND stratum IN (SELECT stratum FROM s) GROUP BY 1, 2)
 SELECT arm, count(*) AS n_passes, round(sum(CASE arm WHEN 'afternoon' THEN 1 ELSE -1 END * 1.0 / ((SELECT count(*) FROM s) * n)), 6) AS signed_sum FROM (SELECT a.arm, n FROM a JOIN n ON a.stratum = n.stratum AND a.arm = n.arm) GROUP BY 1""",
)
def r6(t: Tables) -> DataFrame:
    w = design.balanced_weights(arms(t), "stratum", "arm", ("morning", "afternoon")).where("weight > 0")
    sign = F.when(F.col("arm") == "afternoon", F.col("weight")).otherwise(-F.col("weight"))
    return w.groupBy("arm").agg(F.count("*").alias("n_passes"), F.round(F.sum(sign), 6).alias("signed_sum"))


@query("r8_group_nesting", "SELECT max(n) = 1 AS nested, count(*) AS n_blocks FROM (SELECT block, count(DISTINCT grp) AS n FROM {cells} GROUP BY 1)")
def r8(t: Tables) -> DataFrame:
    per = t.cells.groupBy("block").agg(F.count_distinct("grp").alias("n"))
    return per.agg((F.max("n") == 1).alias("nested"), F.count("*").alias("n_blocks"))


@query("r9_quantile_validation", "SELECT block, q[1] <= q[2] AND q[2] <= q[3] AND q[1] >= 0 AND q[3] <= 1 AS valid FROM (SELECT block, quantile_cont(x, [0.1, 0.5, 0.9]) AS q FROM {cells} GROUP BY 1)")
def r9(t: Tables) -> DataFrame:
    p, q = aggregates.profile(t.cells, ["block"], "x", [0.1, 0.5, 0.9]), F.col("quantiles")
    return p.select("block", ((q[0] <= q[1]) & (q[1] <= q[2]) & (q[0] >= 0) & (q[2] <= 1)).alias("valid"))


@query("r10_estimate_from_draws", "SELECT user_id, round(-0.1 * avg(value), 10) AS cooling, round(quantile_cont(-0.1 * value, 0.025), 10) AS q025, round(quantile_cont(-0.1 * value, 0.975), 10) AS q975, round(stddev_samp(-0.1 * value), 10) AS se FROM events GROUP BY 1")
def r10(t: Tables) -> DataFrame:
    from swathkit.operators import inference

    d = t.events.withColumn("c", physics.cooling_effect(F.col("value")))
    s = inference.interval_summary(d, ["user_id"], "c").join(d.groupBy("user_id").agg(F.avg("c").alias("cooling")), "user_id")
    return rounded(s.select("user_id", "cooling", "q025", "q975", "se"), 10)


@query(
    "r11_window_fallback",
    """SELECT p.event_id, round(a.total, 8) AS primary_total, round(b.total, 8) AS fallback_total, round(coalesce(a.total, b.total), 8) AS used FROM {passes} p LEFT JOIN (SELECT event_id, CASE WHEN count(h.hour) = 24 THEN sum(v) END AS total FROM (SELECT event_id, ts, unnest(range(1, 25)) AS back FROM {passes}) q
 LEFT JOIN (SELECT date_trunc('hour', ts) AS hour, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) h ON epoch_us(h.hour) = epoch_us(date_trunc('hour', q.ts)) - back * 3600000000 GROUP BY 1) a ON a.event_id = p.event_id
 LEFT JOIN (SELECT event_id, CASE WHEN count(h.hour) = 24 THEN sum(v) END AS total FROM (SELECT event_id, ts, unnest(range(1, 25)) AS back FROM {passes}) q LEFT JOIN {hourly} h ON epoch_us(h.hour) = epoch_us(date_trunc('hour', q.ts)) - back * 3600000000 GROUP BY 1) b ON b.event_id = p.event_id""",
)
def r11(t: Tables) -> DataFrame:
    views = t.events.where("event_type = 'view'").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v"))
    total = lambda series, name: joins.trailing_totals(t.passes, series, ["event_id"], "ts", "hour", "v", 24).select("event_id", F.col("total").alias(name))
    both = t.passes.select("event_id").join(total(views, "primary_total"), "event_id", "left").join(total(t.hourly, "fallback_total"), "event_id", "left")
    return rounded(both.withColumn("used", F.coalesce("primary_total", "fallback_total")), 8)


_LOOKUPS = ("place", "suppliers", "customers", "orders", "fits", "parts", "events")


@query(
    "r13_results_packet",
    """WITH f AS (SELECT CAST(floor(l_suppkey / CAST(k AS DOUBLE)) AS BIGINT) AS g, k, s_nationkey AS key, block_n, sxy, sxx FROM (SELECT l_suppkey, count(*) AS block_n, regr_sxy(l_extendedprice, l_discount) AS sxy, regr_sxx(l_extendedprice, l_discount) AS sxx FROM lineitem GROUP BY 1) JOIN supplier ON s_suppkey = l_suppkey CROSS JOIN (VALUES (1), (2), (4), (8)) v(k)),
 e AS (SELECT key, k, count(DISTINCT g) AS n_groups, CAST(sum(block_n) AS BIGINT) AS n_cells, sum(sxy) / sum(sxx) AS slope FROM f GROUP BY 1, 2),
 p AS (SELECT n_nationkey AS nation, z.k AS size_km, r_name AS region, s.n AS n_suppliers, c.n AS n_customers, o.n AS n_orders, n_groups, n_cells, round(slope, 4) AS slope, q.n AS n_parts, v.n AS n_events,
 concat_ws('|', CASE WHEN r_name IS NULL THEN 'place' END, CASE WHEN s.n IS NULL THEN 'suppliers' END, CASE WHEN c.n IS NULL THEN 'customers' END, CASE WHEN o.n IS NULL THEN 'orders' END, CASE WHEN n_cells IS NULL THEN 'fits' END, CASE WHEN q.n IS NULL THEN 'parts' END, CASE WHEN v.n IS NULL THEN 'events' END) AS missing
 FROM nation CROSS JOIN (VALUES (1), (2), (4), (8)) z(k) LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT s_nationkey AS key, count(*) AS n FROM supplier GROUP BY 1) s ON s.key = n_nationkey
 LEFT JOIN (SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY 1) c ON c.key = n_nationkey LEFT JOIN (SELECT c_nationkey AS key, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000 GROUP BY 1) o ON o.key = n_nationkey
 LEFT JOIN e ON e.key = n_nationkey AND e.k = z.k LEFT JOIN (SELECT s_nationkey AS key, count(DISTINCT l_partkey) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) q ON q.key = n_nationkey LEFT JOIN (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1) v ON v.key = n_nationkey)
 SELECT *, round(min(slope) OVER (PARTITION BY region), 4) AS region_low, round(max(slope) OVER (PARTITION BY region), 4) AS region_high, 'lineitem+supplier' AS fit_source FROM p""",
)
def r13(t: Tables) -> DataFrame:
    """A row per nation and group size: seven keyed lookups, what is missing, where fits come from, ranges by region."""
    sizes = t.spark.createDataFrame([(1,), (2,), (4,), (8,)], "size_km int")
    spine = t.nation.select(F.col("n_nationkey").alias("nation"), "n_regionkey").crossJoin(F.broadcast(sizes))
    count = lambda df, key, name: df.groupBy(F.col(key).alias("nation")).agg(F.count("*").alias(name))
    home = t.supplier.select(F.col("s_suppkey").alias("block"), F.col("s_nationkey").alias("nation"))
    blocks = joins.keyed_join(within.centred_products(t.cells, "block", ["x"], ["y"]), home, ["block"]).crossJoin(F.broadcast(sizes))
    fits = blocks.groupBy("nation", "size_km").agg(
        F.count_distinct(F.floor(F.col("block") / F.col("size_km"))).alias("n_groups"), F.sum("n").alias("n_cells"), F.round(F.sum("xy_0_0") / F.sum("xx_0_0"), 4).alias("slope")
    )
    parts = t.cells.select("block", "word").join(home, "block").groupBy("nation").agg(F.count_distinct("word").alias("n_parts"))
    large = t.orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 450000").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    out = joins.keyed_join(spine, t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")), ["n_regionkey"], "left").drop("n_regionkey")
    for table, key in (
        (count(t.supplier, "s_nationkey", "n_suppliers"), ["nation"]), (count(t.customer, "c_nationkey", "n_customers"), ["nation"]), (count(large, "c_nationkey", "n_orders"), ["nation"]),
        (fits, ["nation", "size_km"]), (parts, ["nation"]), (count(t.events, "user_id", "n_events"), ["nation"]),
    ):
        out = joins.keyed_join(out, table, key, "left")
    have = ("region", "n_suppliers", "n_customers", "n_orders", "n_cells", "n_parts", "n_events")
    w = W.partitionBy("region")  # a region's nations at four sizes
    return out.withColumns(
        {
            "missing": F.concat_ws("|", *(F.when(F.col(c).isNull(), name) for c, name in zip(have, _LOOKUPS, strict=True))),
            "region_low": F.min("slope").over(w), "region_high": F.max("slope").over(w), "fit_source": F.lit("lineitem+supplier"),
        }
    )


@query(
    "r14_conflicting_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_versions FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1",
)
def r14(t: Tables) -> DataFrame:
    return select.merge_agreeing(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"])[1]


@query("r15_cyclic_clock_difference", "SELECT event_id, round((d - 24 * floor(d / 24) - 12) * 3600, 4) AS seconds FROM (SELECT event_id, extract('hour' FROM ts) - (event_id % 24) + 12.0 AS d FROM events)")
def r15(t: Tables) -> DataFrame:
    return rounded(t.events.select("event_id", clock.clock_difference_seconds(F.hour("ts").cast("double"), F.col("event_id") % 24).alias("seconds")), 4)


@query("r17_c10_union_with_blanks", "SELECT event_type, count(*) AS n, count(value) AS n_values FROM (SELECT event_type, value FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_type, NULL FROM events WHERE user_id % 2 = 1) GROUP BY 1")
def r17(t: Tables) -> DataFrame:
    main = t.events.where("user_id % 2 = 0").select("event_type", "value")
    held = t.events.where("user_id % 2 = 1").select("event_type")
    return main.unionByName(held, allowMissingColumns=True).groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


@query("r19_query_definitions", "SELECT r_name || ':' || y AS definition, r_name, y AS year FROM region CROSS JOIN (SELECT unnest(range(2019, 2026)) AS y)")
def r19(t: Tables) -> DataFrame:
    years = t.spark.range(2019, 2026).select(F.col("id").alias("year"))
    out = t.region.select("r_name").crossJoin(F.broadcast(years))
    return out.select(F.concat_ws(":", "r_name", F.col("year").cast("string")).alias("definition"), "r_name", "year")


_MONTHS = "(SELECT DISTINCT strftime(ts, '%m') AS month FROM events)"
_SLOTS = "(VALUES ('morning'), ('afternoon'), ('other'))"


@query(
    "r20_archive_audit",
    f"""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1),
 o AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) - INTERVAL 7 HOUR AS local, count(DISTINCT event_type) AS tiles, avg(value) AS cloud FROM d GROUP BY 1, 2),
 p AS (SELECT strftime(day, '%m') AS month, CASE WHEN extract('hour' FROM local) BETWEEN 6 AND 11 THEN 'morning' WHEN extract('hour' FROM local) BETWEEN 12 AND 18 THEN 'afternoon' ELSE 'other' END AS slot, tiles >= 2 AND cloud < 60 AND c_custkey IS NOT NULL AS usable FROM o LEFT JOIN customer ON c_custkey = user_id),
 g AS (SELECT month, slot, count(*) AS n, count(*) FILTER (WHERE usable) AS n_usable FROM p GROUP BY 1, 2),
 s AS (SELECT m.month, v.slot, coalesce(n, 0) AS n, coalesce(n_usable, 0) AS n_usable FROM {_MONTHS} m CROSS JOIN {_SLOTS} v(slot) LEFT JOIN g ON g.month = m.month AND g.slot = v.slot),
 b AS (SELECT month FROM s WHERE slot <> 'other' AND n_usable > 0 GROUP BY 1 HAVING count(*) = 2)
 SELECT month, slot, n, n_usable, month IN (SELECT month FROM b) AND slot <> 'other' AS candidate, CASE WHEN month IN (SELECT month FROM b) AND slot <> 'other' THEN round(1.0 / ((SELECT count(*) FROM b) * n_usable), 8) ELSE 0 END AS weight FROM s""",
)
def r20(t: Tables) -> DataFrame:
    """Latest revisions, orbits by day, local slot, place and cloud, dense counts by month and slot, balanced weights."""
    day = t.events.withColumn("day", F.to_date("ts"))
    latest = select.latest_revision(day, ["user_id", "event_type", "day"], ["ts", "event_id"])
    orbits = latest.groupBy("user_id", "day").agg(F.min("ts").alias("first"), F.count_distinct("event_type").alias("tiles"), aggregates.compared_mean("value", "60").alias("cloud"))
    hour = F.hour(F.col("first") - F.expr("interval 7 hours"))
    slot = F.when(hour.between(6, 11), "morning").when(hour.between(12, 18), "afternoon").otherwise("other")
    placed = orbits.join(t.customer.select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("placed")), "user_id", "left")
    usable = (F.col("tiles") >= 2) & (F.col("cloud") < 0) & F.coalesce("placed", F.lit(False))
    counts = placed.groupBy(F.date_format("day", "MM").alias("month"), slot.alias("slot")).agg(F.count("*").alias("n"), F.count_if(usable).alias("n_usable"))
    spine = t.events.select(F.date_format("ts", "MM").alias("month")).distinct().crossJoin(t.spark.createDataFrame([("morning",), ("afternoon",), ("other",)], "slot string"))
    dense = spine.join(counts, ["month", "slot"], "left").na.fill(0, ["n", "n_usable"])
    both = dense.where("slot <> 'other' and n_usable > 0").groupBy("month").agg(F.count("*").alias("k")).where("k = 2").select("month", F.lit(True).alias("both"))
    held = dense.join(both, "month", "left").withColumn("candidate", F.coalesce("both", F.lit(False)) & (F.col("slot") != "other"))
    strata = both.agg(F.count("*").alias("strata"))  # one row
    weight = F.when(F.col("candidate"), F.round(1.0 / (F.col("strata") * F.col("n_usable")), 8)).otherwise(F.lit(0.0))
    return held.join(F.broadcast(strata)).select("month", "slot", "n", "n_usable", "candidate", weight.alias("weight"))


@query(
    "r21_cloud_point_screen",
    "SELECT pass, round(avg(CASE WHEN clear THEN 1.0 ELSE 0 END), 6) AS clear_share, count(*) AS n FROM (SELECT pass, block, bool_or(word % 3 = 0) AS clear FROM {cells} GROUP BY 1, 2) GROUP BY 1",
)
def r21(t: Tables) -> DataFrame:
    points = t.cells.groupBy("pass", "block").agg(F.bool_or(F.col("word") % 3 == 0).alias("clear"))
    return points.groupBy("pass").agg(F.round(F.avg(F.col("clear").cast("double")), 6).alias("clear_share"), F.count("*").alias("n"))


@query(
    "r12_step_assembly",
    """WITH p AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%m') AS month, CASE WHEN extract('hour' FROM ts) < 12 THEN 'morning' ELSE 'afternoon' END AS arm, date_trunc('hour', ts) AS lo, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hi, (epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 3600000000.0 AS w FROM {passes}),
 c AS (SELECT p.*, CASE WHEN w = 0 THEN a.v ELSE (1 - w) * a.v + w * b.v END AS air, r.total AS rain FROM p LEFT JOIN {hourly} a ON a.hour = p.lo LEFT JOIN {hourly} b ON b.hour = p.hi
 LEFT JOIN (SELECT event_id, CASE WHEN count(h.hour) = 24 THEN sum(v) END AS total FROM (SELECT event_id, ts, unnest(range(1, 25)) AS back FROM {passes}) q LEFT JOIN {hourly} h ON epoch_us(h.hour) = epoch_us(date_trunc('hour', q.ts)) - back * 3600000000 GROUP BY 1) r ON r.event_id = p.event_id),
 d AS (SELECT month, arm, day, count(*) AS n FROM c GROUP BY 1, 2, 3), l AS (SELECT month, arm, min(total - n) AS fewest_left FROM (SELECT *, sum(n) OVER (PARTITION BY month, arm) AS total FROM d) GROUP BY 1, 2)
 SELECT c.month AS month, c.arm AS arm, count(*) AS n, count(air) AS n_weather, count(rain) AS n_rain, round(avg(air), 6) AS air, round(avg(rain), 4) AS rain, CAST(max(fewest_left) AS BIGINT) AS fewest_left FROM c JOIN l ON l.month = c.month AND l.arm = c.arm GROUP BY 1, 2""",
)
def r12(t: Tables) -> DataFrame:
    """Conditions of each pass (weather between hours, 24 hours of rain), counts by month and arm, fewest left when a day goes."""
    p = t.passes.select("event_id", "ts")
    air = joins.bracket(p, t.hourly, "ts", "hour", ["v"]).select("event_id", F.col("v").alias("air"))
    rain = joins.trailing_totals(p, t.hourly, ["event_id"], "ts", "hour", "v", 24).select("event_id", F.col("total").alias("rain"))
    c = p.join(air, "event_id", "left").join(rain, "event_id", "left").withColumns(
        {"month": F.date_format("ts", "MM"), "day": F.to_date("ts"), "arm": F.when(F.hour("ts") < 12, "morning").otherwise("afternoon")}
    )
    by_day = c.groupBy("month", "arm", "day").agg(F.count("*").alias("k"), F.count("air").alias("ka"), F.sum("air").alias("sa"), F.count("rain").alias("kr"), F.sum("rain").alias("sr"))
    out = by_day.groupBy("month", "arm").agg(
        F.sum("k").alias("n"), F.sum("ka").alias("n_weather"), F.sum("kr").alias("n_rain"), F.round(F.sum("sa") / F.sum("ka"), 6).alias("air"),
        F.round(F.sum("sr") / F.sum("kr"), 4).alias("rain"), (F.sum("k") - F.max("k")).alias("fewest_left"),
    )
    return out


@query(
    "r12_r22_batch_priority",
    """WITH v AS (SELECT pass, round(sum(y), 2) AS total FROM {cells} GROUP BY 1), g AS (SELECT total, lead(total) OVER (ORDER BY total) AS nxt FROM v), c AS (SELECT max(nxt) AS cut FROM g WHERE nxt - total = (SELECT max(nxt - total) FROM g)),
 p AS (SELECT pass, total, total >= cut AS first FROM v CROSS JOIN c) SELECT pass, first, round(1.0 / count(*) OVER (PARTITION BY first) / (SELECT count(DISTINCT first) FROM p), 8) AS weight FROM p""",
)
def r22(t: Tables) -> DataFrame:
    """Passes above the widest gap of totals come first; both batches weigh the same, and passes inside a batch too."""
    totals = t.cells.groupBy("pass").agg(F.round(F.sum("y"), 2).alias("total"))
    cut = design.natural_gap(totals, "total").select("high")  # one row
    batches = totals.join(F.broadcast(cut)).select("pass", (F.col("total") >= F.col("high")).alias("first"))
    sizes = batches.groupBy("first").agg(F.count("*").alias("n"))
    return batches.join(sizes, "first").join(F.broadcast(sizes.agg(F.count("*").alias("k")))).select("pass", "first", F.round(1.0 / F.col("n") / F.col("k"), 8).alias("weight"))


@query("r16_r23_r25_precision_union", "SELECT block, 'original' AS role, round(avg(y), 4) AS m, count(*) AS n FROM {cells} WHERE pass < '1998-01' GROUP BY 1 UNION ALL SELECT block, 'added', round(avg(y), 4), count(*) FROM {cells} WHERE pass >= '1998-01' GROUP BY 1")
def r23(t: Tables) -> DataFrame:
    part = lambda c, role: t.cells.where(c).groupBy("block").agg(F.avg("y").alias("m"), F.count("*").alias("n")).withColumn("role", F.lit(role))
    return rounded(part("pass < '1998-01'", "original").unionByName(part("pass >= '1998-01'", "added")), 4)


def _equivalent_sql(flux: str, kelvin: float) -> str:
    anchor = f"(0.97 * 5.670374419e-8 * power({kelvin}, 4))"
    return f"round({kelvin} * (power(({anchor} - {flux}) / {anchor}, 0.25) - 1), 6)"


@query(
    "r24_retained_and_excluded",
    f"""WITH n AS (SELECT count(DISTINCT pass) AS passes FROM {{cells}}), k AS (SELECT block, count(DISTINCT pass) = (SELECT passes FROM n) AS kept FROM {{cells}} GROUP BY 1),
 a AS (SELECT c.block, x, y, kept FROM {{cells}} c JOIN k ON k.block = c.block), r AS (SELECT 'original' AS role, * FROM a UNION ALL SELECT CASE WHEN kept THEN 'retained' ELSE 'excluded' END, * FROM a),
 b AS (SELECT role, block, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx FROM r GROUP BY 1, 2), f AS (SELECT role, sum(sxy) / sum(sxx) AS slope FROM b GROUP BY 1),
 d AS (SELECT role, count(*) AS n, count(DISTINCT block) AS blocks, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, avg(y) AS m FROM r GROUP BY 1)
 SELECT d.role AS role, n, blocks, p10, p50, p90, round(m, 4) AS mean, round(slope, 3) AS slope, round(slope - (SELECT slope FROM f WHERE role = 'original'), 3) + 0.0 AS slope_change, {_equivalent_sql("m / 1000", 290.0)} AS eq_290, {_equivalent_sql("m / 1000", 310.0)} AS eq_310 FROM d JOIN f ON f.role = d.role""",
)
def r24(t: Tables) -> DataFrame:
    """Cells of blocks that all passes hold, the others, and both: distributions, slopes against the original's, two references."""
    passes = t.cells.agg(F.count_distinct("pass").alias("passes"))  # one row
    kept = t.cells.groupBy("block").agg(F.count_distinct("pass").alias("held")).join(F.broadcast(passes)).select("block", (F.col("held") == F.col("passes")).alias("kept"))
    roles = F.explode(F.array(F.lit("original"), F.when(F.col("kept"), "retained").otherwise("excluded")))
    cells = t.cells.join(kept, "block").select("block", "x", "y", roles.alias("role"))
    slopes = cells.groupBy("role", "block").agg(F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx")).groupBy("role").agg((F.sum("sxy") / F.sum("sxx")).alias("slope"))
    base = slopes.where("role = 'original'").select(F.col("slope").alias("base"))  # one row
    q = ranks.quantile_columns(cells, ["role"], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    d = cells.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("block").alias("blocks"), F.avg("y").alias("m")).join(q, "role")
    eq = lambda k: F.round(physics.temperature_equivalent(-F.col("m") / 1000, F.lit(k), F.lit(0.97)), 6)
    return d.join(slopes, "role").join(F.broadcast(base)).select(
        "role", "n", "blocks", *(F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")), F.round("m", 4).alias("mean"),
        F.round("slope", 3).alias("slope"), (F.round(F.col("slope") - F.col("base"), 3) + 0.0).alias("slope_change"), eq(290.0).alias("eq_290"), eq(310.0).alias("eq_310"),
    )


@query(
    "r26_predictor_audit",
    """WITH b AS (SELECT grp, block, max(x) - min(x) AS span, count(*) FILTER (WHERE x <= 0.02) AS low, count(*) FILTER (WHERE x >= 0.08) AS high, count(DISTINCT tax) > 1 AS tax_varies, count(DISTINCT qty) > 1 AS qty_varies FROM {cells} GROUP BY 1, 2),
 s AS (SELECT stddev_pop(tax) AS st, stddev_pop(qty) AS sq FROM {cells}), p AS (SELECT grp, avg(tax) FILTER (WHERE x <= 0.02) AS tl, avg(tax) FILTER (WHERE x >= 0.08) AS th, avg(qty) FILTER (WHERE x <= 0.02) AS ql, avg(qty) FILTER (WHERE x >= 0.08) AS qh FROM {cells} GROUP BY 1)
 SELECT b.grp AS grp, count(*) AS blocks, round(quantile_cont(span, 0.5), 6) AS mid_span, count(*) FILTER (WHERE low > 0 AND high > 0) AS spanning, count(*) FILTER (WHERE tax_varies) AS tax_blocks, count(*) FILTER (WHERE qty_varies) AS qty_blocks,
 CAST(sum(low) AS BIGINT) AS low_pool, CAST(sum(high) AS BIGINT) AS high_pool, round(max(sqrt(power((tl - th) / st, 2) + power((ql - qh) / sq, 2))), 6) AS pool_distance FROM b JOIN p ON p.grp = b.grp CROSS JOIN s GROUP BY 1""",
)
def r26(t: Tables) -> DataFrame:
    """Per group: spans, blocks that hold both endpoints, blocks in which controls vary, endpoint pools and how far apart they lie."""
    low, high = F.col("x") <= 0.02, F.col("x") >= 0.08
    b = t.cells.groupBy("grp", "block").agg(
        (F.max("x") - F.min("x")).alias("span"), F.count_if(low).alias("low"), F.count_if(high).alias("high"),
        (F.max("tax") > F.min("tax")).alias("tax_varies"), (F.max("qty") > F.min("qty")).alias("qty_varies"),
    )
    mean = lambda c, at, name: F.avg(F.when(at, F.col(c))).alias(name)
    pools = t.cells.groupBy("grp").agg(mean("tax", low, "tl"), mean("tax", high, "th"), mean("qty", low, "ql"), mean("qty", high, "qh"))
    scale = t.cells.agg(F.stddev_pop("tax").alias("st"), F.stddev_pop("qty").alias("sq"))  # one row
    apart = pools.join(F.broadcast(scale)).select("grp", F.round(F.hypot((F.col("tl") - F.col("th")) / F.col("st"), (F.col("ql") - F.col("qh")) / F.col("sq")), 6).alias("pool_distance"))
    out = b.groupBy("grp").agg(
        F.count("*").alias("blocks"), F.round(F.percentile("span", 0.5), 6).alias("mid_span"), F.count_if((F.col("low") > 0) & (F.col("high") > 0)).alias("spanning"),
        F.count_if("tax_varies").alias("tax_blocks"), F.count_if("qty_varies").alias("qty_blocks"), F.sum("low").alias("low_pool"), F.sum("high").alias("high_pool"),
    )
    return out.join(apart, "grp")


@query(
    "r27_bounded_sample_per_band",
    """WITH s AS (SELECT * FROM (SELECT x, word, block, row_number() OVER (PARTITION BY x ORDER BY sha256(cell_id)) AS k FROM {cells}) WHERE k <= 2000), r AS (SELECT x, word, count(*) AS times, count(DISTINCT block) = 1 AS constant FROM s GROUP BY 1, 2 HAVING count(*) > 1),
 n AS (SELECT x, count(*) AS n FROM s GROUP BY 1) SELECT n.x AS x, n, (SELECT min(n) FROM n) AS pool, coalesce(max(q.recurring), 0) AS recurring, coalesce(max(q.constant), 0) AS constant FROM n LEFT JOIN (SELECT x, count(*) AS recurring, count(*) FILTER (WHERE constant) AS constant FROM r GROUP BY 1) q ON q.x = n.x GROUP BY 1, 2""",
)
def r27(t: Tables) -> DataFrame:
    """A seeded sample of 2,000 cells a band at most, words that recur in it and keep their block, and the size of equal pools."""
    sample = select.hash_sample(t.cells, ["x"], F.col("cell_id"), 2000).select("x", "word", "block")
    words = sample.groupBy("x", "word").agg(F.count("*").alias("times"), (F.count_distinct("block") == 1).alias("constant"))
    bands = words.groupBy("x").agg(F.sum("times").alias("n"), F.count_if(F.col("times") > 1).alias("recurring"), F.count_if((F.col("times") > 1) & F.col("constant")).alias("constant"))
    return bands.join(F.broadcast(bands.agg(F.min("n").alias("pool"))))  # one row


_YEARS = "(SELECT *, CAST(left(pass, 4) AS INTEGER) AS year FROM {cells})"


@query(
    "r29_r30_r31_r36_fit_at_scales",
    f"""WITH b AS (SELECT year, block, count(*) AS n, regr_sxy(y, x) AS xy, regr_sxx(y, x) AS xx FROM {_YEARS} GROUP BY 1, 2),
 g AS (SELECT year, k AS size, CAST(floor(block / CAST(k AS DOUBLE)) AS BIGINT) AS g, sum(n) AS n, count(*) AS blocks, sum(xy) AS xy, sum(xx) AS xx FROM b CROSS JOIN (VALUES (1), (2), (4), (8), (100000)) v(k) GROUP BY 1, 2, 3),
 t AS (SELECT year, size, count(*) AS groups, sum(n) AS n, sum(blocks) AS blocks, sum(xy) / sum(xx) AS slope, sum(xx) AS xx FROM g GROUP BY 1, 2)
 SELECT t.year AS year, t.size AS size, CAST(max(groups) AS BIGINT) AS groups, CASE WHEN max(groups) < 2 OR max(t.n - t.blocks - 1) <= 0 THEN 'NOT_ESTIMABLE' ELSE 'OK' END AS status, CASE WHEN max(groups) >= 2 AND max(t.n - t.blocks - 1) > 0 THEN round(max(slope), 3) END AS slope,
 CASE WHEN max(groups) >= 2 AND max(t.n - t.blocks - 1) > 0 THEN round(sqrt(sum(power(g.xy - g.xx * slope, 2)) * max(groups / (groups - 1.0) * (t.n - 1) / (t.n - t.blocks - 1))) / max(t.xx), 3) END AS cluster_se FROM t JOIN g ON g.year = t.year AND g.size = t.size GROUP BY 1, 2""",
)
def r30(t: Tables) -> DataFrame:
    """A fit per year and group size with its clustered error; what cannot be fitted is a row that says so."""
    cells = t.cells.withColumn("year", F.substring("pass", 1, 4).cast("int"))
    sizes = t.spark.createDataFrame([(1,), (2,), (4,), (8,), (100_000,)], "size int")
    b = cells.groupBy("year", "block").agg(F.count("*").alias("n"), F.regr_sxy("y", "x").alias("xy"), F.regr_sxx("y", "x").alias("xx"))
    g = b.crossJoin(F.broadcast(sizes)).groupBy("year", "size", F.floor(F.col("block") / F.col("size")).alias("g")).agg(
        F.sum("n").alias("n"), F.count("*").alias("blocks"), F.sum("xy").alias("xy"), F.sum("xx").alias("xx")
    )
    whole = g.groupBy("year", "size").agg(
        F.count("*").alias("groups"), (F.sum("n") - F.sum("blocks") - 1).alias("dof"), F.sum("n").alias("cells"), (F.sum("xy") / F.sum("xx")).alias("slope"), F.sum("xx").alias("sxx")
    )
    score = F.col("xy") - F.col("xx") * F.col("slope")
    out = g.join(F.broadcast(whole), ["year", "size"]).groupBy("year", "size", "groups", "dof", "cells", "slope", "sxx").agg(F.sum(score * score).alias("meat"))  # years x sizes
    ok = (F.col("groups") >= 2) & (F.col("dof") > 0)
    se = F.sqrt(F.col("meat") * F.col("groups") / (F.col("groups") - 1) * (F.col("cells") - 1) / F.col("dof")) / F.col("sxx")
    return out.select(
        "year", "size", "groups", F.when(ok, "OK").otherwise("NOT_ESTIMABLE").alias("status"), F.when(ok, F.round("slope", 3)).alias("slope"), F.when(ok, F.round(se, 3)).alias("cluster_se")
    )


@query(
    "r31_registration_refits",
    """WITH c AS (SELECT block, pass, avg(x) AS x, avg(y) AS y FROM {cells} GROUP BY 1, 2), s AS (SELECT a.block, a.pass, a.y, a.x AS x0, b.x AS x1, d.x AS x2 FROM c a JOIN c b ON b.block = a.block + 1 AND b.pass = a.pass JOIN c d ON d.block = a.block + 2 AND d.pass = a.pass),
 l AS (SELECT 0 AS shift, block, pass, y, x0 AS x FROM s UNION ALL SELECT 1, block, pass, y, x1 FROM s UNION ALL SELECT 2, block, pass, y, x2 FROM s), b AS (SELECT shift, block, regr_sxy(y, x) AS xy, regr_sxx(y, x) AS xx, count(*) AS n FROM l GROUP BY 1, 2), f AS (SELECT shift, sum(n) AS n, sum(xy) / sum(xx) AS slope FROM b GROUP BY 1)
 SELECT shift, CAST(n AS BIGINT) AS n, round(slope, 3) AS slope, round(slope - (SELECT slope FROM f WHERE shift = 0), 3) AS from_baseline FROM f""",
)
def r31(t: Tables) -> DataFrame:
    """Refits with the predictor of the block one or two places on, over the cells that every shift has; differences from no shift."""
    c = t.cells.groupBy("block", "pass").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    moved = c.select("pass", F.explode(F.array(*(F.struct(F.lit(k).alias("shift"), (F.col("block") - k).alias("block")) for k in (0, 1, 2)))).alias("s"), "x").select("pass", "s.*", "x")
    common = moved.groupBy("block", "pass").agg(F.count("*").alias("k")).where("k = 3").select("block", "pass")
    cells = moved.join(common, ["block", "pass"]).join(c.select("block", "pass", "y"), ["block", "pass"])
    b = cells.groupBy("shift", "block").agg(F.regr_sxy("y", "x").alias("xy"), F.regr_sxx("y", "x").alias("xx"), F.count("*").alias("n"))
    f = b.groupBy("shift").agg(F.sum("n").alias("n"), (F.sum("xy") / F.sum("xx")).alias("slope"))
    base = f.where("shift = 0").select(F.col("slope").alias("base"))  # one row
    return f.join(F.broadcast(base)).select("shift", "n", F.round("slope", 3).alias("slope"), F.round(F.col("slope") - F.col("base"), 3).alias("from_baseline"))


@query(
    "r36_scale_diagnostics",
    f"""WITH p AS (SELECT n_regionkey AS city, pass < '1995-07' AS early, k, CAST(floor(block / CAST(k AS DOUBLE)) AS BIGINT) AS g, x, y FROM {{cells}} JOIN supplier ON s_suppkey = block JOIN nation ON n_nationkey = s_nationkey CROSS JOIN (VALUES (1), (4)) v(k)),
 b AS (SELECT city, early, k, g, regr_sxy(y, x) AS xy, regr_sxx(y, x) AS xx, avg(y) AS m FROM p GROUP BY 1, 2, 3, 4), f AS (SELECT city, early, k, sum(xy) / sum(xx) AS slope, avg(m) AS m FROM b GROUP BY 1, 2, 3),
 c AS (SELECT k, early, avg(slope) AS slope, avg(m) AS m, count(*) AS cities FROM f GROUP BY 1, 2)
 SELECT a.k AS size, CAST(a.cities AS BIGINT) AS cities, round(a.slope, 3) AS early_slope, round(b.slope, 3) AS late_slope, round(b.slope - a.slope, 3) AS contrast, {_equivalent_sql("a.m / 1000", 290.0)} AS early_290, {_equivalent_sql("b.m / 1000", 310.0)} AS late_310 FROM c a JOIN c b ON a.k = b.k AND a.early AND NOT b.early""",
)
def r36(t: Tables) -> DataFrame:
    """By group size: slopes in two periods averaged over cities of equal weight, their contrast, means at two references."""
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("city"))
    place = t.supplier.select(F.col("s_suppkey").alias("block"), "s_nationkey").join(nation, "s_nationkey").select("block", "city")
    sizes = t.spark.createDataFrame([(1,), (4,)], "size int")
    p = t.cells.select("block", "x", "y", (F.col("pass") < "1995-07").alias("early")).join(place, "block").crossJoin(F.broadcast(sizes))
    b = p.groupBy("city", "early", "size", F.floor(F.col("block") / F.col("size")).alias("g")).agg(F.regr_sxy("y", "x").alias("xy"), F.regr_sxx("y", "x").alias("xx"), F.avg("y").alias("m"))
    f = b.groupBy("city", "early", "size").agg((F.sum("xy") / F.sum("xx")).alias("slope"), F.avg("m").alias("m"))
    at = lambda c, early: F.avg(F.when(F.col("early") == early, F.col(c)))
    c = f.groupBy("size").agg(F.count_distinct("city").alias("cities"), at("slope", True).alias("a"), at("slope", False).alias("b"), at("m", True).alias("ma"), at("m", False).alias("mb"))
    eq = lambda m, k: F.round(physics.temperature_equivalent(-F.col(m) / 1000, F.lit(k), F.lit(0.97)), 6)
    return c.select(
        "size", "cities", F.round("a", 3).alias("early_slope"), F.round("b", 3).alias("late_slope"), F.round(F.col("b") - F.col("a"), 3).alias("contrast"), eq("ma", 290.0).alias("early_290"), eq("mb", 310.0).alias("late_310")
    )


@query(
    "r32_pass_window_edges",
    """WITH RECURSIVE e AS (SELECT 'b' || block AS a, 'p' || pass AS b FROM {cells} GROUP BY 1, 2 HAVING count(*) >= 5), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 u AS (SELECT DISTINCT a AS x, a AS y FROM l UNION SELECT u.x, l.b FROM u JOIN l ON l.a = u.y), r AS (SELECT x, min(y) AS root FROM u GROUP BY 1), c AS (SELECT root, count(*) AS n FROM e JOIN r ON r.x = e.a GROUP BY 1)
 SELECT count(*) AS n_components, max(n) / sum(n) AS share FROM c""",
)
def r32(t: Tables) -> DataFrame:
    n = t.cells.groupBy("block", "pass").agg(F.count("*").alias("n")).where("n >= 5")
    edges = n.select(F.concat(F.lit("b"), F.col("block").cast("string")).alias("u"), F.concat(F.lit("p"), "pass").alias("v"))
    return graph.largest_component_share(edges)


@query(
    "r34_r35_static_context_screen",
    f"""WITH g AS (SELECT gx, gy, v, CAST(floor(round(v, 2)) AS BIGINT) % 7 = 0 AS water, CAST(floor(round(v, 2)) AS BIGINT) % 5 IN (2, 3) AS built FROM {GRID_SQL}),
 d AS (SELECT a.gx, a.gy, min(sqrt(power(a.gx - w.gx, 2) + power(a.gy - w.gy, 2))) AS far FROM g a JOIN g w ON w.water GROUP BY 1, 2)
 SELECT CAST(floor(g.gx / 4.0) AS BIGINT) AS bx, CAST(floor(g.gy / 4.0) AS BIGINT) AS by, count(*) AS n, round(avg(CASE WHEN built THEN 1.0 ELSE 0 END), 6) AS built, round(avg(CASE WHEN water THEN 1.0 ELSE 0 END), 6) AS water, round(avg(far), 6) AS to_water,
 round(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 4) AS span, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) >= 1 AS wide FROM g LEFT JOIN d ON d.gx = g.gx AND d.gy = g.gy GROUP BY 1, 2""",
)
def r35(t: Tables) -> DataFrame:
    """Context of blocks of a grid: class fractions, mean distance to water (at any distance), span of values and its screen."""
    code = F.floor(F.round("v", 2))
    g = lattice(t).select("gx", "gy", "v", (code % 7 == 0).alias("water"), (code % 5).isin(2, 3).alias("built"))
    q = F.percentile("v", F.array(F.lit(0.1), F.lit(0.9)))
    out = distance.distance_to_nearest(g, g.where("water"), "gx", "gy", "far").groupBy(F.floor(F.col("gx") / 4).alias("bx"), F.floor(F.col("gy") / 4).alias("by"))
    return out.agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("built").cast("double")), 6).alias("built"), F.round(F.avg(F.col("water").cast("double")), 6).alias("water"),
        F.round(F.avg("far"), 6).alias("to_water"), F.round(q[1] - q[0], 4).alias("span"), (q[1] - q[0] >= 1).alias("wide"),
    )


@query("r37_r38_r39_candidate_counts", "SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderpriority, o_orderdate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) GROUP BY 1, 2")
def r37(t: Tables) -> DataFrame:
    good = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = t.orders.join(good, "o_custkey", "left_semi").dropDuplicates(["o_custkey", "o_orderpriority", "o_orderdate"])
    return rows.groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


@query("r40_ecdf_step", "SELECT event_type, event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 8) AS ecdf FROM events")
def r40(t: Tables) -> DataFrame:
    return rounded(ranks.ecdf(t.events.select("event_type", "event_id", "value"), ["event_type"], "value").drop("value"), 8)


@query("c2_public_columns", "SELECT c_custkey, c_name FROM customer")
def c2(t: Tables) -> DataFrame:
    from swathkit.operators.contracts import require_exact_columns

    return require_exact_columns(t.customer.select("c_custkey", "c_name"), ["c_custkey", "c_name"])


@query("c13_gap_recovery", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS recovered FROM customer WHERE c_acctbal < 0")
def c13(t: Tables) -> DataFrame:
    held = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("there", F.lit(True))
    return t.customer.where("c_acctbal < 0").join(held, "c_custkey", "left").select("c_custkey", F.coalesce("there", F.lit(False)).alias("recovered"))


@query("c14_inventory_union", "SELECT l_partkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS sources, count(*) AS n FROM lineitem GROUP BY 1")
def c14(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.concat_ws("|", F.array_sort(F.collect_set("l_returnflag"))).alias("sources"), F.count("*").alias("n"))


@query("c15_asset_plan", "SELECT DISTINCT l_partkey AS id, l_suppkey BETWEEN 1 AND 90 AS all_there FROM lineitem WHERE l_quantity = 50 UNION SELECT l_orderkey, l_suppkey BETWEEN 1 AND 90 FROM lineitem WHERE l_quantity = 50")
def c15(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_quantity = 50").select(F.explode(F.array("l_partkey", "l_orderkey")).alias("id"), F.col("l_suppkey").between(1, 90).alias("all_there"))
    return rows.distinct()


@query("stream_hourly_means", "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1, 2")
def stream_hourly(t: Tables) -> DataFrame:
    out = windows.hourly_means(t.events, "ts", "value", ["event_type"])
    return rounded(out.select(F.unix_micros("hour").alias("hour_us"), "event_type", "mean", "n"))


@query("r43_pairs_only", PAIRS_ONLY_SQL)
def r43(t: Tables) -> DataFrame:
    return pairs(t).select("pass_id", "sensor", ident.zero_padded(F.col("pre_acq_id").cast("string"), 6).alias("pre"), "post_acq_id")
