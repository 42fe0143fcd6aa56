"""Filters, predicates and derived columns (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.functions import bits, clock, ident, physics
from swathkit.operators import aggregates, select
from swathkit.plans.q_scalars import HOURS, LON
from swathkit.plans.registry import Tables, query, rounded


@query(
    "p1_pass_selection",
    f"""SELECT user_id, event_id, strftime(day, '%Y-%m-%d') AS solar_date FROM (SELECT *, make_timestamp(epoch_us(ts) + CAST(round({LON} / 15.0 * 3600000000.0) AS BIGINT)) AS day,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE value <= 80 AND year(ts) BETWEEN 2019 AND 2025 AND event_type IN ('view', 'click'))
 WHERE k = 1 AND strftime(day, '%m-%d') BETWEEN '01-02' AND '01-20'""",
)
def p1(t: Tables) -> DataFrame:
    picked = select.select_passes(
        t.events.withColumn("ok", F.col("event_type").isin("view", "click")), key=["user_id", "event_type"], time="ts", tie="event_id",
        quality=F.col("ok") & (F.col("value") <= 80), years=(2019, 2025), season=("01-02", "01-20"), longitude=F.lit(LON),
    )
    return picked.select("user_id", "event_id", F.col("solar_date").cast("string").alias("solar_date"))


@query(
    "p2_membership",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
)
def p2(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where(F.col("o_orderstatus").isin("F", "P")).join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query(
    "p3_ranges",
    "SELECT l_quantity, count(*) AS n, count(*) FILTER (WHERE l_discount >= 0.02 AND l_discount < 0.05) AS half_open FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 GROUP BY 1",
)
def p3(t: Tables) -> DataFrame:
    x = F.col("l_discount")
    return t.lineitem.where(F.col("l_quantity").between(10, 20)).groupBy("l_quantity").agg(
        F.count("*").alias("n"), F.count_if((x >= 0.02) & (x < 0.05)).alias("half_open")
    )


@query(
    "p4_windows_of_day",
    f"""SELECT w AS window_name, count(*) AS n FROM (SELECT CASE WHEN h >= 9.5 AND h < 11.5 THEN 'morning' WHEN h >= 11.5 AND h < 15 THEN 'middle' WHEN h >= 15 AND h < 18 THEN 'afternoon' ELSE 'outside' END AS w
 FROM (SELECT {HOURS} AS h FROM events)) GROUP BY 1""",
)
def p4(t: Tables) -> DataFrame:
    return t.events.groupBy(clock.window_of_day(clock.utc_hour(F.col("ts"))).alias("window_name")).agg(F.count("*").alias("n"))


@query(
    "p5_roles",
    "SELECT event_type, CASE WHEN event_type = 'purchase' THEN 'training' WHEN value > 50 THEN 'held_out' ELSE 'reserve' END AS role, count(*) AS n FROM events GROUP BY 1, 2",
)
def p5(t: Tables) -> DataFrame:
    role = F.when(F.col("event_type") == "purchase", "training").when(F.col("value") > 50, "held_out").otherwise("reserve")
    return t.events.groupBy("event_type", role.alias("role")).agg(F.count("*").alias("n"))


@query(
    "p6_p8_quality_masks",
    """SELECT block, count(*) FILTER (WHERE word & 3 <= 1 AND word % 7 <> 0 AND word % 11 <> 0) AS usable, count(*) FILTER (WHERE y > 0 AND x > 0 AND x <= 1) AS physical FROM {cells} GROUP BY 1""",
)
def p6(t: Tables) -> DataFrame:
    usable = bits.usable_cell(F.col("y"), F.col("word"), (F.col("word") % 7 == 0).cast("int"), (F.col("word") % 11 == 0).cast("int"))
    return t.cells.groupBy("block").agg(
        F.count_if(usable).alias("usable"), F.count_if(bits.physical_cell(F.col("y"), F.col("x"))).alias("physical")
    )


@query(
    "p7_bit_fields",
    "SELECT (word >> 6) & 3 AS level, count(*) AS n, count(*) FILTER (WHERE (word >> 1) & 31 = 0 AND (word >> 6) & 3 <= 2) AS clear FROM {cells} GROUP BY 1",
)
def p7(t: Tables) -> DataFrame:
    w = F.col("word")
    return t.cells.groupBy(bits.bits(w, 6, 2).alias("level")).agg(F.count("*").alias("n"), F.count_if(bits.clear_word(w)).alias("clear"))


@query(
    "p9_out_of_range_to_null",
    "SELECT c_nationkey, count(*) AS n, count(CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END) AS kept, round(avg(CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END), 4) AS mean FROM customer GROUP BY 1",
)
def p9(t: Tables) -> DataFrame:
    clean = bits.within_or_null(F.col("c_acctbal"), 0, 5000)
    return t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count(clean).alias("kept"), F.round(F.avg(clean), 4).alias("mean"))


TEXTS = "(SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' 12.5 ' WHEN 1 THEN 'NA' WHEN 2 THEN '' WHEN 3 THEN CAST(o_custkey AS VARCHAR) WHEN 4 THEN 'True' ELSE '1' END AS s FROM orders)"


@query(
    "p10_p11_text_parsing",
    f"""SELECT o_orderkey, number, CASE WHEN number = floor(number) THEN CAST(number AS BIGINT) END AS whole, lower(trim(s)) IN ('true', '1') AS yes FROM
 (SELECT *, CASE WHEN lower(trim(s)) NOT IN ('', 'na', 'nan', 'null', 'none') THEN try_cast(trim(s) AS DOUBLE) END AS number FROM {TEXTS})""",
)
def p10(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 6
    s = F.when(k == 0, " 12.5 ").when(k == 1, "NA").when(k == 2, "").when(k == 3, F.col("o_custkey").cast("string")).when(k == 4, "True").otherwise("1")
    return t.orders.select("o_orderkey", s.alias("s")).select(
        "o_orderkey", ident.text_number(F.col("s")).alias("number"), ident.text_integer(F.col("s")).alias("whole"), ident.text_boolean(F.col("s")).alias("yes")
    )


@query(
    "p12_p14_band_and_threshold",
    "SELECT block, count(*) FILTER (WHERE x BETWEEN greatest(0.0, 0.01 - 0.025) AND least(1.0, 0.01 + 0.025)) AS near_low, max(x) - min(x) >= 0.1 AS wide FROM {cells} GROUP BY 1",
)
def p12(t: Tables) -> DataFrame:
    return t.cells.groupBy("block").agg(
        F.count_if(bits.band(F.col("x"), 0.01, 0.025)).alias("near_low"), (F.max("x") - F.min("x") >= 0.1).alias("wide")
    )


@query(
    "p13_complete_cases",
    "SELECT event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 90 THEN NULL ELSE value END AS v, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS u FROM events) WHERE v IS NOT NULL AND u IS NOT NULL GROUP BY 1",
)
def p13(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.when(F.col("value") <= 90, F.col("value")).alias("v"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("u"))
    return select.complete_cases(rows, ["v", "u"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "p15_failed_criteria",
    """SELECT block, n >= 600 AND m > 0.0499 AND s >= 0.1 AS passed, concat_ws('|', CASE WHEN NOT (n >= 600) THEN 'cells' END, CASE WHEN NOT (m > 0.0499) THEN 'mean' END, CASE WHEN NOT (s >= 0.1) THEN 'span' END) AS failed
 FROM (SELECT block, count(*) AS n, avg(x) AS m, max(x) - min(x) AS s FROM {cells} GROUP BY 1)""",
)
def p15(t: Tables) -> DataFrame:
    g = t.cells.groupBy("block").agg(F.count("*").alias("n"), aggregates.compared_mean("x", "0.0499").alias("m"), (F.max("x") - F.min("x")).alias("s"))
    tests = {"cells": F.col("n") >= 600, "mean": F.col("m") > 0, "span": F.col("s") >= 0.1}
    return g.select("block", (tests["cells"] & tests["mean"] & tests["span"]).alias("passed"), ident.failed_criteria(tests).alias("failed"))


@query("p16_rename", "SELECT c_custkey AS customer, c_acctbal AS balance FROM customer")
def p16(t: Tables) -> DataFrame:
    return select.renamed(t.customer, {"c_custkey": "customer", "c_acctbal": "balance"})


@query(
    "p17_p18_sector_and_quadrant",
    "SELECT CASE WHEN y >= 30000 THEN 'N' ELSE 'S' END || CASE WHEN x >= 0.05 THEN 'E' ELSE 'W' END AS sector, CAST(x >= 0.05 AS INTEGER) + 2 * CAST(y >= 30000 AS INTEGER) AS quadrant, count(*) AS n FROM {cells} GROUP BY 1, 2",
)
def p17(t: Tables) -> DataFrame:
    args = (F.col("x"), F.col("y"), F.lit(0.05), F.lit(30000))
    return t.cells.groupBy(ident.sector(*args).alias("sector"), ident.quadrant(*args).alias("quadrant")).agg(F.count("*").alias("n"))


@query("p19_slope_to_effect", "SELECT block, round(-regr_slope(y, x) * 0.1, 4) AS effect FROM {cells} GROUP BY 1")
def p19(t: Tables) -> DataFrame:
    return rounded(t.cells.groupBy("block").agg(physics.cooling_effect(F.regr_slope("y", "x")).alias("effect")), 4)


@query(
    "p20_ownership",
    "SELECT count(*) FILTER (WHERE x0 - 35 >= lo AND x0 + 35 <= lo + 10000) AS owned, CAST(lo AS BIGINT) AS core FROM (SELECT l_extendedprice AS x0, floor(l_extendedprice / 10000) * 10000 AS lo FROM lineitem) GROUP BY 2",
)
def p20(t: Tables) -> DataFrame:
    from swathkit.operators import grid

    x = F.col("l_extendedprice")
    core = F.floor(x / 10000) * 10000
    return t.lineitem.groupBy(core.cast("bigint").alias("core")).agg(F.count_if(grid.wholly_inside(x, core, 10000.0, 35.0)).alias("owned"))


@query(
    "p21_p22_coverage_and_range",
    """SELECT c.event_type, count(*) AS n, count(*) FILTER (WHERE value BETWEEN m - s AND m + s) AS covered, count(*) FILTER (WHERE NOT value BETWEEN lo AND hi) AS outside FROM events c
 JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi FROM events WHERE event_id % 10 = 0 GROUP BY 1) g ON c.event_type = g.event_type WHERE event_id % 10 <> 0 GROUP BY 1""",
)
def p21(t: Tables) -> DataFrame:
    train = t.events.where("event_id % 10 = 0").groupBy("event_type").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    rest = t.events.where("event_id % 10 <> 0").join(F.broadcast(train), "event_type")  # a row per event type
    v = F.col("value")
    return rest.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(v.between(F.col("m") - F.col("s"), F.col("m") + F.col("s"))).alias("covered"),
        F.count_if(~v.between(F.col("lo"), F.col("hi"))).alias("outside"),
    )


@query(
    "p23_scale_ruling",
    """SELECT grp, CASE WHEN count(*) < 2 THEN 'insufficient' WHEN min(sign(e)) > 0 THEN 'keep' WHEN max(sign(e)) < 0 THEN 'drop' ELSE 'mixed' END AS ruling FROM (SELECT grp, block, -regr_slope(y, x) * 0.1 AS e FROM {cells} GROUP BY 1, 2) GROUP BY 1""",
)
def p23(t: Tables) -> DataFrame:
    effects = t.cells.groupBy("grp", "block").agg(physics.cooling_effect(F.regr_slope("y", "x")).alias("e"))
    low, high = F.min(F.signum("e")), F.max(F.signum("e"))
    ruling = F.when(F.count("*") < 2, "insufficient").when(low > 0, "keep").when(high < 0, "drop").otherwise("mixed")
    return effects.groupBy("grp").agg(ruling.alias("ruling"))
