"""Ranking and window operators (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.operators import design, joins, ranks, select
from swathkit.plans.registry import Tables, query, rounded

REV = ["l_shipdate", "l_partkey", "l_suppkey"]


@query(
    "w1_w2_latest_revision",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1",
)
def w1(t: Tables) -> DataFrame:
    return select.latest_revision(t.lineitem, ["l_orderkey", "l_linenumber"], REV).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("w3_first_per_key", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def w3(t: Tables) -> DataFrame:
    return select.first_per(t.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("w4_last_per_place", "SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1")
def w4(t: Tables) -> DataFrame:
    return select.latest_revision(t.lineitem, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey", "l_orderkey")


@query(
    "w5_w6_group_transform_and_demean",
    "SELECT cell_id, round(x - avg(x) OVER (PARTITION BY block), 8) AS xc, count(*) OVER (PARTITION BY block) AS n, round(median(y) OVER (PARTITION BY block), 4) AS mid FROM {cells}",
)
def w5(t: Tables) -> DataFrame:
    w = W.partitionBy("block")
    return t.cells.select(
        "cell_id", F.round(F.col("x") - F.avg("x").over(w), 8).alias("xc"), F.count("*").over(w).alias("n"), F.round(F.median("y").over(w), 4).alias("mid")
    )


@query(
    "w7_hash_ranked_sample",
    "SELECT block, cell_id FROM (SELECT block, cell_id, row_number() OVER (PARTITION BY block ORDER BY sha256(cell_id)) AS k FROM {cells}) WHERE k <= 2",
)
def w7(t: Tables) -> DataFrame:
    return select.hash_sample(t.cells, ["block"], F.col("cell_id"), 2).select("block", "cell_id")


@query("w8_best_by_composite_key", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def w8(t: Tables) -> DataFrame:
    best = t.lineitem.groupBy("l_suppkey").agg(F.min(F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("b"))
    return best.select("l_suppkey", "b.l_orderkey", "b.l_linenumber")


ARMS = "(SELECT event_id, strftime(ts, '%Y-%m-') || CAST(CAST(floor((day(ts) - 1) / 5.0) AS BIGINT) AS VARCHAR) AS stratum, CASE WHEN extract('hour' FROM ts) BETWEEN 9 AND 10 THEN 'morning' WHEN extract('hour' FROM ts) BETWEEN 15 AND 17 THEN 'afternoon' ELSE 'outside' END AS arm FROM events)"


def arms(t: Tables) -> DataFrame:
    h = F.hour("ts")
    arm = F.when(h.between(9, 10), "morning").when(h.between(15, 17), "afternoon").otherwise("outside")
    stratum = F.concat(F.date_format("ts", "yyyy-MM-"), F.floor((F.dayofmonth("ts") - 1) / 5).cast("string"))
    return t.events.select("event_id", stratum.alias("stratum"), arm.alias("arm"))


@query(
    "w9_balanced_weights",
    f"""WITH a AS {ARMS}, s AS (SELECT stratum FROM a WHERE arm <> 'outside' GROUP BY 1 HAVING count(DISTINCT arm) = 2), n AS (SELECT stratum, arm, count(*) AS n FROM a GROUP BY 1, 2)
 SELECT event_id, round(CASE WHEN a.stratum IN (SELECT stratum FROM s) AND a.arm <> 'outside' THEN 1.0 / ((SELECT count(*) FROM s) * n) ELSE 0 END, 8) AS weight FROM a JOIN n ON a.stratum = n.stratum AND a.arm = n.arm""",
)
def w9(t: Tables) -> DataFrame:
    out = design.balanced_weights(arms(t), "stratum", "arm", ("morning", "afternoon"))
    return rounded(out.select("event_id", "weight"), 8)


@query(
    "w10_leave_one_out_schedule",
    f"""WITH a AS (SELECT * FROM {ARMS} WHERE arm <> 'outside'), d AS (SELECT DISTINCT stratum AS dropped FROM a)
 SELECT dropped, count(*) AS n_left, count(DISTINCT a.stratum) AS strata_left, count(*) FILTER (WHERE arm = 'morning') AS mornings FROM d JOIN a ON a.stratum <> d.dropped GROUP BY 1""",
)
def w10(t: Tables) -> DataFrame:
    held = arms(t).where("arm <> 'outside'")
    out = design.leave_one_out(held, "stratum", {"n_left": F.lit(1), "mornings": (F.col("arm") == "morning").cast("bigint")})
    return out.select("dropped", "n_left", F.col("units_left").alias("strata_left"), "mornings")


@query(
    "w11_w12_s22_lead_and_difference",
    "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS range_end, round(lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_totalprice, 2) AS step FROM orders",
)
def w11(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select(
        "o_custkey", "o_orderkey", (F.lead("o_orderkey").over(w) - 1).alias("range_end"), F.round(F.lead("o_totalprice").over(w) - F.col("o_totalprice"), 2).alias("step")
    )


@query(
    "w13_trailing_all_or_nothing",
    """SELECT p.event_id, count(CASE WHEN h.v >= 0 THEN 1 END) AS hours_there, round(CASE WHEN count(CASE WHEN h.v >= 0 THEN 1 END) = 72 THEN sum(h.v) END, 4) AS total
 FROM (SELECT event_id, ts, unnest(range(1, 73)) AS back FROM {passes}) p LEFT JOIN {hourly} h ON epoch_us(h.hour) = epoch_us(date_trunc('hour', p.ts)) - back * 3600000000 GROUP BY 1""",
)
def w13(t: Tables) -> DataFrame:
    return rounded(joins.trailing_totals(t.passes, t.hourly, ["event_id"], "ts", "hour", "v", 72), 4)


@query(
    "w14_ecdf_at_probabilities",
    """SELECT event_type, unnest(range(0, 201)) AS p, unnest(list_transform(quantile_cont(value, list_transform(range(0, 201), lambda k: k / 200.0)), lambda z: round(z, 6))) AS q
 FROM events GROUP BY 1""",
)
def w14(t: Tables) -> DataFrame:
    q = ranks.quantiles(t.events, ["event_type"], "value", [k / 200 for k in range(201)])
    return q.select("event_type", F.col("share").cast("bigint").alias("p"), F.round("q", 6).alias("q"))


@query("w15_head_in_time", "SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 5")
def w15(t: Tables) -> DataFrame:
    return t.passes.orderBy("ts", "event_id").limit(5).select("event_id")
