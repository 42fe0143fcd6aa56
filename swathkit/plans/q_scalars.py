"""Scalar functions: identities, time and sun, physics, bases (F, T, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.functions import basis, clock, ident, physics, sun
from swathkit.plans.registry import Tables, query, rounded

LON, LAT = -112.07, 33.45
HOURS = "(extract('hour' FROM ts) + extract('minute' FROM ts) / 60.0 + floor(extract('second' FROM ts)) / 3600.0)"
SUBHOURS = "((epoch_us(ts) % 86400000000) / 3600000000.0)"
YEARDAYS = "dayofyear(make_date(CAST(year(ts) AS BIGINT), 12, 31))"


def eot_sql(hours: str) -> str:
    g = f"(2 * pi() / {YEARDAYS} * (dayofyear(ts) - 1.0 + ({hours} - 12.0) / 24.0))"
    return (
        f"(229.18 * (0.000075 + 0.001868 * cos({g}) - 0.032077 * sin({g}) - 0.014615 * cos(2 * {g}) - 0.040849 * sin(2 * {g})))"
    )


def wrap(x: str) -> str:
    return f"({x} - 24 * floor({x} / 24))"


def names(t: Tables) -> DataFrame:
    """Granule-like names from line items."""
    return t.lineitem.select(
        F.concat(
            F.lit("L2T_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"),
            F.lit("_12S"), F.when(F.col("l_suppkey") % 2 == 0, "VC").otherwise("UB"), F.lit("_"),
            F.date_format("l_shipdate", "yyyyMMdd"), F.lit("T180500_"), F.format_string("%04d", F.col("l_partkey")),
            F.lit("_"), F.format_string("%02d", F.col("l_suppkey")),
        ).alias("name")
    )


NAMES = """(SELECT 'L2T_' || l_orderkey || '_' || l_linenumber || '_12S' || CASE WHEN l_suppkey % 2 = 0 THEN 'VC' ELSE 'UB' END
 || '_' || strftime(l_shipdate, '%Y%m%d') || 'T180500_' || lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(4, length(CAST(l_partkey AS VARCHAR))) AS INTEGER), '0') || '_'
 || lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(2, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') AS name FROM lineitem)"""


@query(
    "f1_granule_fields",
    f"""SELECT CAST(regexp_extract(name, '_(\\d+)_(\\d+)_([0-9A-Z]{{5}})_(\\d{{8}}T\\d{{6}})_(\\d+)_(\\d+)$', 1) AS INTEGER) AS orbit,
 regexp_extract(name, '_([0-9A-Z]{{5}})_\\d{{8}}T', 1) AS tile, CAST(regexp_extract(name, '_(\\d+)$', 1) AS INTEGER) AS revision,
 CAST(regexp_extract(name, '_(\\d+)_\\d+$', 1) AS INTEGER) AS build, CAST(regexp_extract(name, '_(\\d{{8}})T', 1) AS VARCHAR) AS day,
 count(*) AS n FROM {NAMES} GROUP BY 1, 2, 3, 4, 5""",
)
def f1(t: Tables) -> DataFrame:
    g = names(t).select(ident.granule_fields(F.col("name")).alias("g")).select("g.*")
    return g.groupBy("orbit", "tile", "revision", "build", F.date_format("acquired", "yyyyMMdd").alias("day")).agg(
        F.count("*").alias("n")
    )


@query(
    "f2_f4_split_and_zone",
    f"""SELECT split_part(name, '_', -2) AS build_text, CAST(left(split_part(name, '_', 4), 2) AS INTEGER) AS zone, count(*) AS n
 FROM {NAMES} GROUP BY 1, 2""",
)
def f2(t: Tables) -> DataFrame:
    s = names(t)
    tile = ident.split_from_end(F.col("name"), "_", 4)
    return s.groupBy(
        ident.split_from_end(F.col("name"), "_", 2).alias("build_text"), ident.utm_zone(tile).alias("zone")
    ).agg(F.count("*").alias("n"))


@query(
    "f3_f5_f7_id_text",
    """SELECT CAST(CAST(o_orderkey AS BIGINT) AS VARCHAR) AS plain, lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(6, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0') AS padded,
 CAST(floor(o_totalprice / 1000.0) AS BIGINT) || '_' || CAST(floor(-o_totalprice / 1000.0) AS BIGINT) AS block FROM orders""",
)
def f3(t: Tables) -> DataFrame:
    return t.orders.select(
        ident.plain_integer_text(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).alias("plain"),
        ident.zero_padded(F.col("o_custkey").cast("string"), 6).alias("padded"),
        ident.block_key(F.col("o_totalprice"), -F.col("o_totalprice"), 1000.0).alias("block"),
    )



@query(
    "f6_coarser_block_floor",
    """SELECT i || '_' || j AS block, CAST(floor(i / 8.0) AS BIGINT) || '_' || CAST(floor(j / 8.0) AS BIGINT) AS grp, count(*) AS n
 FROM (SELECT l_suppkey - 50 AS i, l_linenumber - 4 AS j FROM lineitem) GROUP BY 1, 2""",
)
def f6(t: Tables) -> DataFrame:
    block = F.concat_ws("_", (F.col("l_suppkey") - 50).cast("string"), (F.col("l_linenumber") - 4).cast("string"))
    return t.lineitem.select(block.alias("block")).groupBy("block", ident.coarser_block(F.col("block"), 8).alias("grp")).agg(
        F.count("*").alias("n")
    )


@query(
    "f8_asset_and_host_of_url",
    r"""SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, split_part(regexp_extract(url, '://([^/?#]+)', 1), '.', -2) AS second_last FROM pages""",
)
def f8(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    return t.pages.select("page_id", host.alias("host"), ident.split_from_end(host, r"\.", 2).alias("second_last"))


@query(
    "f9_digest_of_ids",
    "SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest, count(*) AS n FROM orders GROUP BY 1",
)
def f9(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        ident.digest_of(F.col("o_orderkey").cast("string")).alias("digest"), F.count("*").alias("n")
    )


@query(
    "f11_id_list_to_rows",
    """SELECT item, count(*) AS n FROM (SELECT DISTINCT o_orderkey, unnest(string_split(o_orderpriority || '|' || o_orderstatus || '|' || o_orderstatus, '|')) AS item FROM orders) GROUP BY 1""",
)
def f11(t: Tables) -> DataFrame:
    text = F.concat_ws("|", "o_orderpriority", "o_orderstatus", "o_orderstatus")
    return t.orders.select("o_orderkey", F.explode(ident.id_set(text)).alias("item")).distinct().groupBy("item").agg(F.count("*").alias("n"))


@query(
    "f12_nested_json",
    """SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""",
)
def f12(t: Tables) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return t.events.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query(
    "t1_utc_strict_and_lenient",
    """SELECT event_id, event_id % 2 = 0 AS strict_known, epoch_us(date_trunc('second', ts)) AS us FROM events""",
)
def t1(t: Tables) -> DataFrame:
    bare = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(bare, F.lit("Z"))).otherwise(bare)
    return t.events.select(
        "event_id", clock.utc_strict(text).isNotNull().alias("strict_known"), F.unix_micros(clock.utc_lenient(text)).alias("us")
    )



@query(
    "t2_hour_brackets",
    """SELECT event_id, epoch_us(date_trunc('hour', ts)) AS lo,
 CASE WHEN date_trunc('hour', ts) = ts THEN epoch_us(ts) ELSE epoch_us(date_trunc('hour', ts)) + 3600000000 END AS hi,
 round((epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 3600000000.0, 9) AS weight FROM events""",
)
def t2(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select(
        "event_id", F.unix_micros(clock.hour_floor(ts)).alias("lo"), F.unix_micros(clock.hour_ceil(ts)).alias("hi"),
        F.round(clock.hour_weight(ts), 9).alias("weight"),
    )


@query(
    "t3_t9_civil_date_and_year",
    """SELECT event_id, strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M') AS phoenix, dayofyear(ts) AS doy,
 dayofyear(make_date(CAST(year(ts) AS BIGINT), 12, 31)) AS year_days FROM events""",
)
def t3(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select(
        "event_id", F.date_format(F.from_utc_timestamp(ts, "America/Phoenix"), "yyyy-MM-dd HH:mm").alias("phoenix"),
        F.dayofyear(ts).cast("bigint").alias("doy"), clock.days_in_year(ts).cast("bigint").alias("year_days"),
    )


@query(
    "t4_t10_solar_date_and_season",
    f"""SELECT event_id, strftime(make_timestamp(epoch_us(ts) + CAST(round({LON} / 15.0 * 3600000000.0) AS BIGINT)), '%Y-%m-%d') AS solar_date,
 strftime(make_timestamp(epoch_us(ts) + CAST(round({LON} / 15.0 * 3600000000.0) AS BIGINT)), '%m-%d') BETWEEN '01-10' AND '01-20' AS in_season FROM events""",
)
def t4(t: Tables) -> DataFrame:
    date = clock.local_solar_date(F.col("ts"), F.lit(LON))
    return t.events.select(
        "event_id", date.cast("string").alias("solar_date"), clock.in_season(date, "01-10", "01-20").alias("in_season")
    )


@query(
    "t5_equation_of_time_and_apparent_hour",
    f"SELECT event_id, round({eot_sql(HOURS)}, 6) AS eot, round({wrap(f'({HOURS} + {LON} / 15.0 + {eot_sql(HOURS)} / 60.0)')}, 6) AS apparent FROM events",
)
def t5(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return rounded(
        t.events.select("event_id", clock.equation_of_time(ts).alias("eot"), clock.apparent_solar_hour(ts, F.lit(LON)).alias("apparent"))
    )


@query(
    "t6_solar_hours_with_subseconds",
    f"""SELECT event_id, round({wrap(f'({SUBHOURS} + {LON} / 15.0)')}, 6) AS mean_hour, round({eot_sql(SUBHOURS)}, 6) AS eot,
 round({wrap(f'({SUBHOURS} + {LON} / 15.0 + {eot_sql(SUBHOURS)} / 60.0)')}, 6) AS apparent FROM events""",
)
def t6(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return rounded(
        t.events.select(
            "event_id", clock.mean_solar_hour(ts, F.lit(LON), True).alias("mean_hour"), clock.equation_of_time(ts, True).alias("eot"),
            clock.apparent_solar_hour(ts, F.lit(LON), True).alias("apparent"),
        )
    )


def sun_sql(year_days: str) -> str:
    g = f"(2 * pi() / {year_days} * (doy - 1.0 + (h - 12.0) / 24.0))"
    d = (
        f"(0.006918 - 0.399912 * cos({g}) + 0.070257 * sin({g}) - 0.006758 * cos(2 * {g}) + 0.000907 * sin(2 * {g})"
        f" - 0.002697 * cos(3 * {g}) + 0.001480 * sin(3 * {g}))"
    )
    return f"""SELECT event_id, round(degrees(acos(greatest(-1.0, least(1.0, sin(phi) * sin(d) + cos(phi) * cos(d) * cos(a))))), 6) AS zenith,
 round(az - 360 * floor(az / 360), 6) AS azimuth FROM (SELECT *, degrees(atan2(sin(a), cos(a) * sin(phi) - tan(d) * cos(phi))) + 180.0 AS az
 FROM (SELECT *, {d} AS d, radians(15.0 * (h - 12.0)) AS a, radians({LAT}) AS phi FROM (SELECT event_id, ts, dayofyear(ts) AS doy, {HOURS} AS h, {YEARDAYS} AS yd FROM events)))"""


def sun_of(t: Tables, leap_aware: bool) -> DataFrame:
    ts = F.col("ts")
    days = clock.days_in_year(ts) if leap_aware else F.lit(365)
    args = (F.lit(LAT), F.dayofyear(ts), clock.utc_hour(ts), days)
    return rounded(t.events.select("event_id", sun.zenith(*args).alias("zenith"), sun.azimuth(*args).alias("azimuth")))


query("t7_solar_position_365", sun_sql("365"))(lambda t: sun_of(t, False))
query("t8_solar_position_leap_year", sun_sql("yd"))(lambda t: sun_of(t, True))


@query(
    "t11_hours_of_window",
    """SELECT event_id, count(*) AS n_hours, min(h) AS first_hour, max(h) AS last_hour FROM
 (SELECT event_id, unnest(range(epoch_us(date_trunc('hour', ts)) - 23 * 3600000000, epoch_us(date_trunc('hour', ts)) + 1, 3600000000)) AS h FROM events) GROUP BY 1""",
)
def t11(t: Tables) -> DataFrame:
    top = clock.hour_floor(F.col("ts"))
    hours = F.sequence(top - F.expr("interval 23 hours"), top, F.expr("interval 1 hour"))
    return t.events.select("event_id", F.explode(hours).alias("h")).groupBy("event_id").agg(
        F.count("*").alias("n_hours"), F.min(F.unix_micros("h")).alias("first_hour"), F.max(F.unix_micros("h")).alias("last_hour")
    )



@query(
    "t12_t13_cyclic_and_after_noon",
    f"""SELECT event_id, round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_cos,
 CASE WHEN {HOURS} > 12 THEN 1 ELSE 0 END AS after_noon FROM events""",
)
def t12(t: Tables) -> DataFrame:
    s, c = clock.cyclic(F.dayofyear("ts"), 365.25)
    return rounded(
        t.events.select("event_id", s.alias("doy_sin"), c.alias("doy_cos"), clock.after_noon(clock.utc_hour(F.col("ts"))).alias("after_noon"))
    )


@query(
    "t14_signed_lag_days",
    "SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 86400000000.0, 8) AS lag FROM events",
)
def t14(t: Tables) -> DataFrame:
    return rounded(t.events.select("event_id", clock.days_between(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("lag")), 8)


TEMP = "(280.0 + l_discount * 300)"


@query(
    "m1_m2_energy_and_inverse",
    f"""SELECT cell, round(m, 4) AS energy, round(300.0 * (power((0.97 * 5.670374419e-8 * power(300.0, 4) + (m - 400)) / (0.97 * 5.670374419e-8 * power(300.0, 4)), 0.25) - 1), 6) AS equivalent
 FROM (SELECT l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':' || epoch_us(l_shipdate) AS cell, 0.97 * 5.670374419e-8 * power({TEMP}, 4) AS m FROM lineitem)""",
)
def m1(t: Tables) -> DataFrame:
    m = physics.emitted_energy(F.lit(0.97), F.lit(280.0) + F.col("l_discount") * 300)
    cell = F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), F.unix_micros("l_shipdate").cast("string"))
    out = t.lineitem.select(cell.alias("cell"), m.alias("m"))
    return out.select(
        "cell", F.round("m", 4).alias("energy"),
        F.round(physics.temperature_equivalent(F.col("m") - 400, F.lit(300.0), F.lit(0.97)), 6).alias("equivalent"),
    )


@query(
    "m3_cooling_quantities",
    """SELECT block, round(ck, 6) AS cooling_k, round(cf, 6) AS cooling_flux, round(eq, 6) AS equivalent_k, round(ck - eq, 6) AS departure_k FROM
 (SELECT *, CASE WHEN anchor - cf > 0 THEN -300.0 * (power((anchor - cf) / anchor, 0.25) - 1) END AS eq FROM
 (SELECT block, avg(x) * 10 AS ck, avg(y) / 60 AS cf, 0.98 * 5.670374419e-8 * power(300.0, 4) AS anchor FROM {cells} GROUP BY 1))""",
)
def m3(t: Tables) -> DataFrame:
    base = t.cells.groupBy("block").agg((F.avg("x") * 10).alias("ck"), (F.avg("y") / 60).alias("cf"))
    q = physics.cooling_quantities(F.col("ck"), F.col("cf"), F.lit(300.0), F.lit(0.98))
    return rounded(base.select("block", *(c.alias(n) for n, c in q.items())))


@query(
    "m4_mixed_cells",
    "SELECT cell_id, round(x * 290 + (1 - x) * 310, 6) AS mixed FROM {cells}",
)
def m4(t: Tables) -> DataFrame:
    return rounded(t.cells.select("cell_id", physics.mixed(F.col("x"), F.lit(290.0), F.lit(310.0)).alias("mixed")))


@query(
    "m5_m6_vpd_and_wind",
    """SELECT event_id, round(greatest(0.6108 * exp(17.27 * t / (t + 237.3)) - 0.6108 * exp(17.27 * d / (d + 237.3)), 0.0), 6) AS vpd, round(sqrt(u * u + v * v), 6) AS wind FROM
 (SELECT event_id, value / 10 + 10 - 0.0 AS t, (event_id % 30) + 0.0 AS d, value / 7 AS u, -value / 9 AS v FROM events)""",
)
def m5(t: Tables) -> DataFrame:
    kelvin, dew = F.col("value") / 10 + 10 + 273.15, (F.col("event_id") % 30) + 273.15
    return rounded(
        t.events.select("event_id", physics.vpd_kpa(kelvin, dew).alias("vpd"), physics.wind_speed(F.col("value") / 7, -F.col("value") / 9).alias("wind"))
    )


@query(
    "m7_shortwave_ratio_interpolation",
    """SELECT event_id, CASE WHEN ok AND c0 >= 0.1 AND c1 >= 0.1 THEN 'both_hours' WHEN ok AND c0 >= 0.1 THEN 'floor_hour' WHEN ok AND c1 >= 0.1 THEN 'ceiling_hour' END AS method,
 round(CASE WHEN ok AND c0 >= 0.1 AND c1 >= 0.1 THEN ((1 - w) * s0 / c0 + w * s1 / c1) * c WHEN ok AND c0 >= 0.1 THEN s0 / c0 * c WHEN ok AND c1 >= 0.1 THEN s1 / c1 * c END, 6) AS shortwave FROM
 (SELECT *, s0 >= 0 AND s1 >= 0 AND c > 0 AND c <= 1 AS ok FROM (SELECT event_id, value AS s0, value * 1.1 AS s1, (event_id % 13) / 12.0 - 0.2 AS c0, (event_id % 7) / 6.0 - 0.1 AS c1,
 (event_id % 11) / 10.0 - 0.1 AS c, (event_id % 5) / 4.0 AS w FROM events))""",
)
def m7(t: Tables) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    sw, method = sun.shortwave_between(v, v * 1.1, (e % 13) / 12.0 - 0.2, (e % 7) / 6.0 - 0.1, (e % 11) / 10.0 - 0.1, (e % 5) / 4.0)
    return rounded(t.events.select("event_id", method.alias("method"), sw.alias("shortwave")))


def _spline_sql(k: float) -> str:
    a, b, k3, k4 = "greatest(x - {}, 0.0)", 0, 0.06, 0.09
    c = lambda z: f"power({a.format(z)}, 3)"
    return f"({c(k)} - {c(k3)} * {(k4 - k) / (k4 - k3)!r} + {c(k4)} * {(k3 - k) / (k4 - k3)!r}) / {(k4 - 0.01) ** 2!r}"


@query(
    "m9_spline_basis",
    f"SELECT x, round({_spline_sql(0.01)}, 8) AS b1, round({_spline_sql(0.03)}, 8) AS b2, count(*) AS n FROM {{cells}} GROUP BY 1, 2, 3",
)
def m9(t: Tables) -> DataFrame:
    terms = basis.spline_terms(F.col("x"), (0.01, 0.03, 0.06, 0.09))
    out = t.cells.groupBy("x").agg(F.count("*").alias("n"))
    return out.select("x", F.round(terms[1], 8).alias("b1"), F.round(terms[2], 8).alias("b2"), "n")


@query(
    "m10_quadratic_basis",
    "SELECT x, round(x * x, 8) AS x2, round(x * x - (0.02 + 0.08) * x, 8) AS contrast, count(*) AS n FROM {cells} GROUP BY 1, 2, 3",
)
def m10(t: Tables) -> DataFrame:
    x = F.col("x")
    out = t.cells.groupBy("x").agg(F.count("*").alias("n"))
    return out.select("x", F.round(basis.quadratic_terms(x)[1], 8).alias("x2"), F.round(basis.quadratic_contrast(x, 0.02, 0.08), 8).alias("contrast"), "n")


@query(
    "m11_m12_power_table",
    """SELECT summary, reliability, criterion, CAST(ceil(k * 1.5 * sd * sd / (target * target * reliability)) AS BIGINT) AS n FROM
 (SELECT 'median' AS summary, round(quantile_cont(s, 0.5), 9) AS sd FROM (SELECT stddev_samp(x) AS s FROM {cells} GROUP BY block)
 UNION ALL SELECT 'p75', round(quantile_cont(s, 0.75), 9) FROM (SELECT stddev_samp(x) AS s FROM {cells} GROUP BY block)
 UNION ALL SELECT 'p90', round(quantile_cont(s, 0.9), 9) FROM (SELECT stddev_samp(x) AS s FROM {cells} GROUP BY block))
 CROSS JOIN (VALUES (0.5), (0.7), (0.9)) r(reliability) CROSS JOIN (VALUES ('detection', 7.849, 0.013), ('equivalence', 10.822, 0.011)) c(criterion, k, target)""",
)
def m11(t: Tables) -> DataFrame:
    sds = t.cells.groupBy("block").agg(F.stddev_samp("x").alias("s"))
    shares = F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))
    named = sds.agg(F.percentile("s", shares).alias("q")).select(
        F.explode(F.arrays_zip(F.array(F.lit("median"), F.lit("p75"), F.lit("p90")).alias("summary"), F.col("q").alias("sd"))).alias("z")
    ).select("z.summary", F.round("z.sd", 9).alias("sd"))
    reliability = t.spark.createDataFrame([(0.5,), (0.7,), (0.9,)], "reliability double")
    criteria = t.spark.createDataFrame([("detection", 7.849, 0.013), ("equivalence", 10.822, 0.011)], "criterion string, k double, target double")
    grid = named.crossJoin(F.broadcast(reliability)).crossJoin(F.broadcast(criteria))
    n = F.ceil(F.col("k") * 1.5 * F.col("sd") * F.col("sd") / (F.col("target") * F.col("target") * F.col("reliability")))
    return grid.select("summary", "reliability", "criterion", n.cast("bigint").alias("n"))


@query(
    "m13_cell_weights",
    "SELECT s_suppkey, round((1 + sin(radians(60.0))) / (1 + sin(radians(s_suppkey % 80 + 5.0))), 8) AS scale FROM supplier",
)
def m13(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.round(physics.polar_stereographic_scale(F.col("s_suppkey") % 80 + 5.0, 60.0), 8).alias("scale"))
