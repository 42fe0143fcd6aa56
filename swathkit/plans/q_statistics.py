"""Statistical operators (X)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.functions import basis, ident, physics
from swathkit.operators import aggregates, design, hulls, inference, resampling, within
from swathkit.plans.registry import Tables, query, rounded


@query(
    "x1_within_group_slope",
    """SELECT count(*) AS n_blocks, sum(n) AS n_cells, count(*) FILTER (WHERE sxx > 1e-12) AS contributing, round(sum(sxx), 6) AS sxx, round(sum(sxy) / sum(sxx), 4) AS slope, round(max(sxx) / sum(sxx), 8) AS largest_share
 FROM (SELECT block, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM {cells} GROUP BY 1)""",
)
def x1(t: Tables) -> DataFrame:
    m = within.centred_products(t.cells, "block", ["x"], ["y"])
    return m.agg(
        F.count("*").alias("n_blocks"), F.sum("n").alias("n_cells"), F.count_if(F.col("xx_0_0") > 1e-12).alias("contributing"),
        F.round(F.sum("xx_0_0"), 6).alias("sxx"), F.round(F.sum("xy_0_0") / F.sum("xx_0_0"), 4).alias("slope"),
        F.round(F.max("xx_0_0") / F.sum("xx_0_0"), 8).alias("largest_share"),
    )


@query(
    "x2_block_moments",
    """SELECT block, count(*) AS n, round(covar_pop(x, x) * count(*), 5) AS xx_0_0, round(covar_pop(x, tax) * count(*), 5) AS xx_0_1, round(covar_pop(tax, tax) * count(*), 5) AS xx_1_1,
 round(covar_pop(x, y) * count(*), 2) AS xy_0_0, round(covar_pop(tax, y) * count(*), 2) AS xy_1_0 FROM {cells} GROUP BY 1""",
)
def x2(t: Tables) -> DataFrame:
    m = within.centred_products(t.cells, "block", ["x", "tax"], ["y"])
    return m.select("block", "n", *(F.round(c, 5).alias(c) for c in ("xx_0_0", "xx_0_1", "xx_1_1")), *(F.round(c, 2).alias(c) for c in ("xy_0_0", "xy_1_0")))


@query(
    "x1_x3_two_predictor_fit",
    """SELECT round((s11 * t0 - s01 * t1) / (s00 * s11 - s01 * s01), 3) AS slope_x, round((s00 * t1 - s01 * t0) / (s00 * s11 - s01 * s01), 3) AS slope_tax FROM (SELECT sum(a) AS s00, sum(b) AS s01, sum(c) AS s11, sum(d) AS t0, sum(e) AS t1 FROM
 (SELECT covar_pop(x, x) * count(*) AS a, covar_pop(x, tax) * count(*) AS b, covar_pop(tax, tax) * count(*) AS c, covar_pop(x, y) * count(*) AS d, covar_pop(tax, y) * count(*) AS e FROM {cells} GROUP BY block))""",
)
def x3(t: Tables) -> DataFrame:
    fitted, _ = within.fit_frame(t.cells, "block", "block", ["x", "tax"], ["y"])
    return t.spark.createDataFrame([tuple(round(float(v), 3) for v in fitted.coef[:, 0])], "slope_x double, slope_tax double")


def spline_sql(x: str, knot: float, ends: tuple[float, float, float] = (0.01, 0.06, 0.09)) -> str:
    """One restricted cubic term of the knots 0.01, 0.03, 0.06, 0.09."""
    k1, k3, k4 = ends
    return (
        f"((power(greatest({x} - {knot}, 0), 3) - power(greatest({x} - {k3}, 0), 3) * {(k4 - knot) / (k4 - k3)!r}"
        f" + power(greatest({x} - {k4}, 0), 3) * {(k3 - knot) / (k4 - k3)!r}) / {(k4 - k1) ** 2!r})"
    )


_SOLVE3 = """b AS (SELECT *, s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02) AS det FROM t),
 i AS (SELECT *, (s11 * s22 - s12 * s12) / det AS i00, (s02 * s12 - s01 * s22) / det AS i01, (s01 * s12 - s02 * s11) / det AS i02, (s00 * s22 - s02 * s02) / det AS i11, (s01 * s02 - s00 * s12) / det AS i12, (s00 * s11 - s01 * s01) / det AS i22 FROM b),
 f AS (SELECT *, i00 * t0 + i01 * t1 + i02 * t2 AS b0, i01 * t0 + i11 * t1 + i12 * t2 AS b1, i02 * t0 + i12 * t1 + i22 * t2 AS b2 FROM i)"""


def _moments3(x: str, y: str, z: str, by: str) -> str:
    """CTEs m (moments by group) and t (their sums) of three predictors, from blocks' centred products."""
    terms = {"s00": (x, x), "s01": (x, y), "s02": (x, z), "s11": (y, y), "s12": (y, z), "s22": (z, z), "t0": (x, "y"), "t1": (y, "y"), "t2": (z, "y")}
    block = ", ".join(f"covar_pop({p}, {q}) * count(*) AS {k}" for k, (p, q) in terms.items())
    sums = ", ".join(f"sum({k}) AS {k}" for k in terms)
    return f"""p AS (SELECT block, {by} AS g, count(*) AS n, {block} FROM {{cells}} GROUP BY 1, 2), m AS (SELECT g, sum(n) AS n, count(*) AS blocks, {sums} FROM p GROUP BY 1),
 t AS (SELECT count(*) AS groups, sum(n) AS n, sum(blocks) AS blocks, {sums} FROM m)"""


@query(
    "x4_clustered_error",
    f"""WITH {_moments3("x", "tax", "qty", "grp")}, {_SOLVE3} SELECT 'x' AS term, round(max(b0), 3) AS coef,
 round(sqrt(sum(power(i00 * (m.t0 - m.s00 * b0 - m.s01 * b1 - m.s02 * b2) + i01 * (m.t1 - m.s01 * b0 - m.s11 * b1 - m.s12 * b2) + i02 * (m.t2 - m.s02 * b0 - m.s12 * b1 - m.s22 * b2), 2)) * max(groups / (groups - 1.0) * (f.n - 1) / (f.n - f.blocks - 3))), 3) AS cluster_se,
 max(groups) AS n_groups, CAST(max(f.n - f.blocks - 3) AS BIGINT) AS dof FROM m CROSS JOIN f""",
)
def x4(t: Tables) -> DataFrame:
    fitted, _ = within.fit_frame(t.cells, "block", "grp", ["x", "tax", "qty"], ["y"])
    rows = [("x", round(float(fitted.coef[0, 0]), 3), round(float(fitted.cluster_se[0]), 3), fitted.diagnostics["groups"], fitted.diagnostics["dof"])]
    return t.spark.createDataFrame(rows, "term string, coef double, cluster_se double, n_groups bigint, dof bigint")


def _draws_sql(groups: str, label: str, replicates: int, seed: int) -> str:
    """CTEs i (groups with their place) and d (rep, place, times) of whole-group resampling."""
    return f"""i AS (SELECT *, row_number() OVER (ORDER BY CAST({label} AS VARCHAR)) - 1 AS place FROM {groups}),
 d AS (SELECT rep, CAST('0x' || substr(sha256(concat_ws(':', {seed}, rep, k)), 1, 12) AS BIGINT) % (SELECT count(*) FROM i) AS place, count(*) AS times
 FROM (SELECT unnest(range({replicates})) AS rep) CROSS JOIN (SELECT unnest(range((SELECT count(*) FROM i))) AS k) GROUP BY 1, 2)"""


@query(
    "x5_x23_group_bootstrap",
    f"""WITH m AS (SELECT block, covar_pop(x, x) * count(*) AS a, covar_pop(x, tax) * count(*) AS b, covar_pop(tax, tax) * count(*) AS c, covar_pop(x, y) * count(*) AS d, covar_pop(tax, y) * count(*) AS e FROM {{cells}} GROUP BY 1), {_draws_sql("m", "block", 200, 20240101)},
 r AS (SELECT rep, (c * d - b * e) / (a * c - b * b) AS v FROM (SELECT rep, sum(times * a) AS a, sum(times * b) AS b, sum(times * c) AS c, sum(times * i.d) AS d, sum(times * e) AS e FROM d JOIN i ON i.place = d.place GROUP BY 1))
 SELECT 'x' AS term, round(quantile_cont(v, 0.025), 3) AS q025, round(quantile_cont(v, 0.975), 3) AS q975, round(stddev_samp(v), 3) AS se, count(v) AS estimable, count(*) AS requested FROM r""",
)
def x5(t: Tables) -> DataFrame:
    _, m = within.fit_frame(t.cells, "block", "block", ["x", "tax"], ["y"])
    draws = within.bootstrap_table(m, 200, 20240101).select(F.lit("x").alias("term"), F.col("coef")[0].alias("value"))
    return rounded(inference.interval_summary(draws, ["term"], "value"), 3)


@query(
    "x6_x7_x24_joint_bootstrap_and_paired_scale",
    f"""WITH p AS (SELECT block, grp, pass < '1998-01' AS early, covar_pop(x, x) * count(*) AS a, covar_pop(x, y) * count(*) AS b FROM {{cells}} GROUP BY 1, 2, 3),
 m AS (SELECT grp, coalesce(sum(a) FILTER (WHERE early), 0) AS ea, coalesce(sum(b) FILTER (WHERE early), 0) AS eb, coalesce(sum(a) FILTER (WHERE NOT early), 0) AS la, coalesce(sum(b) FILTER (WHERE NOT early), 0) AS lb FROM p GROUP BY 1), {_draws_sql("m", "grp", 200, 7)},
 r AS (SELECT rep, sum(times * lb) / sum(times * la) - sum(times * eb) / sum(times * ea) AS v FROM d JOIN i ON i.place = d.place GROUP BY 1)
 SELECT 'late-early' AS contrast, round(quantile_cont(v, 0.025), 3) AS q025, round(quantile_cont(v, 0.975), 3) AS q975, round(stddev_samp(v), 3) AS se, count(v) AS estimable, count(*) AS requested FROM r""",
)
def x6(t: Tables) -> DataFrame:
    halves = [within.fit_frame(t.cells.where(c), "block", "grp", ["x"], ["y"])[1] for c in ("pass < '1998-01'", "pass >= '1998-01'")]
    draws = within.joint_bootstrap(halves, 200, 7).groupBy("rep").pivot("population", [0, 1]).agg(F.first(F.col("coef")[0]))
    contrast = draws.select(F.lit("late-early").alias("contrast"), (F.col("1") - F.col("0")).alias("value"))
    return rounded(inference.interval_summary(contrast, ["contrast"], "value"), 3)


@query(
    "x8_paired_linear_quadratic_bootstrap",
    f"""WITH m AS (SELECT block, covar_pop(x, x) * count(*) AS a, covar_pop(x, x * x) * count(*) AS b, covar_pop(x * x, x * x) * count(*) AS c, covar_pop(x, y) * count(*) AS d, covar_pop(x * x, y) * count(*) AS e FROM {{cells}} GROUP BY 1), {_draws_sql("m", "block", 100, 3)}
 SELECT rep, round(0.06 * d / a, 2) AS linear, round(0.06 * (c * d - b * e) / (a * c - b * b) + (0.08 * 0.08 - 0.02 * 0.02) * (a * e - b * d) / (a * c - b * b), 2) AS quadratic
 FROM (SELECT rep, sum(times * a) AS a, sum(times * b) AS b, sum(times * c) AS c, sum(times * i.d) AS d, sum(times * e) AS e FROM d JOIN i ON i.place = d.place GROUP BY 1)""",
)
def x8(t: Tables) -> DataFrame:
    cells = t.cells.withColumn("x2", F.col("x") * F.col("x"))
    _, m = within.fit_frame(cells, "block", "block", ["x", "x2"], ["y"])
    d1, d2 = basis.basis_change(0.02, 0.08)
    line = within.bootstrap_table(m, 100, 3, keep=[0]).select("rep", (F.col("coef")[0] * d1).alias("linear"))
    quad = within.bootstrap_table(m, 100, 3, keep=[0, 1]).select("rep", (F.col("coef")[0] * d1 + F.col("coef")[1] * d2).alias("quadratic"))
    return rounded(line.join(quad, "rep"), 2)


@query(
    "x9_information_shares",
    "SELECT round(1 / sum(s * s), 4) AS effective, round(max(s), 8) AS largest, round(sum(s) FILTER (WHERE k <= 5), 8) AS top_five FROM (SELECT s, row_number() OVER (ORDER BY s DESC, block) AS k FROM (SELECT block, regr_sxx(x, x) / sum(regr_sxx(x, x)) OVER () AS s FROM {cells} GROUP BY block))",
)
def x9(t: Tables) -> DataFrame:
    c = aggregates.concentration(aggregates.information_shares(t.cells, "block", "x"))
    return c.select(F.round("effective", 4).alias("effective"), F.round("largest", 8).alias("largest"), F.round("top_five", 8).alias("top_five"))


@query(
    "x10_x11_context_rank_selection",
    """WITH c AS (SELECT block, x, tax, qty, y FROM {cells}), m AS (SELECT block, covar_pop(tax, tax) * count(*) AS tt, covar_pop(tax, qty) * count(*) AS tq, covar_pop(qty, qty) * count(*) AS qq FROM c GROUP BY 1),
 s AS (SELECT sum(tt) AS tt, sum(tq) AS tq, sum(qq) AS qq FROM m)
 SELECT CAST(CASE WHEN 1e-8 * sqrt(qq - tq * tq / tt) / sqrt(tt) > 1e-10 THEN 3 ELSE 2 END AS BIGINT) AS rank, 'flat|tax2' AS removed FROM s""",
)
def x10(t: Tables) -> DataFrame:
    """tax2 is twice tax and goes; near differs from tax by parts in 10^8, which only the rows' own factors can tell, and stays."""
    cells = t.cells.withColumns({"tax2": F.col("tax") * 2, "flat": F.lit(1.0), "near": F.col("tax") + F.col("qty") * 1e-8})
    fitted, _ = within.fit_frame(cells, "block", "block", ["x", "tax", "tax2", "flat", "near"], ["y"])
    # of two terms that depend on each other either may go; they are named as one
    gone = sorted("tax2" if c == "tax" else c for c in fitted.diagnostics["removed"])
    return t.spark.createDataFrame([(len(fitted.names), "|".join(gone))], "rank bigint, removed string")


@query(
    "x1_c16_fit_by_factors",
    """WITH m AS (SELECT block, count(*) AS n, covar_pop(x, x) * count(*) AS a, covar_pop(x, tax) * count(*) AS b, covar_pop(tax, tax) * count(*) AS c, covar_pop(x, y) * count(*) AS d, covar_pop(tax, y) * count(*) AS e FROM {cells} GROUP BY block),
 s AS (SELECT count(*) AS g, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, (sum(c) * sum(d) - sum(b) * sum(e)) / (sum(a) * sum(c) - sum(b) * sum(b)) AS b0, (sum(a) * sum(e) - sum(b) * sum(d)) / (sum(a) * sum(c) - sum(b) * sum(b)) AS b1 FROM m),
 i AS (SELECT (s.c * (m.d - m.a * b0 - m.b * b1) - s.b * (m.e - m.b * b0 - m.c * b1)) / (s.a * s.c - s.b * s.b) AS v FROM m, s)
 SELECT round(b0, 4) AS slope, round(sqrt((SELECT sum(v * v) FROM i) * g / (g - 1.0) * (n - 1) / (n - g - 2)), 4) AS cluster_se, CAST(n AS BIGINT) AS n_cells, true AS agrees FROM s""",
)
def x1_qr(t: Tables) -> DataFrame:
    """The fit of fixed effects by QR of the rows, held against the fit by products."""
    by_rows = within.fit_by_qr(t.cells, "block", "block", ["x", "tax"], ["y"])
    by_products, _ = within.fit_frame(t.cells, "block", "block", ["x", "tax"], ["y"])
    agrees = bool(np.allclose(by_rows.coef, by_products.coef, rtol=1e-9) and np.allclose(by_rows.cluster_se, by_products.cluster_se, rtol=1e-9))
    row = (round(float(by_rows.coef[0, 0]), 4), round(float(by_rows.cluster_se[0]), 4), by_rows.diagnostics["n"], agrees)
    return t.spark.createDataFrame([row], "slope double, cluster_se double, n_cells bigint, agrees boolean")


@query(
    "x12_x13_quadratic_contrast",
    """SELECT round(0.06 * b1 + (0.08 * 0.08 - 0.02 * 0.02) * b2, 2) AS change FROM (SELECT (s11 * t0 - s01 * t1) / (s00 * s11 - s01 * s01) AS b1, (s00 * t1 - s01 * t0) / (s00 * s11 - s01 * s01) AS b2 FROM (SELECT sum(a) AS s00, sum(b) AS s01, sum(c) AS s11, sum(d) AS t0, sum(e) AS t1 FROM
 (SELECT covar_pop(x, x) * count(*) AS a, covar_pop(x, x * x) * count(*) AS b, covar_pop(x * x, x * x) * count(*) AS c, covar_pop(x, y) * count(*) AS d, covar_pop(x * x, y) * count(*) AS e FROM {cells} GROUP BY block)))""",
)
def x12(t: Tables) -> DataFrame:
    fitted, _ = within.fit_frame(t.cells.withColumn("x2", F.col("x") * F.col("x")), "block", "block", ["x", "x2"], ["y"])
    d = np.array(basis.basis_change(0.02, 0.08)) @ fitted.coef[:, 0]
    return t.spark.createDataFrame([(round(float(d), 2),)], "change double")


@query(
    "x14_endpoint_averages",
    """WITH s AS (SELECT sum(regr) / sum(sxx) AS slope FROM (SELECT regr_sxy(y, x) AS regr, regr_sxx(y, x) AS sxx FROM {cells} GROUP BY block)), b AS (SELECT block, avg(x) AS mx, avg(y) AS my FROM {cells} GROUP BY 1)
 SELECT e AS endpoint, round(avg(my + slope * (e - mx)), 3) AS mean FROM b CROSS JOIN s CROSS JOIN (VALUES (0.02), (0.08)) v(e) GROUP BY 1""",
)
def x14(t: Tables) -> DataFrame:
    m = within.centred_products(t.cells, "block", ["x"], ["y"]).agg((F.sum("xy_0_0") / F.sum("xx_0_0")).alias("slope"))
    means = t.cells.groupBy("block").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    ends = t.spark.createDataFrame([(0.02,), (0.08,)], "endpoint double")
    at = means.join(F.broadcast(m)).join(F.broadcast(ends))  # one row and two
    return at.groupBy("endpoint").agg(F.round(F.avg(F.col("my") + F.col("slope") * (F.col("endpoint") - F.col("mx"))), 3).alias("mean"))


@query(
    "x15_r28_spline_curve",
    f"""WITH {_moments3("x", spline_sql("x", 0.01), spline_sql("x", 0.03), "block")}, {_SOLVE3}
 SELECT v AS x, round(b0 * v + b1 * {spline_sql("v", 0.01)} + b2 * {spline_sql("v", 0.03)}, 2) AS curve FROM f CROSS JOIN (SELECT unnest(range(201)) / 2000.0 AS v)""",
)
def x15(t: Tables) -> DataFrame:
    knots = (0.01, 0.03, 0.06, 0.09)
    terms = basis.spline_terms(F.col("x"), knots)
    cells = t.cells.withColumns({"s1": terms[1], "s2": terms[2]})
    fitted, _ = within.fit_frame(cells, "block", "block", ["x", "s1", "s2"], ["y"])
    coef = {n: float(fitted.coef[i, 0]) for i, n in enumerate(fitted.names)}
    points = t.spark.range(0, 201).select((F.col("id") / 2000).alias("x"))
    at = [c * coef.get(n, 0.0) for n, c in zip(("x", "s1", "s2"), basis.spline_terms(F.col("x"), knots), strict=True)]
    return points.select("x", F.round(at[0] + at[1] + at[2], 2).alias("curve"))


_SLOPE2 = "((xy - sx * sy / n) * (zz - sz * sz / n) - (zy - sz * sy / n) * (xz - sx * sz / n)) / ((xx - sx * sx / n) * (zz - sz * sz / n) - power(xz - sx * sz / n, 2))"
_SUMS2 = ("n", "sx", "sz", "sy", "xx", "xz", "zz", "xy", "zy")


@query(
    "x16_r33_block_pass_jackknife",
    f"""WITH c AS (SELECT block, left(pass, 4) AS year, x, qty AS z, y, CAST(tax >= 0.04 AS INT) + 2 * CAST(qty >= 0.5 AS INT) AS quad, CAST(round(qty * 50) AS BIGINT) AS gx, word % 40 AS gy FROM {{cells}}),
 q AS (SELECT block, year, quad, count(*)::DOUBLE AS n, sum(x) AS sx, sum(z) AS sz, sum(y) AS sy, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM c GROUP BY 1, 2, 3),
 t AS (SELECT block, year, {", ".join(f"sum({v}) AS {v}" for v in _SUMS2)} FROM q GROUP BY 1, 2), w AS (SELECT *, {_SLOPE2} AS slope FROM t),
 j AS (SELECT block, year, sqrt((count(*) - 1) * var_pop({_SLOPE2})) AS jackknife_se FROM (SELECT t.block AS block, t.year AS year, {", ".join(f"t.{v} - q.{v} AS {v}" for v in _SUMS2)} FROM t JOIN q ON q.block = t.block AND q.year = t.year) GROUP BY 1, 2),
 f AS (SELECT *, sx / n AS mx, sz / n AS mz, sy / n AS my, xx - sx * sx / n AS cxx, xz - sx * sz / n AS cxz, zz - sz * sz / n AS czz, (zy - sz * sy / n - slope * (xz - sx * sz / n)) / (zz - sz * sz / n) AS b2 FROM w),
 e AS (SELECT c.block AS block, c.year AS year, gx, gy, y - my - slope * (x - mx) - b2 * (z - mz) AS e, 1 / n + (power(x - mx, 2) * czz - 2 * (x - mx) * (z - mz) * cxz + power(z - mz, 2) * cxx) / (cxx * czz - cxz * cxz) AS h FROM c JOIN f ON f.block = c.block AND f.year = c.year),
 s AS (SELECT block, year, sum(e * e) AS ss, max(h) AS leverage FROM e GROUP BY 1, 2),
 p AS (SELECT a.block AS block, a.year AS year, sum(a.e * b.e) AS products, count(*) AS n_pairs FROM e a JOIN e b ON a.block = b.block AND a.year = b.year AND ((b.gx = a.gx + 1 AND b.gy = a.gy) OR (b.gx = a.gx AND b.gy = a.gy + 1)) GROUP BY 1, 2)
 SELECT f.block AS block, f.year AS year, CAST(n AS BIGINT) AS n, round(slope, 2) AS slope, round(jackknife_se, 2) AS jackknife_se, round(leverage, 8) AS leverage, leverage > greatest(0.25, 6 / n) AS high_leverage,
 round(n * products / (n_pairs * ss), 6) AS moran, coalesce(n_pairs, 0) AS n_pairs, CAST(NULL AS VARCHAR) AS reason FROM f JOIN j USING (block, year) JOIN s USING (block, year) LEFT JOIN p USING (block, year)""",
)
def x16(t: Tables) -> DataFrame:
    q = ident.quadrant(F.col("tax"), F.col("qty"), F.lit(0.04), F.lit(0.5))
    cells = t.cells.withColumns({"quadrant": q, "year": F.substring("pass", 1, 4), "gx": F.round(F.col("qty") * 50).cast("bigint"), "gy": F.col("word") % 40})
    fits = inference.block_pass_fits(cells, ["block", "year"], "x", "y", ["qty"], "quadrant", ("gx", "gy"))
    return fits.withColumns({"slope": F.round("slope", 2), "jackknife_se": F.round("jackknife_se", 2), "leverage": F.round("leverage", 8), "moran": F.round("moran", 6)})


@query(
    "x17_x19_pass_model",
    """SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 6) AS se FROM (SELECT user_id AS x, avg(value) AS y FROM events GROUP BY 1)""",
)
def x17(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id").agg(F.avg("value").alias("y"))
    m = inference.ols(per, ["user_id"], "y")
    return t.spark.createDataFrame([(round(float(m["coef"][1]), 6), round(float(m["coef"][0]), 4), round(float(m["se"][1]), 6))], "slope double, intercept double, se double")


def t975_sql(name: str, freedom: str) -> str:
    """CTEs (of a recursive WITH) that halve an interval 60 times: name(t) is Student's 0.975 quantile; freedom: a query of v.

    For whole degrees of freedom the two-sided probability is a finite sum of powers of cos(atan(t / sqrt(v))).
    """
    angle = "atan(mid / sqrt(v))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, v // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * power(cos({angle}), 2 * j)))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, (v - 1) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * power(cos({angle}), 2 * j + 1))), 0))"
    below = f"CASE WHEN v % 2 = 0 THEN {even} ELSE {odd} END < 0.95"
    return f"""{name}_0 AS ({freedom}), {name}_n AS (SELECT v, 0 AS step, 0.0::DOUBLE AS lo, 1000.0::DOUBLE AS hi FROM {name}_0 UNION ALL
 SELECT v, step + 1, CASE WHEN {below} THEN mid ELSE lo END, CASE WHEN {below} THEN hi ELSE mid END FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name}_n WHERE step < 60)),
 {name} AS (SELECT hi AS t FROM {name}_n WHERE step = 60)"""


@query(
    "x18_prediction_interval",
    f"""WITH RECURSIVE u AS (SELECT user_id, avg(value) AS y, avg(CASE WHEN extract('hour' FROM ts) > 12 THEN 1.0 ELSE 0 END) AS late FROM events GROUP BY 1), d AS (SELECT * FROM u WHERE user_id % 2 = 0),
 m AS (SELECT count(*) AS n, avg(user_id) AS mp, avg(late) AS mq, avg(y) AS my, regr_sxx(y, user_id) AS pp, regr_sxx(y, late) AS qq, regr_sxy(late, user_id) AS pq, regr_sxy(y, user_id) AS py, regr_sxy(y, late) AS qy, regr_syy(y, late) AS yy FROM d),
 b AS (SELECT *, pp * qq - pq * pq AS det, (qq * py - pq * qy) / (pp * qq - pq * pq) AS b1, (pp * qy - pq * py) / (pp * qq - pq * pq) AS b2 FROM m), s AS (SELECT *, (yy - b1 * py - b2 * qy) / (n - 3) AS s2 FROM b),
 {t975_sql("q", "SELECT n - 3 AS v FROM m")},
 i AS (SELECT user_id, y, late, my + b1 * (user_id - mp) + b2 * (late - mq) AS mean, t * sqrt(s2 * (1 + 1.0 / n + (power(user_id - mp, 2) * qq - 2 * (user_id - mp) * (late - mq) * pq + power(late - mq, 2) * pp) / det)) AS half FROM u, s, q WHERE user_id % 2 = 1)
 SELECT user_id, round(y, 4) AS y, round(late, 6) AS late, round(mean, 4) AS mean, round(mean - half, 4) AS low, round(mean + half, 4) AS high, y BETWEEN mean - half AND mean + half AS covered FROM i""",
)
def x18(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id").agg(F.avg("value").alias("y"), F.avg((F.hour("ts") > 12).cast("double")).alias("late"))
    model = inference.ols(per.where("user_id % 2 = 0"), ["user_id", "late"], "y")
    out = inference.predict_interval(per.where("user_id % 2 = 1"), model).withColumn("covered", F.col("y").between(F.col("low"), F.col("high")))
    return out.withColumns({c: F.round(c, 4) for c in ("y", "mean", "low", "high")}).withColumn("late", F.round("late", 6))


_BY_DAY = "(SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS DOUBLE) AS n, sum(extract('hour' FROM ts)) AS h, sum(value) AS v, sum(extract('hour' FROM ts) * extract('hour' FROM ts)) AS hh, sum(extract('hour' FROM ts) * value) AS hv FROM events GROUP BY 1, 2)"
_SLOPE6 = "6 * (sum(times * hv) - sum(times * h) * sum(times * v) / sum(times * n)) / (sum(times * hh) - sum(times * h) * sum(times * h) / sum(times * n))"


def _strata_sql(rows: str, stratum: str, label: str, replicates: int, seed: int) -> str:
    """CTEs of resampling inside strata: i (rows with their place) and d (rep, s, place, times)."""
    return f"""q AS (SELECT *, {stratum} AS s FROM {rows}), i AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY CAST({label} AS VARCHAR)) - 1 AS place FROM q),
 d AS (SELECT rep, s, CAST('0x' || substr(sha256(concat_ws(':', {seed}, rep, s, k)), 1, 12) AS BIGINT) % size AS place, count(*) AS times
 FROM (SELECT s, count(*) AS size, unnest(range(count(*))) AS k FROM q GROUP BY s) CROSS JOIN (SELECT unnest(range({replicates})) AS rep) GROUP BY 1, 2, 3)"""


@query(
    "x20_time_contrast",
    f"""WITH {_strata_sql(_BY_DAY, "event_type", "day", 100, 11)}, r AS (SELECT i.event_type, rep, {_SLOPE6} AS v FROM d JOIN i ON i.s = d.s AND i.place = d.place GROUP BY 1, 2),
 p AS (SELECT event_type, {_SLOPE6} AS contrast FROM (SELECT *, 1 AS times FROM {_BY_DAY}) GROUP BY 1)
 SELECT p.event_type AS event_type, round(max(contrast), 6) AS contrast, round(quantile_cont(v, 0.025), 6) AS q025, round(quantile_cont(v, 0.975), 6) AS q975, round(stddev_samp(v), 6) AS se, count(v) AS estimable, count(*) AS requested FROM p JOIN r ON r.event_type = p.event_type GROUP BY 1""",
)
def x20(t: Tables) -> DataFrame:
    h = F.hour("ts").cast("double")
    days = t.events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").cast("double").alias("n"), F.sum(h).alias("h"), F.sum("value").alias("v"), F.sum(h * h).alias("hh"), F.sum(h * F.col("value")).alias("hv")
    )
    sums = [F.sum(F.col("times") * F.col(c)).alias(c) for c in ("n", "h", "v", "hh", "hv")]
    slope = 6 * (F.col("hv") - F.col("h") * F.col("v") / F.col("n")) / (F.col("hh") - F.col("h") * F.col("h") / F.col("n"))
    draws = resampling.resampled_rows(days, ["event_type"], "day", 100, 11).groupBy("event_type", "rep").agg(*sums).withColumn("value", slope)
    point = days.withColumn("times", F.lit(1)).groupBy("event_type").agg(*sums).select("event_type", slope.alias("contrast"))
    return rounded(inference.interval_summary(draws, ["event_type"], "value").join(point, "event_type"))


@query(
    "x21_shared_support",
    """WITH p AS (SELECT l_partkey, l_returnflag = 'R' AS arm, CAST(l_quantity AS BIGINT) AS x, CAST(round(l_discount * 100) AS BIGINT) AS y FROM lineitem GROUP BY ALL),
 a AS (SELECT DISTINCT g, unnest([-dy, dx]) AS ax, unnest([dx, dy]) AS ay FROM (SELECT u.l_partkey AS g, v.x - u.x AS dx, v.y - u.y AS dy FROM p u JOIN p v ON u.l_partkey = v.l_partkey AND (u.x, u.y) <> (v.x, v.y))),
 s AS (SELECT g, ax, ay, min(ax * x + ay * y) FILTER (WHERE arm) AS al, max(ax * x + ay * y) FILTER (WHERE arm) AS ah, min(ax * x + ay * y) FILTER (WHERE NOT arm) AS bl, max(ax * x + ay * y) FILTER (WHERE NOT arm) AS bh FROM a JOIN p ON l_partkey = g GROUP BY 1, 2, 3),
 c AS (SELECT g, bool_or(ah < bl OR bh < al) AS parted FROM s GROUP BY 1),
 k AS (SELECT l_partkey, count(*) FILTER (WHERE arm) AS n_a, count(*) FILTER (WHERE NOT arm) AS n_b FROM p GROUP BY 1)
 SELECT l_partkey, n_a > 0 AND n_b > 0 AND NOT coalesce(parted, false) AS meets FROM k LEFT JOIN c ON g = l_partkey""",
)
def x21(t: Tables) -> DataFrame:
    """Whether returned and other lines of a part share support: their hulls over quantity and discount meet."""
    rows = t.lineitem.select("l_partkey", (F.col("l_returnflag") == "R").alias("arm"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"))
    return hulls.overlaps(rows, ["l_partkey"], "arm", "x", "y").select("l_partkey", "meets")


@query(
    "x22_window_quantities",
    """SELECT grp, round(a - m, 6) AS difference_flux, round(-300.0 * (power((k - a) / k, 0.25) - 1) + 300.0 * (power((k - m) / k, 0.25) - 1), 6) AS difference_equivalent FROM
 (SELECT grp, avg(y / 1000) FILTER (WHERE x >= 0.05) AS a, avg(y / 1000) FILTER (WHERE x < 0.05) AS m, 0.98 * 5.670374419e-8 * power(300.0, 4) AS k FROM {cells} GROUP BY 1)""",
)
def x22(t: Tables) -> DataFrame:
    flux, high = F.col("y") / 1000, F.col("x") >= 0.05
    arms = t.cells.groupBy("grp").agg(F.avg(F.when(high, flux)).alias("a"), F.avg(F.when(~high, flux)).alias("m"))
    eq = lambda c: -physics.temperature_equivalent(-F.col(c), F.lit(300.0), F.lit(0.98))  # noqa: E731  flux is averaged before it is inverted
    return rounded(arms.select("grp", (F.col("a") - F.col("m")).alias("difference_flux"), (eq("a") - eq("m")).alias("difference_equivalent")))


@query(
    "x23_draw_summary",
    "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS q025, round(quantile_cont(value, 0.975), 6) AS q975, round(stddev_samp(value), 6) AS se, count(value) AS estimable, count(*) AS requested FROM (SELECT event_type, CASE WHEN event_id % 9 <> 0 THEN value END AS value FROM events) GROUP BY 1",
)
def x23(t: Tables) -> DataFrame:
    draws = t.events.select("event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"))
    return rounded(inference.interval_summary(draws, ["event_type"], "value"))


@query(
    "x25_matched_draw_difference",
    "SELECT a.block AS block, round(a.m - b.m, 4) AS difference FROM (SELECT block, avg(y) AS m FROM {cells} WHERE x > 0.05 GROUP BY 1) a JOIN (SELECT block, avg(y) AS m FROM {cells} WHERE x <= 0.05 GROUP BY 1) b ON a.block = b.block",
)
def x25(t: Tables) -> DataFrame:
    a = t.cells.where("x > 0.05").groupBy("block").agg(F.avg("y").alias("a"))
    b = t.cells.where("x <= 0.05").groupBy("block").agg(F.avg("y").alias("b"))
    return rounded(a.join(b, "block").select("block", (F.col("a") - F.col("b")).alias("difference")), 4)


def _determinant(rows: list[int], columns: list[int]) -> str:
    """The determinant of a part of the correlation matrix, its entries named r<i><j>, written out."""
    if not rows:
        return "1.0"
    entry = lambda i, j: "1.0" if i == j else f"r{min(i, j)}{max(i, j)}"
    terms = (f"({1 - 2 * (k % 2)}.0) * {entry(rows[0], j)} * ({_determinant(rows[1:], columns[:k] + columns[k + 1 :])})" for k, j in enumerate(columns))
    return "(" + " + ".join(terms) + ")"


def _largest_sql(name: str, diagonal: float, sign: str) -> str:
    """CTEs that square a 4 x 4 matrix (diagonal, and signed correlations) 60 times over its trace: name(value) is its largest eigenvalue."""
    cells = [(i, j) for i in range(4) for j in range(i, 4)]
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    first = ", ".join(f"{f'{diagonal}::DOUBLE' if i == j else f'{sign}r{i}{j}'} AS {m(i, j)}" for i, j in cells)
    squared = ", ".join(f"({' + '.join(f'{m(i, k)} * {m(k, j)}' for k in range(4))}) / power(m00 + m11 + m22 + m33, 2) AS {m(i, j)}" for i, j in cells)
    product = " + ".join(f"a.{m(i, j)} * b.{m(i, j)} * {1 if i == j else 2}" for i, j in cells)
    return f"""{name}_0 AS (SELECT 0 AS step, {first} FROM r), {name}_n AS (SELECT * FROM {name}_0 UNION ALL SELECT step + 1, {squared} FROM {name}_n WHERE step < 60),
 {name} AS (SELECT ({product}) / (b.m00 + b.m11 + b.m22 + b.m33) AS value FROM {name}_0 a, (SELECT * FROM {name}_n WHERE step = 60) b)"""


_TERMS = ("x", "tax", "qty", "y")


@query(
    "x26_x27_collinearity",
    f"""WITH RECURSIVE r AS (SELECT {", ".join(f"corr({_TERMS[i]}, {_TERMS[j]}) AS r{i}{j}" for i in range(4) for j in range(i + 1, 4))} FROM {{cells}}),
 {_largest_sql("top", 1.0, "")},
 {_largest_sql("rest", 3.0, "-")},
 v AS ({" UNION ALL ".join(f"SELECT '{c}' AS term, {_determinant([k for k in range(4) if k != i], [k for k in range(4) if k != i])} / {_determinant([0, 1, 2, 3], [0, 1, 2, 3])} AS vif FROM r" for i, c in enumerate(_TERMS))})
 SELECT term, round(vif, 6) AS vif, round(sqrt(top.value / (4 - rest.value)), 6) AS condition_index, CAST(4 AS INT) AS rank FROM v, top, rest""",
)
def x26(t: Tables) -> DataFrame:
    index, rank, vif = inference.collinearity(t.cells, list(_TERMS))
    return t.spark.createDataFrame([(c, round(v, 6), round(index, 6), rank) for c, v in vif.items()], "term string, vif double, condition_index double, rank int")


@query("x28_concurvity")
def x28(t: Tables) -> DataFrame:
    per = t.cells.groupBy("grp", "block").agg(F.avg("x").alias("x"), F.avg("tax").alias("tax"), F.avg("y").alias("y"))
    return inference.concurvity(per, ["grp"], "y", ["x", "tax"])


@query("x29_support_ruling", "SELECT grp, count(*) AS blocks, CASE WHEN count(*) >= 8 AND min(w) >= 0.1 THEN 'KEEP' ELSE 'DROP' END AS ruling FROM (SELECT grp, block, max(x) - min(x) AS w FROM {cells} GROUP BY 1, 2) GROUP BY 1")
def x29(t: Tables) -> DataFrame:
    w = t.cells.groupBy("grp", "block").agg((F.max("x") - F.min("x")).alias("w"))
    ok = (F.count("*") >= 8) & (F.min("w") >= 0.1)
    return w.groupBy("grp").agg(F.count("*").alias("blocks"), F.when(ok, "KEEP").otherwise("DROP").alias("ruling"))


@query(
    "x31_moment_interval",
    f"""WITH RECURSIVE d AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS y FROM events WHERE event_type = 'purchase' GROUP BY 1), k AS (SELECT y, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM d),
 m AS (SELECT count(*) AS n, regr_syy(y, k) AS syy, regr_sxy(y, k) AS sxy, regr_sxx(y, k) AS sxx, avg(y) FILTER (WHERE k <= n // 2) AS a, avg(y) FILTER (WHERE k > n // 2) AS b FROM k),
 v AS (SELECT *, greatest(0, (syy - sxy * sxy / sxx) / (n - 2) - 0.5) AS tau2 FROM m), {t975_sql("q", "SELECT n - 2 AS v FROM m")}, h AS (SELECT *, t * sqrt((0.5 + tau2) * (1.0 / (n // 2) + 1.0 / (n - n // 2))) AS half FROM v, q)
 SELECT round(a - b - half, 5) AS low, round(a - b + half, 5) AS high, round(tau2, 6) AS tau2 FROM h""",
)
def x31(t: Tables) -> DataFrame:
    days = t.events.where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("d")).agg(F.avg("value").alias("y"))
    k = days.select("y", F.row_number().over(W.orderBy("d")).alias("k"))  # one row a day
    k = k.crossJoin(F.broadcast(days.agg(F.count("*").alias("n"))))
    first = F.col("k") <= F.floor(F.col("n") / 2)
    m = k.agg(F.count("*").alias("n"), F.regr_syy("y", "k").alias("syy"), F.regr_sxy("y", "k").alias("sxy"), F.regr_sxx("y", "k").alias("sxx"),
              F.avg(F.when(first, F.col("y"))).alias("a"), F.avg(F.when(~first, F.col("y"))).alias("b")).first()
    low, high, tau2 = inference.trend_moment_interval(m["n"], m["syy"], m["sxy"], m["sxx"], m["a"], m["b"], 0.5)
    return rounded(t.spark.createDataFrame([(low, high, tau2)], "low double, high double, tau2 double").select(F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "tau2"))


@query(
    "x32_draw_covariance",
    "SELECT round(covar_samp(a, b), 2) AS cov, round(var_samp(a), 2) AS var_a, round(var_samp(b), 2) AS var_b FROM (SELECT block, avg(y) FILTER (WHERE x > 0.05) AS a, avg(y) FILTER (WHERE x <= 0.05) AS b FROM {cells} GROUP BY 1)",
)
def x32(t: Tables) -> DataFrame:
    d = t.cells.groupBy("block").agg(F.avg(F.when(F.col("x") > 0.05, F.col("y"))).alias("a"), F.avg(F.when(F.col("x") <= 0.05, F.col("y"))).alias("b"))
    return d.agg(F.round(F.covar_samp("a", "b"), 2).alias("cov"), F.round(F.var_samp("a"), 2).alias("var_a"), F.round(F.var_samp("b"), 2).alias("var_b"))


@query(
    "x33_interval_coverage",
    """SELECT grp, count(*) AS estimable, round(avg(c), 6) AS coverage, round(sqrt(avg(c) * (1 - avg(c)) / count(*)), 6) AS coverage_mcse, round(avg(high - low), 4) AS mean_width, round(avg(point - 26000), 4) AS bias FROM
 (SELECT grp, point, low, high, CASE WHEN 26000 BETWEEN low AND high THEN 1.0 ELSE 0 END AS c FROM (SELECT grp, block, avg(y) AS point, avg(y) - 2 * stddev_samp(y) / sqrt(count(*)) AS low, avg(y) + 2 * stddev_samp(y) / sqrt(count(*)) AS high FROM {cells} GROUP BY 1, 2)) GROUP BY 1""",
)
def x33(t: Tables) -> DataFrame:
    half = 2 * F.stddev_samp("y") / F.sqrt(F.count("*"))
    made = t.cells.groupBy("grp", "block").agg(F.avg("y").alias("point"), (F.avg("y") - half).alias("low"), (F.avg("y") + half).alias("high"))
    c = inference.coverage(made, ["grp"], F.lit(26000.0))
    return c.select("grp", "estimable", F.round("coverage", 6).alias("coverage"), F.round("coverage_mcse", 6).alias("coverage_mcse"), F.round("mean_width", 4).alias("mean_width"), F.round("bias", 4).alias("bias"))


@query(
    "x35_x37_mixing_scenarios",
    "SELECT f AS fraction, round(avg(f * 295 + (1 - f) * (305 + x)), 6) AS mean, round(avg(f * 295 + (1 - f) * (305 + x)) - avg(305 + x), 6) AS effect FROM {cells} CROSS JOIN (VALUES (0.0), (0.1), (0.2), (0.3), (0.5), (0.7), (0.9)) v(f) GROUP BY 1",
)
def x35(t: Tables) -> DataFrame:
    fractions = t.spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)], "fraction double")
    out = 305 + F.col("x")
    mixed = physics.mixed(F.col("fraction"), F.lit(295.0), out)
    both = t.cells.select("x").join(F.broadcast(fractions))  # seven scenarios
    return rounded(both.groupBy("fraction").agg(F.avg(mixed).alias("mean"), (F.avg(mixed) - F.avg(out)).alias("effect")), skip=("fraction",))


@query(
    "x36_x39_reference_sensitivity",
    """WITH g AS (SELECT grp, avg(y) / 1000 AS flux FROM {cells} GROUP BY 1) SELECT grp, k AS reference_k, e AS reference_eps, round(k * (power((e * 5.670374419e-8 * power(k, 4) - flux) / (e * 5.670374419e-8 * power(k, 4)), 0.25) - 1), 6) AS equivalent
 FROM g CROSS JOIN (VALUES (290.0), (300.0), (310.0)) a(k) CROSS JOIN (VALUES (0.95), (0.97), (0.99)) b(e)""",
)
def x36(t: Tables) -> DataFrame:
    """The change of flux of each group as a temperature at every frozen reference: three temperatures by three emissivities."""
    flux = t.cells.groupBy("grp").agg((F.avg("y") / 1000).alias("flux"))
    anchors = F.array(*(F.struct(F.lit(k).alias("reference_k"), F.lit(e).alias("reference_eps")) for k in (290.0, 300.0, 310.0) for e in (0.95, 0.97, 0.99)))
    at = flux.select("grp", "flux", F.explode(anchors).alias("a")).select("grp", "flux", "a.*")
    equivalent = physics.temperature_equivalent(-F.col("flux"), F.col("reference_k"), F.col("reference_eps"))
    return at.select("grp", "reference_k", "reference_eps", F.round(equivalent, 6).alias("equivalent"))


_DAYS = "(SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%m') AS month, extract('hour' FROM ts) >= 12 AS late, avg(value) AS v FROM events GROUP BY 1, 2, 3)"


@query(
    "x30_stratified_day_bank",
    f"""WITH {_strata_sql(_DAYS, "month || '/' || late", "day", 100, 5)}, n AS (SELECT s, count(*) AS n FROM q GROUP BY 1)
 SELECT rep, round(sum(CASE WHEN late THEN 1 ELSE -1 END * times * v / n) / count(DISTINCT i.month), 6) AS difference FROM d JOIN i ON i.s = d.s AND i.place = d.place JOIN n ON n.s = d.s GROUP BY 1""",
)
def x30(t: Tables) -> DataFrame:
    """Late minus early, months weighing the same, with days resampled inside month and window."""
    days = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "MM").alias("month"), (F.hour("ts") >= 12).alias("late")).agg(F.avg("value").alias("v"))
    n = days.groupBy("month", "late").agg(F.count("*").alias("n"))
    drawn = resampling.resampled_rows(days, ["month", "late"], "day", 100, 5).join(n, ["month", "late"])
    sign = F.when(F.col("late"), 1).otherwise(-1)
    return drawn.groupBy("rep").agg(F.round(F.sum(sign * F.col("times") * F.col("v") / F.col("n")) / F.count_distinct("month"), 6).alias("difference"))


@query(
    "x30_day_slope_bank",
    f"""WITH {_draws_sql("(SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(min(epoch(date_trunc('day', ts))) / 86400 AS DOUBLE) AS x, avg(value) AS v FROM events GROUP BY 1)", "day", 100, 6)}
 SELECT rep, round(10 * (sum(times * (x - 19000) * v) - sum(times * (x - 19000)) * sum(times * v) / sum(times)) / (sum(times * (x - 19000) * (x - 19000)) - sum(times * (x - 19000)) * sum(times * (x - 19000)) / sum(times)), 6) AS change FROM d JOIN i ON i.place = d.place GROUP BY 1""",
)
def x30_slope(t: Tables) -> DataFrame:
    """Change in ten days of a trend over days, refitted on resampled days."""
    x = (F.floor(F.unix_seconds(F.min("ts")) / 86400) - 19000).cast("double")
    days = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(x.alias("x"), F.avg("value").alias("v"))
    made = days.select("day", F.lit(1.0).alias("n"), "x", "v", (F.col("x") * F.col("x")).alias("xx"), (F.col("x") * F.col("v")).alias("xv"))
    r = resampling.resampled_sums(made, "day", ["n", "x", "v", "xx", "xv"], 100, 6)
    slope = (F.col("xv") - F.col("x") * F.col("v") / F.col("n")) / (F.col("xx") - F.col("x") * F.col("x") / F.col("n"))
    return r.select("rep", F.round(10 * slope, 6).alias("change"))


@query(
    "x40_variance_bootstrap",
    f"""WITH {_strata_sql("(SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS v FROM events GROUP BY 1, 2)", "event_type", "day", 200, 8)},
 r AS (SELECT i.event_type, rep, (sum(times * v * v) - sum(times * v) * sum(times * v) / sum(times)) / (sum(times) - 1) AS var FROM d JOIN i ON i.s = d.s AND i.place = d.place GROUP BY 1, 2)
 SELECT event_type, round(quantile_cont(var, 0.025), 6) AS q025, round(quantile_cont(var, 0.975), 6) AS q975, round(stddev_samp(var), 6) AS se, count(var) AS estimable, count(*) AS requested FROM r GROUP BY 1""",
)
def x40(t: Tables) -> DataFrame:
    days = t.events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("v"))
    drawn, n, v = resampling.resampled_rows(days, ["event_type"], "day", 200, 8), F.col("times"), F.col("v")
    var = (F.sum(n * v * v) - F.sum(n * v) * F.sum(n * v) / F.sum(n)) / (F.sum(n) - 1)
    return rounded(inference.interval_summary(drawn.groupBy("event_type", "rep").agg(var.alias("value")), ["event_type"], "value"))


@query(
    "x_arm_contrast",
    "SELECT event_type, CASE WHEN count(*) FILTER (WHERE extract('hour' FROM ts) < 12) > 0 AND count(*) FILTER (WHERE extract('hour' FROM ts) >= 12) > 0 THEN round(avg(value) FILTER (WHERE extract('hour' FROM ts) < 12) - avg(value) FILTER (WHERE extract('hour' FROM ts) >= 12), 6) END AS difference FROM events GROUP BY 1",
)
def xc(t: Tables) -> DataFrame:
    early = F.hour("ts") < 12
    e = t.events.withColumn("early", early)
    n = e.groupBy("event_type", "early").agg(F.count("*").alias("n"))
    w = F.when(F.col("early"), 1.0).otherwise(-1.0) / F.col("n")
    return rounded(design.arm_contrast(e.join(n, ["event_type", "early"]).withColumn("w", w), ["event_type"], "value", "w"))
