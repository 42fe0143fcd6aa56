"""Known answers of column functions and operators on small frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.functions import basis, bits, clock, ident, physics, sun
from swathkit.operators import aggregates, design, graph, grid, inference, joins, select, within
from swathkit.operators.contracts import ContractError, guarded_path, readiness, require_columns, require_count, require_exact_columns, require_finite, require_unique


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def stamp(text):
    return F.lit(text).cast("timestamp")


def test_vpd_and_saturation(spark):
    assert one(spark, physics.vpd_kpa(F.lit(293.15), F.lit(283.15))) == pytest.approx(1.11031865, abs=1e-7)
    assert one(spark, physics.vpd_kpa(F.lit(283.15), F.lit(293.15))) == 0


def test_hour_brackets(spark):
    t = stamp("2023-06-26 17:55:48.103")
    assert str(one(spark, clock.hour_floor(t))) == "2023-06-26 17:00:00"
    assert str(one(spark, clock.hour_ceil(t))) == "2023-06-26 18:00:00"
    assert one(spark, clock.hour_weight(t)) == pytest.approx((55 * 60 + 48.103) / 3600)
    assert one(spark, clock.hour_weight(stamp("2023-06-26 17:00:00"))) == 0


def test_windows_of_day(spark):
    hours = [9.49, 9.5, 11.49, 11.5, 14.99, 15.0, 17.99, 18.0]
    rows = spark.createDataFrame([(h,) for h in hours], "h double").select("h", clock.window_of_day(F.col("h")).alias("w")).collect()
    assert [dict((r["h"], r["w"]) for r in rows)[h] for h in hours] == ["outside", "morning", "morning", "middle", "middle", "afternoon", "afternoon", "outside"]


def test_floor_of_negative_blocks(spark):
    labels = {"8_8": "1_1", "15_8": "1_1", "-1_0": "-1_0"}
    for a, b in labels.items():
        assert one(spark, ident.coarser_block(F.lit(a), 8)) == b


def test_strict_and_lenient_zones(spark):
    assert one(spark, clock.utc_strict(F.lit("2024-01-01T00:00:00"))) is None
    assert str(one(spark, clock.utc_strict(F.lit("2024-01-01T00:00:00-04:00")))) == "2024-01-01 04:00:00"
    assert str(one(spark, clock.utc_lenient(F.lit("2024-01-01T00:00:00")))) == "2024-01-01 00:00:00"


def test_energy_inverse(spark):
    m = physics.emitted_energy(F.lit(0.97), F.lit(305.0)) - physics.emitted_energy(F.lit(0.97), F.lit(300.0))
    assert one(spark, physics.temperature_equivalent(m, F.lit(300.0), F.lit(0.97))) == pytest.approx(5.0)
    assert one(spark, physics.emitted_energy(F.lit(1.2), F.lit(300.0))) is None


def test_scaled_and_masks(spark):
    assert one(spark, bits.scaled(F.lit(250), 0.002, 0.49, 65535)) == pytest.approx(0.99)
    assert one(spark, bits.scaled(F.lit(65535), 0.002, 0.49, 65535)) is None
    assert one(spark, bits.usable_cell(F.lit(None).cast("double"), F.lit(0), F.lit(0), F.lit(0))) is False
    assert one(spark, bits.clear_word(F.lit(0b10000001)))
    assert not one(spark, bits.clear_word(F.lit(0b11000000)))


def test_spline_is_linear_beyond_knots(spark):
    term = basis.spline_terms(F.col("x"), (0.1, 0.3, 0.6, 0.9))[1]
    v = [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,)], "x double").orderBy("x").select(term).collect()]
    assert v[0] == 0 and v[2] - v[1] == pytest.approx(v[3] - v[2])


def test_sun_is_high_at_noon(spark):
    args = (F.lit(33.45), F.lit(172), F.lit(12.0), F.lit(365))
    assert one(spark, sun.zenith(*args)) == pytest.approx(10.0, abs=0.2)
    assert one(spark, sun.azimuth(*args)) == pytest.approx(180.0, abs=0.5)


def test_balanced_weights(spark):
    rows = [("a", "morning"), ("a", "afternoon"), ("b", "morning"), ("b", "morning"), ("b", "afternoon"), ("c", "morning"), ("c", "middle"), ("d", "afternoon")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, stratum string, arm string")
    w = {r["id"]: r["weight"] for r in design.balanced_weights(df, "stratum", "arm", ("morning", "afternoon")).collect()}
    assert [w[i] for i in range(8)] == [0.5, 0.5, 0.25, 0.25, 0.5, 0, 0, 0]


def test_trailing_is_all_or_nothing(spark):
    hours = [(h, 1.0) for h in range(24)]
    for bad, total, there in ((None, 24.0, 24), (5, None, 23)):
        rows = [(h, -1.0 if h == bad else v) for h, v in hours]
        series = spark.createDataFrame(rows, "h int, v double").select((stamp("2024-01-01 00:00:00") + F.make_interval(hours=F.col("h"))).alias("hour"), "v")
        points = spark.range(1).select("id", stamp("2024-01-02 00:59:59").alias("ts"))
        r = joins.trailing_totals(points, series, ["id"], "ts", "hour", "v", 24).first()
        assert (r["total"], r["hours_there"]) == (total, there)


def test_bracket_missing_hour_is_null(spark):
    series = spark.createDataFrame([("2024-01-01 00:00:00", 300.0), ("2024-01-01 01:00:00", 304.0)], "h string, v double").select(F.col("h").cast("timestamp").alias("hour"), "v")
    points = spark.createDataFrame([(1, "2024-01-01 00:15:00"), (2, "2024-01-01 01:30:00"), (3, "2024-01-01 01:00:00")], "id int, s string").select("id", F.col("s").cast("timestamp").alias("ts"))
    got = {r["id"]: r["v"] for r in joins.bracket(points, series, "ts", "hour", ["v"]).collect()}
    assert got == {1: 301.0, 2: None, 3: 304.0}


def test_revisions_compare_as_numbers(spark):
    df = spark.createDataFrame([("k", 9, "old"), ("k", 10, "new")], "k string, rev int, v string")
    assert select.latest_revision(df, ["k"], ["rev"]).first()["v"] == "new"


def test_area_average_and_shift(spark):
    fine = spark.createDataFrame([(0.0, 0.0, 0.0), (35.0, 0.0, 1.0), (0.0, 35.0, 0.2), (35.0, 35.0, 0.6)], "x double, y double, v double")
    assert grid.area_average(fine, [], "x", "y", "v", 35.0, 70.0).first()["mean"] == pytest.approx(0.45)
    cells = spark.createDataFrame([(r, c, float(3 * r + c)) for r in range(3) for c in range(3)], "row long, col long, v double")
    moved = {(r["row"], r["col"]): r["v"] for r in grid.shifted(cells, [], "row", "col", "v", [(0, 1)]).collect()}
    assert moved[(0, 0)] is None and moved[(0, 1)] == 0.0 and moved[(2, 2)] == 7.0


def test_scene_merge_bad_wins(spark):
    rows = [(1, 1, 302.0, False), (1, 2, 303.0, False), (2, 1, 302.0, True), (2, 2, 303.0, False)]
    df = spark.createDataFrame(rows, "cell int, scene int, v double, bad boolean")
    got = {r["cell"]: r["v"] for r in grid.merge_scenes(df, ["cell"], "v", F.col("bad"), ["scene"]).collect()}
    assert got == {1: 303.0, 2: None}


def blocks_frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for b in range(20):
        for _ in range(50):
            f, x = 0.005 * rng.normal() + 0.015 * b + 0.1, rng.normal()
            rows.append((f"{b}", float(f), float(x), float(290 + 2 * b - 8 * f + 3 * x)))
    return spark.createDataFrame(rows, "block string, f double, x double, y double")


def test_slope_under_confounding(spark):
    fitted, m = within.fit_frame(blocks_frame(spark), "block", "block", ["f", "x"], ["y"])
    assert fitted.coef[0, 0] == pytest.approx(-8.0, abs=1e-8) and fitted.cluster_se[0] < 1e-8
    draws = within.bootstrap_table(m, 20, 1).collect()
    assert len(draws) == 20 and np.allclose([r["coef"][0] for r in draws], -8.0)


def test_bootstrap_equals_refit_on_copies(spark):
    df = blocks_frame(spark).withColumn("y", F.col("y") + F.col("f") * F.col("block").cast("double"))
    _, m = within.fit_frame(df, "block", "block", ["f"], ["y"])
    rows = m.table.orderBy("g").collect()
    counts = [(i * 7) % 3 for i in range(len(rows))]
    beta = sum(c * r["xy_0_0"] for c, r in zip(counts, rows, strict=True)) / sum(c * r["xx_0_0"] for c, r in zip(counts, rows, strict=True))
    table = spark.createDataFrame([(r["g"], c) for r, c in zip(rows, counts, strict=True)], "block string, times int")
    copies = df.join(table, "block").where("times > 0").withColumn("k", F.explode(F.sequence(F.lit(1), "times"))).withColumn("block", F.concat_ws("/", "block", F.col("k").cast("string")))
    again, _ = within.fit_frame(copies, "block", "block", ["f"], ["y"])
    assert again.coef[0, 0] == pytest.approx(beta)


def test_context_selection_protects_the_predictor(spark):
    df = blocks_frame(spark).withColumns({"x2": F.col("x") * 2, "c": F.lit(1.0), "copy": F.col("f")})
    fitted, _ = within.fit_frame(df, "block", "block", ["f", "x", "x2", "c"], ["y"])
    assert len(fitted.diagnostics["removed"]) == 2
    with pytest.raises(ContractError, match="identifiable"):
        within.fit_frame(df, "block", "block", ["f", "copy"], ["y"])


def test_t_quantile_and_ols(spark):
    assert inference.t_quantile(0.975, 15) == pytest.approx(2.131449546, abs=1e-7)
    assert inference.t_quantile(0.975, 1) == pytest.approx(12.7062047, abs=1e-5)
    df = spark.createDataFrame([(float(x), float(2 + 3 * x + (-1) ** x)) for x in range(12)], "x double, y double")
    m = inference.ols(df, ["x"], "y")
    slope, intercept = np.polyfit(range(12), [2 + 3 * x + (-1) ** x for x in range(12)], 1)
    assert m["coef"][1] == pytest.approx(slope) and m["coef"][0] == pytest.approx(intercept)
    assert inference.predict_interval(df, m).where("y between low and high").count() == 12


def test_moment_interval():
    y, w = np.array([1.0, 1.0, -1.0, -1.0]), np.array([0.5, 0.5, -0.5, -0.5])
    low, high, tau2 = inference.moment_interval(y, w, np.eye(4) * 9, np.ones((4, 1)))
    assert low < 2 < high and tau2 == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (3, 6)], "u long, v long")
    assert {r["node"]: r["root"] for r in graph.component_labels(edges).collect()} == {1: 1, 2: 1, 3: 1, 6: 1, 4: 4, 5: 4}
    assert graph.largest_component_share(edges).first().asDict() == {"n_components": 2, "share": 0.75}


def test_moran_of_a_gradient(spark):
    cells = spark.createDataFrame([(x, y, float(x)) for x in range(6) for y in range(6)], "x long, y long, v double")
    r = grid.moran(joins.neighbours(cells, [], "x", "y", "v"), cells, "v").first()
    assert r["n_pairs"] == 60 and r["moran"] > 0.5


def test_mode_breaks_ties_to_the_smallest(spark):
    df = spark.createDataFrame([("b", 2), ("b", 1), ("b", 2), ("b", 1)], "b string, v int")
    assert aggregates.mode_of(df, ["b"], "v").first()["v"] == 1


def test_contracts(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None)], "a int, b double")
    for check in (lambda: require_columns(df, ["z"]), lambda: require_unique(df, ["a"]), lambda: require_finite(df, ["b"]), lambda: require_count(df, 3), lambda: require_exact_columns(df, ["a"])):
        with pytest.raises(ContractError):
            check()
    checks = spark.createDataFrame([("x", 1, 1), ("y", 1, 2)], "name string, observed int, expected int")
    assert readiness(checks).first().asDict() == {"n_checks": 2, "n_passed": 1, "ready": False, "failed": "y"}
    assert guarded_path("/out", "a/b.csv") == "/out/a/b.csv"
    for bad in ("/abs", "a/../b", "x/sealed_a"):
        with pytest.raises(ContractError):
            guarded_path("/out", bad, ("sealed",))


def test_operators_take_empty_frames(spark):
    empty = spark.createDataFrame([], "block string, x double, y double, ts timestamp, event int")
    assert aggregates.span(empty, ["block"], "x").count() == 0
    assert select.latest_revision(empty, ["block"], ["x"]).count() == 0
    assert within.centred_products(empty, "block", ["x"], ["y"]).count() == 0
    assert design.natural_gap(empty, "x").first()["low"] is None


def test_utm_on_the_central_meridian(spark):
    from swathkit.functions import project

    for lat, north in ((0.0, 0.0), (45.0, 4982950.4)):
        x, y = project.utm(F.lit(-111.0), F.lit(lat), F.lit(12))
        assert one(spark, x) == pytest.approx(500000) and one(spark, y) == pytest.approx(north, abs=0.5)
    x, _ = project.utm(F.lit(-110.0), F.lit(0.0), F.lit(12))
    assert one(spark, x) == pytest.approx(611280.5, abs=60)
