"""Resampling, calibration and within-group inference against known answers."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.operators import aggregates, design, inference, resampling, within


def plain_draw(n, *parts):
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) % n


def test_multiplicities_are_the_digests(spark):
    got = {(r["rep"], r["place"]): r["times"] for r in resampling.multiplicities(spark, 7, 20, 3).collect()}
    want = {}
    for rep in range(20):
        for k in range(7):
            key = (rep, plain_draw(7, 3, rep, k))
            want[key] = want.get(key, 0) + 1
    assert got == want
    assert resampling.multiplicities(spark, 0, 5, 3).count() == 0


def frame(spark, shift=0.0, blocks=6):
    rng = np.random.default_rng(4)
    rows = [(b, float(x), float((2 + b + shift) * x + b)) for b in range(blocks) for x in rng.random(8)]
    return spark.createDataFrame(rows, "block long, x double, y double")


def test_joint_draws_share_their_groups(spark):
    a = within.fit_frame(frame(spark), "block", "block", ["x"], ["y"])[1]
    rows = within.joint_bootstrap([a, a], 20, 9).collect()
    by = {}
    for r in rows:
        by.setdefault(r["rep"], {})[r["population"]] = r["coef"]
    assert len(by) == 20 and all(v[0] == v[1] for v in by.values())


def test_joint_draw_equals_a_fit_of_copies(spark):
    df = frame(spark)
    m = within.fit_frame(df, "block", "block", ["x"], ["y"])[1]
    draws = {r["rep"]: r["coef"][0] for r in within.bootstrap_table(m, 5, 2).collect()}
    labels = sorted(map(str, range(6)))
    cells = df.toPandas()
    for rep in range(5):
        xx = xy = 0.0
        for k in range(6):
            own = cells[cells.block == int(labels[plain_draw(6, 2, rep, k)])]
            x = own.x - own.x.mean()
            xx, xy = xx + float(x @ x), xy + float(x @ own.y)
        assert draws[rep] == pytest.approx(xy / xx)


def test_population_without_a_drawn_group_has_no_coefficient(spark):
    one = within.Moments(within.fit_frame(frame(spark), "block", "block", ["x"], ["y"])[1].table.where("g = '0'"), ["x"], ["y"])
    whole = within.fit_frame(frame(spark), "block", "block", ["x"], ["y"])[1]
    rows = within.joint_bootstrap([whole, one], 60, 6).collect()
    assert all(r["coef"] is not None for r in rows if r["population"] == 0)
    assert 0 < sum(r["coef"] is None for r in rows if r["population"] == 1) < 60


def test_clustered_error_by_matrices(spark):
    rng = np.random.default_rng(1)
    n, block = 300, np.repeat(np.arange(30), 10)
    x, z = rng.random(n), rng.random(n)
    y = 3 * x - z + 0.5 * block + rng.normal(size=n) * (1 + block % 3)
    df = spark.createDataFrame([(int(b), int(b // 3), float(p), float(q), float(r)) for b, p, q, r in zip(block, x, z, y)], "block long, grp long, x double, z double, y double")
    fitted, _ = within.fit_frame(df, "block", "grp", ["x", "z"], ["y"])
    design_ = np.column_stack([x, z, *(block == b for b in range(30))]).astype(float)
    beta, *_ = np.linalg.lstsq(design_, y, rcond=None)
    inverse = np.linalg.inv(design_.T @ design_)
    e, grp = y - design_ @ beta, block // 3
    meat = sum(np.outer(s, s) for g in range(10) for s in [design_[grp == g].T @ e[grp == g]])
    variance = (inverse @ meat @ inverse)[0, 0] * 10 / 9 * (n - 1) / (n - 32)
    assert fitted.coef[0, 0] == pytest.approx(beta[0]) and fitted.cluster_se[0] == pytest.approx(variance**0.5)


def test_natural_gap_across_bins(spark):
    values = [0.0, 0.1, 0.2, 7.0, 7.05, 7.1, 100.0]
    df = spark.createDataFrame([(v,) for v in values] * 2, "v double")
    assert tuple(design.natural_gap(df, "v").first()) == (7.1, 100.0)
    assert tuple(design.natural_gap(spark.createDataFrame([(1,), (2,), (3,)], "v long"), "v").first()) == (None, None)
    assert tuple(design.natural_gap(spark.createDataFrame([(1,)], "v long"), "v").first()) == (None, None)


def test_upper_median_of_a_hot_key(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", int(v)) for v in rng.integers(0, 50, 501)] + [("one", 7), ("two", 1), ("two", 9)]
    got = {r["k"]: r["v"] for r in aggregates.upper_median(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", 10).collect()}
    assert got == {k: sorted(v for j, v in rows if j == k)[sum(j == k for j, _ in rows) // 2] for k in ("hot", "one", "two")}


def test_collinearity_by_matrices(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    index, rank, vif = inference.collinearity(df, ["a", "b", "c"])
    r = np.corrcoef(x.T)
    values = np.linalg.eigvalsh(r)
    assert rank == 3 and index == pytest.approx((values[-1] / values[0]) ** 0.5) and list(vif.values()) == pytest.approx(list(np.diag(np.linalg.inv(r))))
    _, rank, vif = inference.collinearity(df.withColumn("d", F.col("a") * 2), ["a", "b", "d"])
    assert rank == 2 and all(np.isinf(v) for v in vif.values())



def test_known_curve_is_recovered_on_any_support(spark):
    """A curve with a known slope is found whatever part of the range the cells cover."""
    for low, high in ((0.0, 1.0), (0.2, 0.5), (0.6, 0.9)):
        x = np.linspace(low, high, 40)
        df = spark.createDataFrame([(int(k % 4), float(v), float(v * v), float(2 * v - v * v + k % 4)) for k, v in enumerate(x)], "block long, x double, x2 double, y double")
        fitted, _ = within.fit_frame(df, "block", "block", ["x", "x2"], ["y"])
        assert fitted.coef[:, 0] == pytest.approx([2, -1])
