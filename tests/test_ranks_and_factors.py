"""Global ranks against pandas, and QR factors of rows against the fit by products."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swathkit.operators import ranks, tsqr, within
from swathkit.operators.contracts import ContractError


@pytest.fixture(scope="module")
def odd(spark):
    """One key holds most rows, one a single row, one only nulls; many ties."""
    rng = np.random.default_rng(2)
    rows = [("hot", float(v), float(w)) for v, w in zip(rng.integers(0, 40, 900) / 4, rng.normal(size=900), strict=True)]
    rows += [(None, float(v), float(-v)) for v in range(5)] + [("one", 3.5, 1.0), ("two", 1.0, None), ("two", 4.0, 2.0), ("null", None, 1.0), ("null", None, None)]
    return spark.createDataFrame(rows, "k string, v double, w double").repartition(7)


def pandas_of(df):
    return df.toPandas()


@pytest.mark.parametrize("ranges", ["1", "3", "17"])
def test_places_quantiles_and_shares(spark, odd, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        whole = odd.toPandas()
        places = ranks.order_table(odd, ["k"], ["v"]).places().toPandas()
        shares = [0, 0.1, 1 / 3, 0.5, 0.95, 1]
        q = ranks.quantiles(odd, ["k"], "v", shares).toPandas()
        steps = ranks.ecdf(odd, ["k"], "v").toPandas()
        corr = ranks.rank_correlation(odd, ["k"], "v", "w").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(steps) == len(whole) and steps["ecdf"].isna().sum() == whole["v"].isna().sum()
    for key, own in whole.groupby("k", dropna=False):
        mine = lambda f, key=key: f[f["k"].isna()] if pd.isna(key) else f[f["k"] == key]
        v = own["v"].dropna().to_numpy()
        got = mine(places).sort_values("v")
        assert got["n"].sum() == len(v) and (got["total"] == len(v)).all()
        assert [int((v < x).sum()) for x in got["v"]] == got["before"].tolist()
        got = mine(q).sort_values("share")["q"].tolist()
        assert got == pytest.approx(np.quantile(v, shares).tolist() if len(v) else [])
        got = mine(steps).dropna(subset=["v"])
        assert got["ecdf"].tolist() == pytest.approx([(v <= x).mean() for x in got["v"]])
        both = own.dropna()
        got = mine(corr)
        if len(both):
            assert got["n"].item() == len(both)
        if len(both) >= 3:
            assert got["spearman"].item() == pytest.approx(both["v"].rank().corr(both["w"].rank())) and got["pearson"].item() == pytest.approx(both["v"].corr(both["w"]))
        elif len(both):
            assert pd.isna(got["spearman"].item())


def test_total_order_and_empty_tables(spark):
    df = spark.range(500).select((F.col("id") * 7 % 13).alias("a"), F.col("id").alias("b")).repartition(5)
    got = ranks.placed(df, ["-a", "b"]).orderBy("place").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(((i * 7 % 13, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
    assert [r["place"] for r in got] == list(range(500))
    none = df.limit(0).withColumn("k", F.lit("x"))
    assert ranks.placed(none, ["a", "b"]).count() == 0 and ranks.quantiles(none, ["k"], "a", [0.5]).count() == 0 and ranks.quantiles(none, [], "a", [0.5]).count() == 0


def test_no_window_by_the_key_alone(odd):
    """A hot key is never one window or one buffer: rows meet by key and range only."""
    plan = ranks.order_table(odd, ["k"], ["v"]).places()._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "windowspec" in line.lower()]
    assert windows and all("range" in line for line in windows)


def design(spark, n=400, near=1e-9):
    rng = np.random.default_rng(8)
    x, z, u = rng.random(n), rng.random(n), rng.random(n)
    y = 2 * x - z + rng.normal(size=n)
    rows = [(int(i // 10), float(a), float(b), float(b + near * c), float(2 * b), float(d)) for i, (a, b, c, d) in enumerate(zip(x, z, u, y, strict=True))]
    return spark.createDataFrame(rows, "block long, x double, z double, near double, twice double, y double")


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_factor_does_not_depend_on_the_partitions(spark, parts):
    df = design(spark).repartition(parts)
    columns = ["x", "z", "near", "y"]
    r = tsqr.r_factor(df, columns)
    rows = np.array(df.select(*columns).collect())
    assert np.allclose(r.T @ r, rows.T @ rows, rtol=1e-12) and (np.diag(r) >= 0).all() and np.allclose(r, np.triu(r))
    want = np.linalg.qr(rows, mode="r")
    assert np.allclose(np.abs(r), np.abs(want), rtol=1e-5, atol=1e-12)


def test_ranks_of_a_nearly_collinear_design(spark):
    """A condition number of 10^9 is full rank on the rows; on the products it cannot be told from a copy."""
    fitted, m = within.fit_frame(design(spark), "block", "block", ["x", "z", "near", "twice"], ["y"])
    assert fitted.diagnostics["rank"] == 3 and fitted.diagnostics["removed"][0] in ("z", "twice") and "near" in fitted.names
    xx = m.total[0][np.ix_([0, 1, 2], [0, 1, 2])]
    scale = np.sqrt(np.diag(xx))
    assert np.linalg.eigvalsh(xx / np.outer(scale, scale))[0] < 1e-15
    fitted, _ = within.fit_frame(design(spark, near=1e-13), "block", "block", ["x", "z", "near"], ["y"])
    assert fitted.diagnostics["rank"] == 2


def test_protected_predictor_is_refused_not_rescued(spark):
    df = design(spark).withColumn("copy", F.col("x") * 3 + 1)
    with pytest.raises(ContractError, match="identifiable"):
        within.fit_frame(df, "block", "block", ["x", "copy"], ["y"])
    with pytest.raises(ContractError, match="no within-group variation"):
        within.fit_frame(df.withColumn("x", F.col("block").cast("double")), "block", "block", ["x", "z"], ["y"])


def test_both_algorithms_agree_with_weights_and_clusters(spark):
    df = design(spark).withColumns({"w": F.col("z") + 0.5, "grp": F.floor(F.col("block") / 4), "y2": F.col("y") * F.col("x")})
    a, _ = within.fit_frame(df, "block", "grp", ["x", "z"], ["y", "y2"], "w")
    b = within.fit_by_qr(df, "block", "grp", ["x", "z"], ["y", "y2"], "w")
    assert np.allclose(a.coef, b.coef, rtol=1e-10) and np.allclose(a.cluster_se, b.cluster_se, rtol=1e-10)
    assert a.diagnostics["dof"] == b.diagnostics["dof"] and a.diagnostics["groups"] == b.diagnostics["groups"]
