"""Each audit on a table that is right and on tables that are wrong in one way each."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.operators import inference, joins, reconcile
from swathkit.operators.contracts import ContractError
from swathkit.plans import q_audits
from swathkit.sources import files

RELEASED = "k string, gradient double, cooling double, se double, low double, high double, n_cells long, n_blocks long"
PRECISION = "k string, se double, width double, requested long, estimable long, failed long, n_cells long, n_blocks long"
GOOD = {"gradient": -0.3, "cooling": 0.3, "se": 0.05, "low": 0.2, "high": 0.4, "n_cells": 100, "n_blocks": 9}
OTHER = {"se": 0.05, "width": 0.2, "requested": 60, "estimable": 58, "failed": 2, "n_cells": 100, "n_blocks": 9}


@pytest.mark.parametrize(
    ("released", "precision", "failed"),
    [
        ({}, {}, ""), ({"cooling": -0.3}, {}, "sign"), ({"gradient": None, "cooling": None}, {}, "sign"), ({"low": 0.4, "high": 0.2}, {}, "interval/width"), ({"se": 0.051}, {}, "se"), ({}, {"width": 0.21}, "width"),
        ({}, {"failed": 3}, "draws"), ({}, {"requested": 1, "estimable": 1, "failed": 0}, "draws"), ({}, {"n_cells": 99}, "population"), ({"n_blocks": None}, {}, "population"), ({"se": -0.05}, {"se": -0.05}, "interval"),
    ],
)
def test_estimates_fail_by_name(spark, released, precision, failed):
    a = spark.createDataFrame([("x", *(GOOD | released).values())], RELEASED)
    b = spark.createDataFrame([("x", *(OTHER | precision).values())], PRECISION)
    assert [r["failed"] for r in reconcile.estimates(a, b, ["k"]).collect()] == [failed]
    assert {r["failed"] for r in reconcile.estimates(a, b.withColumn("k", F.lit("y")), ["k"]).collect()} == {"missing"}


def test_compared_names_every_kind(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 1.0), (None, 2.0), (7, None)], "k long, v double")
    b = spark.createDataFrame([(1, 5.0 + 1e-12), (2, 5.1), (3, None), (5, 1.0), (None, 2.0), (7, 0.0)], "k long, v double")
    got = {r["k"]: r["status"] for r in reconcile.compared(a, b, ["k"], "v").collect()}
    assert got == {1: "ok", 2: "differs", 3: "ok", 4: "missing", 5: "extra", None: "ok", 7: "differs"}
    assert reconcile.compared(a.limit(0), b.limit(0), ["k"], "v").collect() == []


def test_scope_lists_missing_and_extra(spark):
    a, b = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2)], "p string, s int"), spark.createDataFrame([("x", 2), ("y", 1)], "p string, s int")
    assert {(r["p"], r["s"], r["status"]) for r in reconcile.scope(a, b, ["p", "s"]).collect()} == {("x", 1, "missing"), ("x", 2, "ok"), ("y", 1, "extra")}


def test_weather_between_hours_can_disagree(spark):
    hours = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS hour, id * id * 1.0D AS v FROM range(5)").where("v <> 9")
    at = spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 13, 7.25) AS ts FROM range(12)").unionByName(spark.sql("SELECT 99L AS id, timestamp'2024-01-01 02:00:00' AS ts"))
    right = joins.bracket(at, hours, "ts", "hour", ["v"])
    again = q_audits.weighed_hours(at, hours, ["id"], "ts", "hour", "v")
    status = {r["id"]: r for r in reconcile.compared(right, again, ["id"], "v").collect()}
    assert {r["status"] for r in status.values()} == {"ok"} and status[99]["recorded"] == 4.0 and status[10]["recorded"] is None
    stepped = at.select("id", F.date_trunc("hour", "ts").alias("hour")).join(hours, "hour", "left")  # the hour's own value in place of the interpolated one
    assert {r["status"] for r in reconcile.compared(stepped, again, ["id"], "v").collect()} == {"ok", "differs"}


def test_broken_chains_and_counts(spark):
    schema = "listing string, page long, items array<long>, after long, hits long"
    whole = [("a", 0, [1, 2], None, 6), ("a", 1, [3, 4], 2, 6), ("a", 2, [5, 6], 4, 6)]
    cases = {
        "whole": (whole, [True, True, True], True), "lost": ([whole[0], whole[2]], [True, False], False), "wrong token": ([whole[0], ("a", 1, [3, 4], 1, 6), whole[2]], [True, False, True], True),
        "no start": (whole[1:], [False, True], False), "count": ([*whole[:2], ("a", 2, [5], 4, 6)], [True, True, True], False), "other count": ([*whole[:2], ("a", 2, [5, 6], 4, 7)], [True, True, True], False),
    }
    for name, (pages, chained, complete) in cases.items():
        got = reconcile.chained_pages(spark.createDataFrame(pages, schema), ["listing"]).orderBy("page").collect()
        assert ([r["chained"] for r in got], {r["complete"] for r in got}) == (chained, {complete}), name


def test_checked_csv_refuses(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k long, v double")
    with pytest.raises(ContractError, match="repeated"):
        files.write_csv(df, f"file://{tmp_path}/a", ["k", "v"], ["k"])
    with pytest.raises(ContractError, match="expected 3"):
        files.write_csv(df, f"file://{tmp_path}/b", ["k", "v"], ["k", "v"], n_rows=3)


def test_block_pass_diagnostics_by_matrices(spark):
    rng = np.random.default_rng(3)
    rows = [(b, int(i % 4), int(gx), int(gy), float(x), float(z), float(2 * x - z + e)) for b in range(3) for i, (gx, gy, x, z, e) in enumerate(zip(*rng.integers(0, 7, (2, 60)), *rng.random((2, 60)), rng.normal(size=60), strict=True))]
    rows += [(8, 0, i, 0, 0.5, 0.1, 1.0) for i in range(30)] + [(9, 0, 0, 0, 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "k long, q int, gx long, gy long, x double, z double, y double")
    got = {r["k"]: r for r in inference.block_pass_fits(df, ["k"], "x", "y", ["z"], "q", ("gx", "gy")).collect()}
    assert got[8]["reason"] == "narrow_span" and got[9]["reason"] == "few_cells" and got[9]["slope"] is None
    for b in range(3):
        own = [r for r in rows if r[0] == b]
        d, y = np.array([[1, r[4], r[5]] for r in own]), np.array([r[6] for r in own])
        hat = d @ np.linalg.inv(d.T @ d) @ d.T
        e = y - hat @ y
        pairs = [(i, j) for i in range(len(own)) for j in range(len(own)) if (own[j][2] - own[i][2], own[j][3] - own[i][3]) in ((1, 0), (0, 1))]
        moran = len(e) * sum(e[i] * e[j] for i, j in pairs) / (len(pairs) * e @ e)
        assert got[b]["leverage"] == pytest.approx(np.diag(hat).max()) and got[b]["moran"] == pytest.approx(moran) and got[b]["n_pairs"] == len(pairs)
        slopes = [np.linalg.lstsq(d[[r[1] != q for r in own]], y[[r[1] != q for r in own]], rcond=None)[0][1] for q in range(4)]
        assert got[b]["jackknife_se"] == pytest.approx(np.sqrt(3 / 4 * ((slopes - np.mean(slopes)) ** 2).sum()))
