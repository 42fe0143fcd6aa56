"""Array archives, the ledger of runs, the paired quadratic run and map projections."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.functions import project
from swathkit.operators import ledger, sensitivity
from swathkit.operators.contracts import ContractError
from swathkit.sources import arrays

# --- archives ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives_are_read_in_stretches(spark, tmp_path, save):
    held = {"a": np.arange(1000, dtype=np.int32).reshape(50, 20), "b": np.linspace(0, 1, 333), "flag": np.array([True, False]), "none": np.zeros(0), "big": np.arange(7, dtype=">f4")}
    save(tmp_path / "one.npz", **held)
    save(tmp_path / "two.npz", a=np.array([7], np.uint8))
    df = arrays.read_arrays(spark, f"file://{tmp_path}", ["a", "b", "flag", "big"], stretch=64)
    got = df.collect()
    for name in ("a", "b", "flag", "big"):
        own = sorted((r["position"], r["value"]) for r in got if r["array"] == name and r["file"].endswith("one.npz"))
        assert [v for _, v in own] == held[name].ravel().astype(float).tolist() and [p for p, _ in own] == list(range(held[name].size))
    assert [r["value"] for r in got if r["file"].endswith("two.npz")] == [7.0]
    assert df.rdd.getNumPartitions() == (16 + 6 + 1 + 1 + 1 if save is np.savez else 5)
    arrays.require_arrays(str(tmp_path / "one.npz"), {"a", "none"})
    with pytest.raises(ContractError, match="missing arrays"):
        arrays.require_arrays(str(tmp_path), {"a", "b"})
    with pytest.raises(ContractError, match="no archive"):
        arrays.require_arrays(str(tmp_path / "absent"), {"a"})


def test_objects_are_never_unpickled(spark, tmp_path):
    class Trap:
        def __reduce__(self):
            return (open, (str(tmp_path / "sprung"), "w"))

    np.savez(tmp_path / "bad.npz", good=np.arange(3), trap=np.array([Trap()], dtype=object))
    with pytest.raises(ContractError, match="never unpickled"):
        arrays.headers(str(tmp_path))
    with pytest.raises(Exception, match="never unpickled"):
        arrays.read_arrays(spark, str(tmp_path)).collect()
    assert not (tmp_path / "sprung").exists()


@pytest.mark.parametrize("deflated", [False, True])
def test_written_archives_come_back(spark, tmp_path, deflated):
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("v")).repartition(3)
    files = arrays.write_arrays(df, f"file://{tmp_path}/out", ["id", "v"], deflated).collect()
    assert sum(r["n"] for r in files) == 1000 and len(list((tmp_path / "out").iterdir())) == len(files) == 3
    got = arrays.read_arrays(spark, f"file://{tmp_path}/out").groupBy("file", "position").pivot("array", ["id", "v"]).agg(F.first("value")).collect()
    assert sorted((r["id"], r["v"]) for r in got) == [(float(i), i / 7) for i in range(1000)]
    with pytest.raises(Exception, match="without nulls"):
        arrays.write_arrays(df.withColumn("v", F.lit(None).cast("double")), f"file://{tmp_path}/bad", ["v"])


# --- ledger --------------------------------------------------------------------------------------------------------


def test_runs_go_on_where_they_stopped(spark, tmp_path):
    like = spark.createDataFrame([], "year int, v double")
    asked = []

    def make(units):
        years = sorted(r[0] for r in units.collect())
        asked.append(years)
        if 2004 in years:
            raise RuntimeError("the job died")
        return units.where("year <> 2002").select("year", F.explode(F.array(F.lit(1.5), F.lit(None).cast("double"), F.col("year") * 1.0)).alias("v"))

    units = lambda *y: spark.createDataFrame([(x,) for x in y], "year int")
    run = ledger.Ledger(like, f"file://{tmp_path}/run", "year")
    assert run.run(units(2001, 2002), make).count() == 3 and run.run(units(2001, 2002), make).count() == 3
    assert asked == [[2001, 2002]]
    with pytest.raises(Exception, match="the job died"):
        run.run(units(2001, 2003, 2004), make)
    assert run.run(units(2001, 2002, 2003), make).count() == 6 and asked[1:] == [[2003, 2004], [2003]]
    again = ledger.Ledger(like, f"file://{tmp_path}/run", "year")
    assert sorted(r["year"] for r in again.run(units(2003), make).collect()) == [2003] * 3 and len(asked) == 3
    # rows that were lost or changed are made again
    for part in (tmp_path / "run/rows").glob("attempt=*/unit=2001/*"):
        part.unlink()
    assert again.run(units(2001, 2003), make).where("year = 2001").count() == 3 and asked[-1] == [2001]


# --- the quadratic run ---------------------------------------------------------------------------------------------


def test_effects_of_known_curves(spark):
    """Without noise every draw finds the curve: the line's and the quadratic's changes are those of the functions."""
    rng = np.random.default_rng(1)
    rows = [(u, b, float(x), float(300 + b - 4 * x + (3 * x * x if u == "curved" else 0))) for u in ("straight", "curved") for b in range(12) for x in rng.random(9)]
    cells = spark.createDataFrame(rows, "u string, b long, x double, k double").withColumn("f", 2 * F.col("k"))
    cells = cells.unionByName(spark.createDataFrame([("flat", 0, 0.5, 1.0, 2.0), ("flat", 1, 0.5, 1.0, 2.0)], cells.schema))
    moments = sensitivity.block_moments(cells, "u", "b", "x", "k", "f")
    pairs = [(0.1, 0.2), (0.3, 0.7)]
    got = {(r["u"], r["size"], r["low"], r["model"], r["quantity"]): r for r in sensitivity.effects(moments, "u", [1, 4], pairs, 15, 3, (300.0, 0.97)).collect()}
    assert len(got) == 3 * 2 * 2 * 3 * 4
    for low, high in pairs:
        for size in (1, 4):
            want = {"straight": 4 * (high - low), "curved": 4 * (high - low) - 3 * (high**2 - low**2)}
            for u, cooling in want.items():
                r = got[u, size, low, "quadratic", "cooling_k"]
                assert r["point"] == pytest.approx(cooling) and r["q025"] == pytest.approx(cooling) and r["q975"] == pytest.approx(cooling) and r["se"] < 1e-9 and r["estimable"] == r["requested"] == 15
                assert got[u, size, low, "quadratic", "cooling_flux"]["point"] == pytest.approx(2 * cooling)
            assert got["straight", size, low, "linear", "cooling_k"]["point"] == pytest.approx(want["straight"])
            assert got["straight", size, low, "quadratic_minus_linear", "cooling_k"]["point"] == pytest.approx(0, abs=1e-9)
            r = got["curved", size, low, "quadratic", "departure_k"]
            equivalent = -300 * ((1 - 2 * want["curved"] / (0.97 * 5.670374419e-8 * 300**4)) ** 0.25 - 1)
            assert r["point"] == pytest.approx(want["curved"] - equivalent)
            flat = got["flat", size, low, "linear", "cooling_k"]
            assert flat["point"] is None and flat["estimable"] == 0 and flat["requested"] == 15
    support = {(r["u"], r["low"], r["halfwidth"]): r for r in sensitivity.endpoint_support(cells, "u", "b", "x", pairs, [0.01, 0.05]).collect()}
    own = [(b, x) for u, b, x, _ in rows if u == "curved"]
    for (low, high), h in ((p, h) for p in pairs for h in (0.01, 0.05)):
        r = support["curved", low, h]
        spans = sum(min(x for c, x in own if c == b) <= low and max(x for c, x in own if c == b) >= high for b in range(12))
        assert (r["spanning_blocks"], r["lower_cells"], r["upper_cells"]) == (spans, sum(abs(x - low) <= h for _, x in own), sum(abs(x - high) <= h for _, x in own))


# --- projections ---------------------------------------------------------------------------------------------------


def at(spark, columns, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values)).select(*columns).first()


def test_conics_at_published_points(spark):
    """Numerical examples of the United States survey's manual of projections: a unit sphere, and Clarke's ellipsoid of 1866."""
    sphere, clarke = project.Conic(33, 45, 23, -96, 1.0, 0.0), project.Conic(33, 45, 23, -96, 6378206.4, math.sqrt(0.00676866))
    assert tuple(at(spark, sphere.forward(F.col("lon"), F.col("lat")), lon=-75.0, lat=35.0)) == pytest.approx((0.2966785, 0.2462112), abs=5e-8)
    assert tuple(at(spark, clarke.forward(F.col("lon"), F.col("lat")), lon=-75.0, lat=35.0)) == pytest.approx((1894410.9, 1564649.5), abs=0.06)
    assert sphere.cone == pytest.approx(0.6304777, abs=5e-8) and clarke.cone == pytest.approx(0.6304965, abs=5e-8)


def test_transverse_mercator_along_the_meridian(spark):
    """On the central meridian the northing is the scaled arc of the ellipse, here by Gauss-Legendre quadrature."""
    nodes, weights = np.polynomial.legendre.leggauss(60)
    for lat in (-75.0, -12.5, 0.0, 33.3, 60.0, 84.0):
        phi = math.radians(lat)
        s = phi / 2 * (nodes + 1)
        arc = phi / 2 * float((weights * project.A * (1 - project.ECCENTRICITY**2) / (1 - (project.ECCENTRICITY * np.sin(s)) ** 2) ** 1.5).sum())
        x, y = at(spark, project.utm(F.col("lon"), F.col("lat"), F.lit(31)), lon=3.0, lat=lat)
        assert x == pytest.approx(500000, abs=1e-7) and y - (1e7 if lat < 0 else 0) == pytest.approx(0.9996 * arc, abs=1e-5)
    x, y = at(spark, project.utm(F.col("lon"), F.col("lat"), F.lit(38)), lon=44.4, lat=33.3)
    assert (x, y) == pytest.approx((444140.5, 3684706.4), abs=0.1)


def test_projections_lead_back_and_keep_angles(spark):
    rows = [(float(lon), float(lat)) for lon in np.linspace(-179.9, 179.9, 25) for lat in np.linspace(-79, 83, 19)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("zone", project.utm_zone(F.col("lon")))
    for dx, dy in ((0.0, 0.0), (1e-5, 0.0), (0.0, 1e-5)):
        df = df.withColumns(dict(zip((f"x{dx}{dy}", f"y{dx}{dy}"), project.utm(F.col("lon") + dx, F.col("lat") + dy, F.col("zone")), strict=True)))
    for r in df.collect():
        ex, ey = r["x1e-050.0"] - r["x0.00.0"], r["y1e-050.0"] - r["y0.00.0"]
        nx, ny = r["x0.01e-05"] - r["x0.00.0"], r["y0.01e-05"] - r["y0.00.0"]
        if abs(r["lat"]) > 1e-4:
            assert abs(ex * nx + ey * ny) < 1e-6 * math.hypot(ex, ey) * math.hypot(nx, ny) + 1e-7
    back = df.withColumns(dict(zip("ab", project.utm_inverse(F.col("`x0.00.0`"), F.col("`y0.00.0`"), F.col("zone"), F.col("lat") < 0), strict=True)))
    assert all(abs(r["a"] - r["lon"]) < 1e-9 and abs(r["b"] - r["lat"]) < 1e-9 for r in back.select("a", "b", "lon", "lat").collect())
    for conic in (project.Conic(38.5, 38.5, 38.5, -97.5, 6371229.0, 0.0), project.Conic(33, 45, 23, -96), project.Conic(-20, -60, -32, -60)):
        near = df.where("lat > 5" if conic.cone > 0 else "lat < -5").select("lon", "lat")
        there = near.withColumns(dict(zip("xy", conic.forward(F.col("lon"), F.col("lat")), strict=True)))
        for r in there.withColumns(dict(zip("ab", conic.inverse(F.col("x"), F.col("y")), strict=True))).collect():
            assert (r["a"] - r["lon"] + 180) % 360 - 180 == pytest.approx(0, abs=1e-9) and r["b"] == pytest.approx(r["lat"], abs=1e-9)
