"""A small test for each finding of the reviews: each fails on the code before."""

from __future__ import annotations

import hashlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swathkit.llm import common, substring_dedup
from swathkit.operators import aggregates, grid, hulls, inference, polygons, resampling, select
from swathkit.plans import q_audits, q_sources
from swathkit.plans.q_grid import supplier_polygons
from swathkit.plans.registry import Tables
from swathkit.sources import files
from tests.test_spatial import even_odd, random_polygon, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_not_broadcast(spark):
    """the draws are made by explode, which size estimates do not see."""
    rows = spark.createDataFrame([(s, i, float(i)) for s in "ab" for i in range(5)], "s string, g long, v double")
    got = resampling.resampled_rows(rows, ["s"], "g", 4, 7)
    assert "BroadcastHashJoin" not in plan(got) and got.agg(F.sum("times")).first()[0] == 4 * 10
    assert "SortMergeJoin" in plan(resampling.resampled_sums(rows.where("s = 'a'"), "g", ["v"], 4, 7))


def test_sums_in_polygons_against_brute_force(spark, monkeypatch):
    """no row of a point and a polygon is made, whatever the tiles, shared lines and crowded places."""
    monkeypatch.setattr(polygons, "PAIRS", 50)
    rng = np.random.default_rng(5)
    shapes = [random_polygon(rng) for _ in range(12)]
    points = [(float(a), float(b)) for a, b in rng.uniform(-30, 30, (150, 2))] + [(float(a), float(b)) for a, b in rng.integers(-20, 20, (250, 2))] + [(1.0, 2.0)] * 20 + [(None, 1.0)]
    df = spark.createDataFrame(points, "x double, y double")
    for size, hot in ((3.0, 7), (50.0, 1000)):
        got = {r["polygon"]: (r["n"], r["total"]) for r in polygons.sums_in_polygons(df, "x", "y", "x", table(spark, shapes), "id", "rings", size, hot).collect()}
        for k, rings in enumerate(shapes):
            own = [x for x, y in points[:-1] if even_odd(rings, x, y)]
            n, total = got.get(k, (0, 0.0))
            assert n == len(own) and total == pytest.approx(sum(own), abs=1e-9)


def test_slivers_are_no_blocks(spark):
    """an area below FLAT is rounding."""
    shape = [[[[0, 0], [3 + 1e-10, 0], [3 + 1e-10, 2], [0, 2]]]]
    got = polygons.block_areas(table(spark, shape), "id", "rings", 3.0).collect()
    assert [(r["bx"], r["by"]) for r in got] == [(0, 0)] and got[0]["area"] == pytest.approx(6.0)


def test_corners_are_those_of_decimals(spark, tmp_path):
    """corners are whole hundredths and differences of them are exact, as in the SQL."""
    spark.createDataFrame([(k, 20.0 * k) for k in range(1, 200)], "s_suppkey long, s_acctbal double").write.parquet(f"file://{tmp_path}/supplier.parquet")
    shapes = supplier_polygons(Tables(spark, f"file://{tmp_path}"))
    got = polygons.edges(shapes, "polygon", "rings").select("x0", "x1", "dx").collect()
    for r in got:
        x0, x1 = (Decimal(str(round(r[c], 2))) for c in ("x0", "x1"))
        assert (r["x0"], r["x1"], r["dx"]) == (float(x0), float(x1), float(x1 - x0))


def test_area_average_on_a_declared_grid(spark):
    """target cells outside the declared grid are not made."""
    fine = spark.createDataFrame([(2.0 * i, 2.0 * j, 1.0) for i in range(9) for j in range(9)], "x double, y double, v double")
    got = {(r["gx"], r["gy"]) for r in grid.area_average(fine, [], "x", "y", "v", 2.0, 3.0, (4, 2)).collect()}
    assert got == {(i, j) for i in range(4) for j in range(2)}


def test_means_at_a_limit(spark):
    """a mean that equals the limit is neither above nor below, in whatever order doubles are added."""
    rows = [(k, v) for k, order in enumerate(([0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [0.2, 0.2, 0.2 + 1e-9], [0.1, None, 0.2])) for v in order] + [(4, None), (5, float("nan"))]
    df = spark.createDataFrame(rows, "k long, v double").coalesce(1)
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(aggregates.compared_mean("v", "0.2").alias("s")).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0, 3: -1.0, 4: None, 5: 1.0}


def test_documents_stay_small(spark, tmp_path, monkeypatch):
    """a document has at most 1,000 features, however many there are."""
    spark.range(1, 5001).selectExpr("id as s_suppkey", "cast(id % 25 as int) as s_nationkey").write.parquet(f"file://{tmp_path}/supplier.parquet")
    held, write = [], files.write_geojson
    monkeypatch.setattr(files, "write_geojson", lambda df, path, feature, part: (held.extend(r["count"] for r in df.groupBy(part).count().collect()), write(df, path, feature, part)))
    got = q_sources.s7(Tables(spark, f"file://{tmp_path}")).collect()
    assert sum(held) == 5000 and max(held) <= 1000
    assert sorted(r["s_suppkey"] for r in got) == [k for k in range(1, 5001) if 3 <= k % 25 + k % 10 / 10 <= 12 and 4 <= k % 50 + 0.5 <= 30]


def test_a_large_folder_has_several_files(spark, tmp_path):
    """one folder value is not one task."""
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        files.write_cells(spark.range(0, 200_000, 1, 8).selectExpr("xxhash64(id) as v", "'a' as k"), f"file://{tmp_path}/t", ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "t" / "k=a").glob("*.parquet"))) > 1 and spark.read.parquet(f"file://{tmp_path}/t").count() == 200_000


def test_large_samples_leave_most_rows_before_they_are_ranked(spark):
    """of a key with more rows than are drawn, few are ranked, and they are those of the plain way."""
    df = spark.range(9000).selectExpr("if(id < 6000, 1, if(id < 8000, 2, null)) as k", "cast(id as string) as i").unionByName(spark.createDataFrame([(1, None)], "k int, i string"))
    got = {(r["k"], r["i"]) for r in select.hash_sample(df, ["k"], F.col("i"), 1500).collect()}
    rows = df.collect()
    digest = lambda r: hashlib.sha256(r["i"].encode()).hexdigest() if r["i"] else ""
    want = {(r["k"], r["i"]) for k in (1, 2, None) for r in sorted((r for r in rows if r["k"] == k), key=digest)[:1500]}
    assert got == want and "__cut" in plan(select.hash_sample(df, ["k"], F.col("i"), 1500))


def test_populated_groups(spark):
    """groups of every size from one row a pass and largest group; negative and null blocks too."""
    rng = np.random.default_rng(2)
    rows = [(f"p{p}", int(b)) for p in range(3) for b in rng.integers(-20, 40, 200)] + [("p0", None)] * 4
    got = {(r["pass"], r["size"]): r["k"] for r in q_audits.populated(spark.createDataFrame(rows, "pass string, block long"), [1, 2, 4, 8], 4).collect()}
    for p in ("p0", "p1", "p2"):
        for size in (1, 2, 4, 8):
            n = Counter(None if b is None else b // size for q, b in rows if q == p)
            assert got[p, size] == sum(v >= 4 for v in n.values())


def test_fits_are_made_for_many_groups_at_once(spark):
    """F8: no call for each group; groups may go on over frames, be large or have a null key."""
    frames = [pd.DataFrame({"k": ks, "v": range(len(ks))}) for ks in ([1.0, 1, 2, 2], [2.0], [2.0, 2, 2, 3], [3.0, None], [None])]
    got = [f["k"].iloc[a:b].tolist() for f, first in inference.whole_groups(iter(frames), ["k"], 3) for a, b in zip(first, [*first[1:], len(f)], strict=True)]
    assert [len(g) for g in got] == [2, 6, 2, 2] and [g[0] for g in got[:3]] == [1, 2, 3]
    rng = np.random.default_rng(8)
    rows = [(k, int(q), int(gx), int(gy), float(x), float(2 * x + e)) for k in range(6) for q, gx, gy, x, e in zip(*rng.integers(0, 3, (3, 40)), rng.random(40), rng.normal(size=40), strict=True)]
    rows += [(7, 0, 0, i, i / 30, 1.0) for i in range(30)] + [(6, i % 2, i, 0, float(i % 2), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, q int, gx long, gy long, x double, y double").withColumn("z", F.when(F.col("k") == 7, F.col("x")).otherwise(F.col("gx")))
    fits = inference.block_pass_fits(df, ["k"], "x", "y", ["z"], "q", ("gx", "gy"))
    assert "FlatMapGroups" not in plan(fits)
    got = {r["k"]: r for r in fits.collect()}
    assert got[7]["reason"] == "rank" and got[7]["slope"] is None and got[7]["n_pairs"] == 0
    assert got[6]["reason"] is None and got[6]["slope"] == pytest.approx(0, abs=1e-9) and got[6]["jackknife_se"] is None  # either half has one x
    for k in range(6):
        own = np.array([(r[1], r[4], r[2], r[5]) for r in rows if r[0] == k])
        fit = lambda a: np.linalg.lstsq(np.c_[np.ones(len(a)), a[:, 1:3]], a[:, 3], rcond=None)[0][1]
        slopes = np.array([fit(own[own[:, 0] != q]) for q in range(3)])
        assert got[k]["slope"] == pytest.approx(fit(own)) and got[k]["jackknife_se"] == pytest.approx(np.sqrt(2 * slopes.var()))


def test_hulls_of_many_groups_at_once(spark):
    """the hulls of small groups grow together and equal those made one by one; so does whether they meet."""
    rng = np.random.default_rng(13)
    rows = [(k, bool(a), float(x), float(y)) for k in range(120) for a, x, y in zip(rng.integers(0, 2, k % 13), *rng.integers(0, 3 + k % 6, (2, k % 13)), strict=True)]
    rows += [(500, i % 2 == 0, float(i % 50), float(i // 50)) for i in range(500)] + [(501, None, 1.0, 1.0), (501, True, 2.0, 1.0), (502, True, None, 1.0)]
    df = spark.createDataFrame(rows, "k long, arm boolean, x double, y double").repartition(5)
    got = {r["k"]: [tuple(p) for p in r["corners"]] for r in hulls.hulls(df, ["k"], "x", "y").collect()}
    assert got == {k: hulls.hull([r[2:] for r in rows if r[0] == k]) for k in {r[0] for r in rows if r[2] is not None}}
    met = hulls.overlaps(df, ["k"], "arm", "x", "y")
    assert "HashAggregate" not in plan(met)  # corners are rows, not lists that are gathered
    for r in met.collect():
        a, b = (hulls.hull([p[2:] for p in rows if p[0] == r["k"] and bool(p[1]) is arm]) for arm in (True, False))
        assert (r["corners_a"], r["corners_b"]) == (len(a), len(b))
        axes = [(-(q[1] - p[1]), q[0] - p[0]) for h in (a, b) for p in h for q in h] + [(q[0] - p[0], q[1] - p[1]) for h in (a, b, a + b) for p in h for q in h]
        on = lambda h, v: [v[0] * p[0] + v[1] * p[1] for p in h]
        parted = any(max(on(a, v)) < min(on(b, v)) or max(on(b, v)) < min(on(a, v)) for v in axes) if a and b else True
        assert r["meets"] is not parted, r


def test_hot_passages_are_sent_as_finer_runs():
    """op6: windows of hot names are not sent one by one; equal windows of any blocks have the same shard."""
    rng = np.random.default_rng(6)
    words = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage = words(700)
    shards = []
    for size in (300, 90):
        texts = [words(size) + passage + words(size), passage[40:500], words(60) + passage[100:] + "x", "short"]
        payload = common.to_stream(pa.table({"doc_id": pa.array(range(4), pa.int64()), "text": texts}))
        block = substring_dedup.Block([payload], substring_dedup.LENGTH, 128)
        block.candidates(np.full(len(block.prints), 2, np.uint8))
        assert (block.unit_n + 49).sum() < 20 * block.unit_n.sum()  # 50 bytes a window before
        bits = np.cumsum(block.unit_n) - block.unit_n
        own = {}
        for run, k in zip(block.run_of, block.kept, strict=True):
            for w in range(block.n[k]):
                bit = block.window_bit[block.run_at[run] + w]
                unit = np.searchsorted(bits, bit, "right") - 1
                at = block.unit_begin[unit] + bit - bits[unit]
                window = block.data[block.begin[k] + w :][:50]
                assert block.data[at : at + 50] == window
                assert block.window_least[block.run_at[run] + w] == block.unit_least[unit]
                own.setdefault(window, set()).add(int(block.unit_shard[unit]))
        assert all(len(x) == 1 for x in own.values())
        shards.append(own)
    both = shards[0].keys() & shards[1].keys()
    assert len(both) == 652 and all(shards[0][w] == shards[1][w] for w in both)
    assert len(set().union(*(shards[0][w] for w in both))) > 20  # a hot passage spreads
