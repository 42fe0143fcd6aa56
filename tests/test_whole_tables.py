"""Queries over whole tables, where a row limit would lose rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.operators import inference
from swathkit.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("t1_utc_strict_and_lenient", "events"), ("t11_hours_of_window", "events"), ("f3_f5_f7_id_text", "orders")])
def test_every_row_is_there(spark, tmp_path, name, table):
    rows = spark.read.parquet(f"{DATA}/{table}.parquet")
    key = "event_id" if table == "events" else "o_orderkey"
    rows.withColumn(key, rows[key] + 5_000_000_000_000).union(rows).write.parquet(f"{tmp_path}/{table}.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    assert got.count() == 2 * rows.count()
    if table == "orders":
        assert got.where("plain like '5000%'").count() >= rows.count()


def test_moment_interval_over_all_days(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet").where("event_type = 'purchase'")
    y = np.array([r.y for r in e.groupBy(F.to_date("ts").alias("d")).agg(F.avg("value").alias("y")).orderBy("d").collect()])
    n, a = len(y), len(y) // 2
    w = np.r_[np.full(a, 1 / a), np.full(n - a, -1 / (n - a))]
    want = inference.moment_interval(y, w, np.eye(n) * 0.5, np.column_stack([np.ones(n), np.arange(n)]))
    got = catalogue.QUERIES["x31_moment_interval"](spark, DATA).first()
    assert n > 24 and np.allclose(got, want)


def test_concurvity_of_all_groups(spark, tmp_path):
    t = spark.read.parquet(f"{DATA}/lineitem.parquet")
    t.union(t.withColumn("l_suppkey", F.col("l_suppkey") + 800)).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["x28_concurvity"](spark, str(tmp_path))
    assert got.where("grp >= 100").count() == got.where("grp < 100").count() > 0


def test_window_edges_of_all_cells(spark, tmp_path):
    t = spark.read.parquet(f"{DATA}/lineitem.parquet")
    t.withColumn("l_partkey", F.col("l_partkey") * 4 + 1).write.parquet(f"{tmp_path}/lineitem.parquet")
    run = catalogue.QUERIES["r32_pass_window_edges"]
    assert run(spark, str(tmp_path)).collect() == run(spark, DATA).collect() != []
