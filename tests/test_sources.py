"""Readers, writers, digests and the streaming windows."""

from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from swathkit.operators.contracts import ContractError
from swathkit.sources import files
from swathkit.streaming import windows


def test_csv_round_trip_and_allow_list(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.12345678), (2, None)], "id int, v double")
    out = str(tmp_path / "out")
    files.write_csv(df, out, ["id", "v"], ["id"], 2)
    assert sorted(files.read_csv(spark, out, "id int, v double").collect())[0]["v"] == 0.123457
    with pytest.raises(ContractError):
        files.read_csv(spark, out, "id int, v double", ["v"], {"id"})
    with pytest.raises(ContractError):
        files.write_csv(df.union(df), out + "2", ["id", "v"], ["id"])


def test_frozen_reader_and_digest(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).coalesce(1).write.parquet(path)
    part = next((tmp_path / "t").glob("*.parquet"))
    found = {r["name"]: r["sha256"] for r in files.digests(spark, path).collect()}
    assert found[part.name] == hashlib.sha256(part.read_bytes()).hexdigest()
    reader = files.FrozenReader(spark, {path: files.tree_digest(spark, path)})
    assert reader.parquet(path).count() == 3
    spark.range(4).write.mode("append").parquet(path)
    with pytest.raises(ContractError):
        reader.parquet(path)


def test_geojson_and_names_and_resume(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"a":1},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    row = files.read_geojson(spark, str(tmp_path / "g.json")).first()
    assert (row["kind"], row["coordinates"]) == ("Point", "[1,2]")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "scene_17_v2.bin").write_bytes(b"abc")
    assert files.listed_files(spark, str(tmp_path / "x"), r"scene_(\d+)_v(\d+)", {"scene": "int", "v": "int"}).first()["scene"] == 17
    calls = []
    make = lambda: calls.append(1) or spark.range(2)
    for _ in range(2):
        assert files.resume_or_make(spark, str(tmp_path / "done"), make).count() == 2
    assert len(calls) == 1
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "done"))  # not what was finished there
    assert files.resume_or_make(spark, str(tmp_path / "done"), make).count() == 2 and len(calls) == 2


def test_config(spark, tmp_path):
    (tmp_path / "c.toml").write_text("a = 1\n")
    assert files.read_config(spark, str(tmp_path / "c.toml"), {"a"}) == {"a": 1}
    with pytest.raises(ContractError):
        files.read_config(spark, str(tmp_path / "c.toml"), {"b"})


def test_filter_reaches_the_scan(spark):
    df = files.read_columns(spark, "/root/testdata/sf0.001/orders.parquet", ["o_orderkey"], "o_totalprice > 100")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan and "o_orderstatus" not in plan


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = windows.hourly_means(stream, "ts", "value", ["event_type"], "40 days").writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((str(r["hour"]), r["event_type"], round(r["mean"], 6), r["n"]) for r in df.collect())
    assert rows(spark.table("hourly")) == rows(windows.hourly_means(events, "ts", "value", ["event_type"]))


def test_json_has_no_nan(spark, tmp_path):
    with pytest.raises(ContractError):
        files.write_json(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"), str(tmp_path / "x"))
    files.write_json(spark.createDataFrame([(1.0,), (None,)], "v double"), str(tmp_path / "y"))


def test_frozen_protocol_and_domain(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("decision_id: d7\nlimit: 3\n")
    assert files.read_protocol(spark, str(tmp_path / "p.yaml"), "d7")["limit"] == 3
    with pytest.raises(ContractError):
        files.read_protocol(spark, str(tmp_path / "p.yaml"), "d8")
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":1},"geometry":{"type":"Point","coordinates":[1.0,2.0]}}]}'
    (tmp_path / "d.json").write_text(doc)
    row = files.read_geojson(spark, str(tmp_path / "d.json")).select(F.to_json(F.struct("properties", "kind", "coordinates")).alias("j")).first()["j"]
    assert files.read_domain(spark, str(tmp_path / "d.json"), hashlib.sha256(row.encode()).hexdigest()).count() == 1
    with pytest.raises(ContractError):
        files.read_domain(spark, str(tmp_path / "d.json"), "0" * 64)


def test_missing_pages_are_noticed(spark, tmp_path):
    files.write_json(spark.createDataFrame([(0, [1, 2], 3)], "page long, items array<long>, hits long"), str(tmp_path / "pages"))
    assert not files.replayed_pages(spark, str(tmp_path / "pages"), "page bigint, items array<bigint>, hits bigint").first()["complete"]


def test_streamed_totals_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", float(h)) for h in range(12) for m in (5, 40) if h != 6]
    events = spark.createDataFrame(rows, "s string, v double").select(F.col("s").cast("timestamp").alias("ts"), "v").orderBy("ts")
    late = spark.createDataFrame([("2024-01-03 00:00:00", 0.0)], "s string, v double").select(F.col("s").cast("timestamp").alias("ts"), "v")
    for k, part in enumerate((events, late, late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02 * (k < 2))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = windows.complete_totals(stream, "ts", "v", 3, "1 hour").writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {r["start"]: r["total"] for r in windows.complete_totals(events, "ts", "v", 3).collect()}
    got = {r["start"]: r["total"] for r in spark.table("totals").collect()}
    assert got and all(want[k] == v for k, v in got.items() if k in want) and any(v is not None for v in got.values())


def test_incomplete_windows_are_null(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 01:10:00", 2.0), ("2024-01-01 03:10:00", 4.0)], "s string, v double").select(F.col("s").cast("timestamp").alias("ts"), "v")
    got = {str(r["start"])[11:13]: r["total"] for r in windows.complete_totals(df, "ts", "v", 2).collect()}
    assert got["00"] == 3.0 and got["01"] is None and got["02"] is None
