"""Sources and sinks through written and re-read tables (S), and map coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.functions import bits, project
from swathkit.operators import grid
from swathkit.plans.q_joins import GRID_SQL, lattice
from swathkit.plans.registry import Tables, query, rounded
from swathkit.sources import arrays, files


@query("s1_s2_s3_s31_s32_csv_round_trip", "SELECT p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice FROM part")
def s1(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "csv")
    files.write_csv(t.part.select("p_partkey", "p_size", "p_retailprice"), path, ["p_partkey", "p_size", "p_retailprice"], ["p_partkey"])
    return files.read_csv(t.spark, path, "p_partkey bigint, p_size int, p_retailprice double", ["p_partkey", "p_size", "p_retailprice"], {"p_partkey", "p_size", "p_retailprice"})


@query("s4_gzip_csv_filtered", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 5 GROUP BY 1")
def s4(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "csv-gz")
    t.customer.select("c_custkey", "c_nationkey").write.option("header", True).option("compression", "gzip").csv(path)
    rows = files.read_csv(t.spark, path, "c_custkey bigint, c_nationkey int")
    return rows.where("c_nationkey < 5").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("s5_s6_projection_and_box", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount BETWEEN 0.02 AND 0.03")
def s5(t: Tables) -> DataFrame:
    box = files.read_in_box(t.spark, f"{t.folder}/lineitem.parquet", (10.0, 0.02, 12.0, 0.03), ("l_quantity", "l_discount", "l_quantity", "l_discount"))
    return box.select("l_orderkey", "l_quantity")


@query("s7_s8_s24_s25_s36_json_replay", "SELECT n_nationkey, n_name FROM nation")
def s8(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "json")
    files.write_json(t.nation.select("n_nationkey", "n_name"), path)
    return t.spark.read.schema("n_nationkey int, n_name string").json(path)


@query("s7_geojson_in_box", "SELECT s_suppkey, s_nationkey + s_suppkey % 10 / 10.0 AS x, s_suppkey % 50 + 0.5 AS y FROM supplier WHERE s_nationkey + s_suppkey % 10 / 10.0 BETWEEN 3 AND 12 AND s_suppkey % 50 + 0.5 BETWEEN 4 AND 30")
def s7(t: Tables) -> DataFrame:
    """A feature collection of points, read back inside a box."""
    x, y = F.col("s_nationkey") + F.col("s_suppkey") % 10 / 10.0, F.col("s_suppkey") % 50 + 0.5
    feature = F.concat(F.lit('{"type":"Feature","properties":{"id":'), F.col("s_suppkey").cast("string"), F.lit('},"geometry":{"type":"Point","coordinates":['), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]}}"))
    path = files.scratch_path(t.spark, "geojson")
    files.write_geojson(t.supplier.select(feature.alias("value"), F.floor(F.col("s_suppkey") / 1000).alias("part")), path, "value", "part")
    points = files.read_geojson_points(t.spark, path, (3.0, 4.0, 12.0, 30.0))
    return points.select(F.get_json_object("properties", "$.id").cast("bigint").alias("s_suppkey"), "x", "y")


@query(
    "s24_page_replay",
    "SELECT CAST(floor((c_custkey - 1) / 100.0) AS BIGINT) AS page, count(*) AS n, (SELECT count(*) FROM customer) AS hits, true AS complete FROM customer GROUP BY 1",
)
def s24(t: Tables) -> DataFrame:
    """Recorded pages of a numbered listing: items of each page, and whether all pages together hold as many as were announced."""
    hits = t.customer.agg(F.count("*").alias("hits"))  # one row
    pages = t.customer.groupBy(F.floor((F.col("c_custkey") - 1) / 100).alias("page")).agg(F.collect_list("c_custkey").alias("items")).join(F.broadcast(hits))  # 100 items a page
    path = files.scratch_path(t.spark, "pages")
    files.write_json(pages, path)
    return files.replayed_pages(t.spark, path, "page bigint, items array<bigint>, hits bigint").select("page", "n", "hits", "complete")


@query("s11_scaled_scan", "SELECT l_linenumber, count(*) AS n, round(sum(CASE WHEN l_partkey <> 7 THEN l_partkey * 0.5 + 1.5 END), 2) AS total FROM lineitem GROUP BY 1")
def s11(t: Tables) -> DataFrame:
    v = bits.scaled(F.col("l_partkey"), 0.5, 1.5, 7)
    return t.lineitem.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(v), 2).alias("total"))


@query("s12_s13_aligned_window", f"SELECT gx, gy, round(v, 2) AS v FROM {GRID_SQL} WHERE gx >= floor(12.3) AND gx < ceil(20.7) AND gy >= floor(2.2) AND gy < ceil(4.1)")
def s12(t: Tables) -> DataFrame:
    gx, gy = F.col("gx"), F.col("gy")
    window = (gx >= F.floor(F.lit(12.3))) & (gx < F.ceil(F.lit(20.7))) & (gy >= F.floor(F.lit(2.2))) & (gy < F.ceil(F.lit(4.1)))
    return rounded(lattice(t).where(window), 2)


@query(
    "s14_bundle_on_one_grid",
    """WITH l AS (SELECT l_suppkey, l_linenumber, l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2, 3), g AS (SELECT f, min(l_suppkey) AS a, max(l_suppkey) AS b, min(l_linenumber) AS c, max(l_linenumber) AS d FROM l GROUP BY 1)
 SELECT a.l_suppkey, a.l_linenumber, a.n AS layer_a, b.n AS layer_b, (SELECT count(*) FROM (SELECT DISTINCT a, b, c, d FROM g)) AS n_grids FROM (SELECT * FROM l WHERE f = 'A') a JOIN (SELECT * FROM l WHERE f = 'N') b ON a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber""",
)
def s14(t: Tables) -> DataFrame:
    layers = t.lineitem.where("l_returnflag in ('A', 'N')").groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg(F.count("*").alias("n"))
    ends = layers.groupBy("l_returnflag").agg(F.struct(F.min("l_suppkey"), F.max("l_suppkey"), F.min("l_linenumber"), F.max("l_linenumber")).alias("grid"))
    grids = ends.agg(F.count_distinct("grid").alias("n_grids"))  # 1 where both layers lie on one grid
    wide = layers.groupBy("l_suppkey", "l_linenumber").pivot("l_returnflag", ["A", "N"]).agg(F.first("n"))
    both = wide.select("l_suppkey", "l_linenumber", F.col("A").alias("layer_a"), F.col("N").alias("layer_b")).where("layer_a is not null and layer_b is not null")
    return both.join(F.broadcast(grids))  # one row


@query("s15_point_sampling", f"SELECT p_partkey, round(g.v, 2) AS v FROM part LEFT JOIN {GRID_SQL} g ON g.gx = CAST(floor(p_retailprice / 20) AS BIGINT) AND g.gy = CAST(floor(p_size / 8.0) AS BIGINT)")
def s15(t: Tables) -> DataFrame:
    at = t.part.select("p_partkey", F.floor(F.col("p_retailprice") / 20).alias("gx"), F.floor(F.col("p_size") / 8).alias("gy"))
    return rounded(at.join(lattice(t), ["gx", "gy"], "left").select("p_partkey", "v"), 2)


@query("s16_listing_identities", "SELECT 0 AS part, true AS has_bytes")
def s16(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "listing")
    t.nation.coalesce(1).write.parquet(path)
    return files.listed_files(t.spark, path, r"part-(\d+)-.*\.parquet$", {"part": "int"}).select("part", (F.col("length") > 0).alias("has_bytes"))


@query("s18_s20_axis_audit", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS n FROM events GROUP BY 1")
def s20(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"), F.count("*").alias("n"))


@query(
    "s18_required_arrays",
    "SELECT name, there IS NOT NULL AS there, coalesce(n, 0) AS n FROM (VALUES ('view'), ('click'), ('purchase'), ('geometry')) r(name) LEFT JOIN (SELECT event_type AS there, count(*) AS n FROM events GROUP BY 1) ON there = name",
)
def s18(t: Tables) -> DataFrame:
    """Arrays that an archive must hold, and which of them it does."""
    names = t.spark.createDataFrame([(v,) for v in ("view", "click", "purchase", "geometry")], "name string")
    held = t.events.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return names.join(held, "name", "left").select("name", F.col("n").isNotNull().alias("there"), F.coalesce("n", F.lit(0)).alias("n"))


@query("s23_xml_flag", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'good' ELSE 'suspect' END AS flag FROM events")
def s23(t: Tables) -> DataFrame:
    flag = F.when(F.col("event_id") % 3 == 0, "good").otherwise("suspect")
    xml = F.concat(F.lit("<m><a name='geo'>"), F.base64(flag.cast("binary")), F.lit("</a></m>"))
    made = t.events.select("event_id", xml.alias("xml"))
    return made.select("event_id", F.unbase64(F.xpath_string("xml", F.lit("m/a[@name='geo']"))).cast("string").alias("flag"))


@query("s34_s35_partitioned_table", "SELECT l_partkey, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49")
def s34(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "cells")
    files.write_cells(t.lineitem.select("l_partkey", "l_quantity", "l_returnflag"), path, ["l_returnflag"])
    return files.read_columns(t.spark, path, ["l_partkey", "l_returnflag"], "l_returnflag = 'R' and l_quantity > 49")


@query("s39_s40_s41_digests")
def s39(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "digests")
    t.region.coalesce(1).write.parquet(path)
    return files.digests(t.spark, path)


@query(
    "j21_footprints_meet_domain",
    """SELECT s_suppkey, x < 9 AND x + 2 > 5 AND y < 9 AND y + 1 > 0 AND x + y < 14 AS meets FROM (SELECT s_suppkey, s_nationkey + 0.25 AS x, s_suppkey % 12 + 0.25 AS y FROM supplier)""",
)
def j21(t: Tables) -> DataFrame:
    """Boxes that meet a convex polygon: boxes apart first, then separating axes along the polygon's edges."""
    domain = [(5.0, 0.0), (9.0, 0.0), (9.0, 5.0), (5.0, 9.0)]
    x, y = F.col("s_nationkey") + 0.25, F.col("s_suppkey") % 12 + 0.25
    return t.supplier.select("s_suppkey", grid.box_meets_convex(x, y, x + 2.0, y + 1.0, domain).alias("meets"))


WEATHER = project.Conic(38.5, 38.5, 38.5, -97.5, 6371229.0, 0.0)  #: a sphere, as weather grids use
STATES = project.Conic(33.0, 45.0, 23.0, -96.0)  #: on the ellipsoid
_E = project.ECCENTRICITY


def _series(terms: tuple[float, ...], f: str, g: str, sign: str = "+") -> str:
    return "".join(f" {sign} ({a!r}) * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(terms, 1))


def _conic_sql(c: project.Conic, name: str) -> str:
    e = repr(c.eccentricity)
    t = f"tan(pi() / 4 - radians(lat2) / 2) * power((1 + {e} * sin(radians(lat2))) / (1 - {e} * sin(radians(lat2))), {e} / 2)"
    return f"{c.reach!r} * power({t}, {c.cone!r}) * sin({c.cone!r} * radians(lon2 - ({c.longitude!r}))) AS {name}_x, {c.origin!r} - {c.reach!r} * power({t}, {c.cone!r}) * cos({c.cone!r} * radians(lon2 - ({c.longitude!r}))) AS {name}_y"


@query(
    "g19_map_coordinates",
    f"""WITH p AS (SELECT s_suppkey, -180 + (s_suppkey * 37 % 3600) / 10.0::DOUBLE AS lon, -80 + (s_suppkey * 53 % 1640) / 10.0::DOUBLE AS lat, -125 + (s_suppkey * 7 % 600) / 10.0::DOUBLE AS lon2, 24 + (s_suppkey * 11 % 260) / 10.0::DOUBLE AS lat2 FROM supplier),
 z AS (SELECT *, CAST(floor((lon + 180) / 6) AS INT) % 60 + 1 AS zone FROM p), a AS (SELECT *, sinh(atanh(sin(radians(lat))) - {_E!r} * atanh({_E!r} * sin(radians(lat)))) AS t, radians(lon - (zone * 6 - 183)) AS w FROM z),
 x AS (SELECT *, atan2(t, cos(w)) AS xi, atanh(sin(w) / sqrt(1 + t * t)) AS eta FROM a)
 SELECT s_suppkey, zone, round({project.SCALE * project.RADIUS!r} * (eta{_series(project.FORWARD, "cos", "sinh")}) + 500000, 3) AS x, round({project.SCALE * project.RADIUS!r} * (xi{_series(project.FORWARD, "sin", "cosh")}) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS y,
 {", ".join(f"round({n}, 3) AS {n}" for n in ("sphere_x", "sphere_y", "ellipsoid_x", "ellipsoid_y"))}, true AS there_and_back
 FROM (SELECT *, {_conic_sql(WEATHER, "sphere")}, {_conic_sql(STATES, "ellipsoid")} FROM x)""",
)
def g19(t: Tables) -> DataFrame:
    """Places of the suppliers in their UTM zone, north or south, and in two conics; and whether the inverses lead back within 10^-9 degrees."""
    key = F.col("s_suppkey")
    lon, lat = -180 + (key * 37 % 3600) / 10, -80 + (key * 53 % 1640) / 10
    lon2, lat2 = -125 + (key * 7 % 600) / 10, 24 + (key * 11 % 260) / 10
    at = t.supplier.select("s_suppkey", lon.alias("lon"), lat.alias("lat"), lon2.alias("lon2"), lat2.alias("lat2"), project.utm_zone(lon).alias("zone"))
    conics = {"sphere": WEATHER, "ellipsoid": STATES}
    made = dict(zip("xy", project.utm(F.col("lon"), F.col("lat"), F.col("zone")), strict=True))
    for name, conic in conics.items():
        made |= dict(zip((f"{name}_x", f"{name}_y"), conic.forward(F.col("lon2"), F.col("lat2")), strict=True))
    placed = at.withColumns(made)
    back = {"b": project.utm_inverse(F.col("x"), F.col("y"), F.col("zone"), F.col("lat") < 0)} | {n: c.inverse(F.col(f"{n}_x"), F.col(f"{n}_y")) for n, c in conics.items()}
    close = F.lit(True)
    for name, (there, over) in back.items():
        for got, want in ((there, "lon"), (over, "lat")):
            close = close & (F.abs(got - F.col(want if name == "b" else f"{want}2")) < 1e-9)
    return placed.select("s_suppkey", "zone", *(F.round(c, 3).alias(c) for c in made), close.alias("there_and_back"))


@query(
    "s18_s19_s20_array_archives",
    """SELECT 'user_id' AS array, count(*) AS n, CAST(sum(user_id) AS DOUBLE) AS total, CAST(min(user_id) AS DOUBLE) AS low, CAST(max(user_id) AS DOUBLE) AS high FROM events
 UNION ALL SELECT 'value', count(*), round(sum(value), 4), min(value), max(value) FROM events""",
)
def s18_archives(t: Tables) -> DataFrame:
    """Events written as archives of arrays, checked for the required ones, and two of the three arrays read back in stretches."""
    path = files.scratch_path(t.spark, "arrays")
    arrays.write_arrays(t.events.select("event_id", "user_id", "value"), path, ["event_id", "user_id", "value"])
    arrays.require_arrays(path, {"event_id", "user_id", "value"})
    back = arrays.read_arrays(t.spark, path, ["user_id", "value"], stretch=50_000)
    return back.groupBy("array").agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
