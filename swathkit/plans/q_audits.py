"""Checks of computed tables against independent ones (C6 to C12, R18, S25, S33), each of which can fail, and the quadratic run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.functions import clock, physics
from swathkit.operators import inference, joins, ledger, polygons, ranks, reconcile, resampling, select, sensitivity
from swathkit.plans.q_grid import EDGES_SQL, supplier_polygons
from swathkit.plans.q_statistics import _strata_sql
from swathkit.plans.registry import Tables, query, rounded
from swathkit.sources import files

_MOMENTS = """(SELECT left(pass, 4) AS year, block, count(*) AS n, regr_sxy(y, x) AS xy, regr_sxx(y, x) AS xx FROM {cells} GROUP BY 1, 2)"""
REPLICATES = 60


@query(
    "c6_estimate_reconciliation",
    f"""WITH {_strata_sql(_MOMENTS, "year", "block", REPLICATES, 5)}, r AS (SELECT i.year AS year, rep, -0.1 * sum(times * xy) / sum(times * xx) AS v FROM d JOIN i ON i.s = d.s AND i.place = d.place GROUP BY 1, 2),
 m AS (SELECT year, 0.1 * sum(xy) / sum(xx) AS gradient, CAST(sum(n) AS BIGINT) AS n_cells FROM {_MOMENTS} GROUP BY 1)
 SELECT m.year AS year, any_value(n_cells) AS n_cells, round(any_value(gradient), 4) AS gradient, round(stddev_samp(v), 4) AS se, round(quantile_cont(v, 0.975) - quantile_cont(v, 0.025), 4) AS width, count(v) AS estimable, '' AS failed FROM m JOIN r ON r.year = m.year GROUP BY 1""",
)
def c6(t: Tables) -> DataFrame:
    """Yearly estimates with their bootstrap intervals against error, width, draws and population computed by other ways."""
    cells = t.cells.withColumn("year", F.substring("pass", 1, 4))
    blocks = files.written(cells.groupBy("year", "block").agg(F.count("*").alias("n"), F.regr_sxy("y", "x").alias("xy"), F.regr_sxx("y", "x").alias("xx")), "moments")
    sums = resampling.resampled_rows(blocks, ["year"], "block", REPLICATES, 5).groupBy("year", "rep").agg(*(F.sum(F.col("times") * F.col(c)).alias(c) for c in ("xy", "xx")))
    draws = files.written(sums.select("year", "rep", F.when(F.col("xx") > 0, -0.1 * F.col("xy") / F.col("xx")).alias("cooling")), "draws")
    point = blocks.groupBy("year").agg((0.1 * F.sum("xy") / F.sum("xx")).alias("gradient"), F.sum("n").alias("n_cells"), F.count("*").alias("n_blocks"))
    spread = inference.interval_summary(draws, ["year"], "cooling").select("year", "se", F.col("q025").alias("low"), F.col("q975").alias("high"))
    released = point.withColumn("cooling", -F.col("gradient")).join(spread, "year")
    v, n = F.col("cooling"), F.count("cooling")
    other = draws.groupBy("year").agg(
        F.sqrt((F.sum(v * v) - F.sum(v) * F.sum(v) / n) / (n - 1)).alias("se"), F.count("*").alias("requested"), n.alias("estimable"), F.count_if(v.isNull()).alias("failed")
    )
    ends = ranks.quantile_columns(draws, ["year"], "cooling", {"a": 0.025, "b": 0.975}).select("year", (F.col("b") - F.col("a")).alias("width"))
    counted = cells.groupBy("year").agg(F.count("*").alias("n_cells"), F.count_distinct("block").alias("n_blocks"))
    precision = files.written(other.join(ends, "year").join(counted, "year"), "precision")
    verdict = reconcile.estimates(released, precision, ["year"], 1e-6)
    return rounded(verdict.join(released.select("year", "n_cells", "gradient", "se"), "year").join(precision.select("year", "width", "estimable"), "year"), 4)


_BRACKETED = """(SELECT event_id, user_id, w, lo, hi, a.v AS va, b.v AS vb, CASE WHEN w = 0 THEN a.v ELSE (1 - w) * a.v + w * b.v END AS v FROM
 (SELECT event_id, user_id, date_trunc('hour', ts) AS lo, date_trunc('hour', ts) + CASE WHEN ts = date_trunc('hour', ts) THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END AS hi, (epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 3.6e9 AS w FROM {passes})
 LEFT JOIN {hourly} a ON a.hour = lo LEFT JOIN {hourly} b ON b.hour = hi)"""


def weighed_hours(points: DataFrame, hourly: DataFrame, key: list[str], time: str, hour: str, value: str) -> DataFrame:
    """Interpolation said another way: each point lists its hours with their weights, meets them and adds up; null if one lacks."""
    low, w = clock.hour_floor(F.col(time)), clock.hour_weight(F.col(time))
    hours = F.array(F.struct(low.alias("h"), (1 - w).alias("w")), F.struct((low + F.expr("interval 1 hour")).alias("h"), w.alias("w")))
    listed = points.select(*key, F.explode(F.filter(hours, lambda x: x["w"] > 0)).alias("x")).select(*key, F.col("x.h").alias(hour), F.col("x.w").alias("__w"))
    met = listed.join(hourly.select(hour, F.col(value).alias("__v")), hour, "left")
    return met.groupBy(*key).agg(F.when(F.count("__v") == F.count("*"), F.sum(F.col("__w") * F.col("__v"))).alias(value))


@query("c7_c12_weather_reconciliation", f"SELECT 'ok' AS status, count(*) AS n, count(v) AS with_value, round(sum(v), 3) AS total FROM {_BRACKETED}")
def c7(t: Tables) -> DataFrame:
    """Values interpolated at the passes' own times, minutes and seconds in, against the same from weighed hours."""
    at = t.passes.select("event_id", "ts")
    once = joins.bracket(at, t.hourly, "ts", "hour", ["v"])
    again = weighed_hours(at, t.hourly, ["event_id"], "ts", "hour", "v")
    status = reconcile.compared(once, again, ["event_id"], "v")
    return rounded(status.groupBy("status").agg(F.count("*").alias("n"), F.count("recorded").alias("with_value"), F.sum("recorded").alias("total")), 3)


@query(
    "c12_weather_audit_sample",
    f"""SELECT user_id, event_id, round(v, 6) AS recorded, 'ok' AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sha256(CAST(event_id AS VARCHAR)), event_id) AS k FROM {_BRACKETED}) WHERE k <= 2""",
)
def c12(t: Tables) -> DataFrame:
    """Two passes of each user, those with the smallest digests, interpolated again from the hours."""
    sample = select.hash_sample(t.passes.select("user_id", "event_id", "ts"), ["user_id"], F.col("event_id").cast("string"), 2).select("user_id", "event_id", "ts")
    once = joins.bracket(sample, t.hourly, "ts", "hour", ["v"])
    again = weighed_hours(sample, t.hourly, ["user_id", "event_id"], "ts", "hour", "v")
    return rounded(reconcile.compared(once, again, ["user_id", "event_id"], "v").drop("recomputed"))


def populated(cells: DataFrame, sizes: list[int], least: int) -> DataFrame:
    """pass, size, k: how many groups of blocks, of each size (divisors of the largest), have at least so many cells in the pass.

    A row a pass and group of the largest size holds a count for each of its blocks, of which the counts of smaller groups are sums.
    """
    most = max(sizes)
    place = F.pmod("block", F.lit(most))
    wide = cells.groupBy("pass", F.floor(F.col("block") / most).alias("g")).agg(F.array(*(F.count_if(place == i) for i in range(most))).alias("held"), F.count_if(F.col("block").isNull()).alias("none"))
    full = lambda v: (v >= least).cast("bigint")
    groups = lambda s: sum((full(sum((F.col("held")[i] for i in range(a + 1, a + s)), F.col("held")[a])) for a in range(0, most, s)), full(F.col("none")))
    counts = wide.groupBy("pass").agg(*(F.sum(groups(s)).alias(f"k{s}") for s in sizes))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.col(f"k{s}").alias("k")) for s in sizes)))
    return counts.select("pass", rows.alias("r")).select("pass", "r.*")


@query(
    "c8_output_scope",
    """WITH g AS (SELECT pass, size, CAST(floor(block / CAST(size AS DOUBLE)) AS BIGINT) AS g, count(*) AS n FROM {cells} CROSS JOIN (VALUES (1), (2), (4), (8), (16)) v(size) GROUP BY 1, 2, 3),
 f AS (SELECT pass, size FROM g WHERE n >= 8 GROUP BY 1, 2 HAVING count(*) >= 12), e AS (SELECT pass, size FROM (SELECT DISTINCT pass FROM {cells}) CROSS JOIN (VALUES (1), (2), (4), (8)) v(size))
 SELECT coalesce(e.pass, f.pass) AS pass, coalesce(e.size, f.size) AS size, CASE WHEN f.pass IS NULL THEN 'missing' WHEN e.pass IS NULL THEN 'extra' ELSE 'ok' END AS status FROM e FULL JOIN f ON e.pass = f.pass AND e.size = f.size""",
)
def c8(t: Tables) -> DataFrame:
    """Passes x four group sizes that are declared, against those with a dozen groups of eight cells or more; missing and extra ones are listed."""
    sizes = lambda *v: F.explode(F.array(*map(F.lit, v))).alias("size")
    expected = t.cells.select("pass").distinct().select("pass", sizes(1, 2, 4, 8))
    found = populated(t.cells, [1, 2, 4, 8, 16], 8).where("k >= 12")
    return reconcile.scope(expected, found, ["pass", "size"])


@query(
    "c11_geometry_metrics",
    f"""WITH e AS {EDGES_SQL} SELECT polygon, count(*) AS corners, round(sum(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2))), 6) AS perimeter, round(abs(sum(x0 * y1 - x1 * y0)) / 2, 6) AS recorded, 'ok' AS status FROM e GROUP BY 1""",
)
def c11(t: Tables) -> DataFrame:
    """Areas of the polygons from their corners (cross products), against the sum of their areas inside blocks."""
    shapes = supplier_polygons(t)
    edges = polygons.edges(shapes, "polygon", "rings")
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    metrics = edges.groupBy("polygon").agg(F.count("*").alias("corners"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("perimeter"), (F.abs(F.sum(cross)) / 2).alias("area"))
    again = polygons.block_areas(shapes, "polygon", "rings", 5.0).groupBy("polygon").agg(F.sum("area").alias("area"))
    status = reconcile.compared(metrics, again, ["polygon"], "area").drop("recomputed")
    return rounded(status.join(metrics.drop("area"), "polygon"))


@query(
    "r18_scene_binding",
    """WITH a AS (SELECT o_orderkey, l_linenumber, sha256(concat_ws(':', o_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT))) AS checksum FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'),
 b AS (SELECT l_orderkey, l_linenumber, sha256(concat_ws(':', l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_quantity > 48 THEN 48 ELSE l_quantity END AS BIGINT))) AS checksum FROM lineitem WHERE l_returnflag <> 'R'),
 s AS (SELECT o_orderkey, l_linenumber, min(checksum) AS checksum FROM a GROUP BY 1, 2), h AS (SELECT l_orderkey, l_linenumber, min(checksum) AS checksum FROM b GROUP BY 1, 2),
 k AS (SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), '|') AS held, count(*) AS n_held FROM h GROUP BY 1)
 SELECT o_orderkey, array_to_string(list_sort(list(s.l_linenumber)), '|') AS scenes, coalesce(array_to_string(list_sort(list(s.l_linenumber)), '|') = any_value(held), false) AS same_set, count(h.checksum) AS n_bound,
 count(*) FILTER (WHERE h.checksum <> s.checksum) AS n_changed, coalesce(any_value(n_held), 0) AS n_held FROM s LEFT JOIN h ON h.l_orderkey = o_orderkey AND h.l_linenumber = s.l_linenumber LEFT JOIN k ON k.l_orderkey = o_orderkey GROUP BY 1""",
)
def r18(t: Tables) -> DataFrame:
    """Scenes of each pass bound to a ledger that has digests of its own: same set, scenes bound, and those whose content has changed.

    The ledger was written when quantities were capped at 48, so lines above that have another digest there.
    """
    digest = lambda q: F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", q.cast("bigint")), 256)
    quantity = F.col("l_quantity")
    passes = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    scenes = t.lineitem.join(passes, "l_orderkey", "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.min(digest(quantity)).alias("checksum"))
    ledger = t.lineitem.where("l_returnflag <> 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.min(digest(F.least(quantity, F.lit(48.0)))).alias("held"))
    names = lambda c: F.concat_ws("|", F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")))
    bound = scenes.join(ledger, ["l_orderkey", "l_linenumber"], "left").groupBy("l_orderkey").agg(
        names("l_linenumber").alias("scenes"), F.count("held").alias("n_bound"), F.count_if(F.col("held") != F.col("checksum")).alias("n_changed")
    )
    held = ledger.groupBy("l_orderkey").agg(names("l_linenumber").alias("held"), F.count("*").alias("n_held"))
    both = joins.keyed_join(bound, held, ["l_orderkey"], "left", "one_to_one")
    same = F.coalesce(F.col("scenes") == F.col("held"), F.lit(False))
    return both.select(F.col("l_orderkey").alias("o_orderkey"), "scenes", same.alias("same_set"), "n_bound", "n_changed", F.coalesce("n_held", F.lit(0)).alias("n_held"))


@query(
    "s25_search_after_replay",
    """WITH p AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS page, o_orderkey AS k FROM orders), w AS (SELECT page, count(*) AS n, max(k) AS last FROM p GROUP BY 1), q AS (SELECT page, n, lag(last) OVER (ORDER BY page) AS after FROM w),
 l AS (SELECT 'whole' AS listing, * FROM q UNION ALL SELECT 'cut', * FROM q WHERE page % 7 <> 3)
 SELECT listing, page, n, after, listing = 'whole' OR (page - 1) % 7 <> 3 AS chained, (SELECT count(*) FROM orders) = sum(n) OVER (PARTITION BY listing) AS complete FROM l""",
)
def s25(t: Tables) -> DataFrame:
    """A listing recorded page by page, each asking for what comes after the last item seen; and the same with lost pages, whose followers do not chain."""
    items = ranks.placed(t.orders.select("o_orderkey"), ["o_orderkey"]).select(F.floor(F.col("place") / 50).alias("page"), "o_orderkey")
    asked = items.groupBy("page").agg(F.max("o_orderkey").alias("after")).withColumn("page", F.col("page") + 1)
    hits = t.orders.agg(F.count("*").alias("hits"))  # one row
    pages = items.groupBy("page").agg(F.array_sort(F.collect_list("o_orderkey")).alias("items")).join(asked, "page", "left").join(F.broadcast(hits))  # 50 items a page
    recorded = pages.withColumn("listing", F.explode(F.array(F.lit("whole"), F.when(F.col("page") % 7 != 3, "cut")))).where("listing is not null")
    path = files.scratch_path(t.spark, "tokens")
    files.write_json(recorded, path)
    return reconcile.chained_pages(t.spark.read.schema("listing string, page bigint, items array<bigint>, after bigint, hits bigint").json(path), ["listing"])


@query("s33_checked_csv", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1, 2")
def s33(t: Tables) -> DataFrame:
    """A table of a declared number of rows and a unique key, written as CSV after both checks and read back."""
    out = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    columns = ["o_orderpriority", "o_orderstatus", "n", "mean"]
    axes = joins.scenarios([t.orders.select("o_orderpriority"), t.orders.select("o_orderstatus")])
    declared = joins.keyed_join(axes, out, ["o_orderpriority", "o_orderstatus"], "left", "one_to_one").where("n is not null")
    path = files.scratch_path(t.spark, "checked-csv")
    files.write_csv(declared, path, columns, columns[:2], n_rows=out.count())
    return files.read_csv(t.spark, path, "o_orderpriority string, o_orderstatus string, n bigint, mean double", columns, set(columns))


PAIRS = [(low, round(low + step, 2)) for low in (0.01, 0.02, 0.03, 0.04, 0.05) for step in (0.02, 0.03, 0.04)]
HALFWIDTHS, SIZES, RUN_REPLICATES, RUN_SEED = [0.004, 0.014, 0.024], [4, 8], 40, 20261004
_PAIRS_SQL = ", ".join(f"({lo}, {hi})" for lo, hi in PAIRS)
_RUN_CELLS = "(SELECT left(pass, 4) AS year, block, x, 290 + y / 10000 AS k, 0.97 * 5.670374419e-8 * power(290 + y / 10000, 4) AS f FROM {cells})"
_RUN_GROUPS = f"""(SELECT year, size, CAST(floor(block / CAST(size AS DOUBLE)) AS BIGINT) AS g, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d1) AS d1, sum(e1) AS e1, sum(d2) AS d2, sum(e2) AS e2
 FROM (SELECT year, block, count(*) * covar_pop(x, x) AS a, count(*) * covar_pop(x, x * x) AS b, count(*) * covar_pop(x * x, x * x) AS c, count(*) * covar_pop(x, k) AS d1, count(*) * covar_pop(x * x, k) AS e1, count(*) * covar_pop(x, f) AS d2, count(*) * covar_pop(x * x, f) AS e2 FROM {_RUN_CELLS} GROUP BY 1, 2)
 CROSS JOIN (VALUES (4), (8)) v(size) GROUP BY 1, 2, 3)"""
_RUN_SUMS = ", ".join(f"sum(times * i.{m}) AS {m}" for m in ("a", "b", "c", "d1", "e1", "d2", "e2"))


def _quantities_sql(k: str, f: str) -> str:
    anchor = "(0.97 * 5.670374419e-8 * power(300.0, 4))"
    equivalent = f"(-300.0 * (power(({anchor} - {f}) / {anchor}, 0.25) - 1))"
    return f"[{k}, {f}, {equivalent}, {k} - {equivalent}]"


@query(
    "r29_quadratic_run",
    f"""WITH {_strata_sql(_RUN_GROUPS, "concat_ws('/', year, size)", "g", RUN_REPLICATES, RUN_SEED)},
 m AS (SELECT i.year AS year, i.size AS size, rep, {_RUN_SUMS} FROM d JOIN i ON i.s = d.s AND i.place = d.place GROUP BY 1, 2, 3 UNION ALL SELECT year, size, -1, {_RUN_SUMS.replace("times * ", "")} FROM i GROUP BY 1, 2),
 f AS (SELECT year, size, rep, d1 / a AS l1, d2 / a AS l2, (c * d1 - b * e1) / (a * c - b * b) AS q1, (a * e1 - b * d1) / (a * c - b * b) AS r1, (c * d2 - b * e2) / (a * c - b * b) AS q2, (a * e2 - b * d2) / (a * c - b * b) AS r2 FROM m),
 p(low, high) AS (VALUES {_PAIRS_SQL}),
 v AS (SELECT year, size, rep, low, high, -l1 * (high - low) AS lk, -l2 * (high - low) AS lf, -(q1 * (high - low) + r1 * (high * high - low * low)) AS qk, -(q2 * (high - low) + r2 * (high * high - low * low)) AS qf FROM f, p),
 w AS (SELECT year, size, rep, low, high, {_quantities_sql("lk", "lf")} AS line, {_quantities_sql("qk", "qf")} AS quad FROM v),
 e AS (SELECT year, size, rep, low, high, model, unnest(['cooling_k', 'cooling_flux', 'equivalent_k', 'departure_k']) AS quantity, unnest(CASE model WHEN 'linear' THEN line WHEN 'quadratic' THEN quad ELSE [quad[1] - line[1], quad[2] - line[2], quad[3] - line[3], quad[4] - line[4]] END) AS v
  FROM w, (VALUES ('linear'), ('quadratic'), ('quadratic_minus_linear')) t(model)),
 r AS (SELECT year, size, low, high, model, quantity, max(v) FILTER (WHERE rep < 0) AS point, quantile_cont(v, 0.025) FILTER (WHERE rep >= 0) AS q025, quantile_cont(v, 0.975) FILTER (WHERE rep >= 0) AS q975, stddev_samp(v) FILTER (WHERE rep >= 0) AS se, count(v) FILTER (WHERE rep >= 0) AS estimable FROM e GROUP BY ALL),
 s AS (SELECT year, low, high, count(*) FILTER (WHERE x0 <= low AND x1 >= high) AS spanning_blocks FROM (SELECT year, block, min(x) AS x0, max(x) AS x1 FROM {_RUN_CELLS} GROUP BY 1, 2), p GROUP BY 1, 2, 3),
 h AS (SELECT year, low, high, halfwidth, count(*) FILTER (WHERE abs(x - low) <= halfwidth) AS lower_cells, count(*) FILTER (WHERE abs(x - high) <= halfwidth) AS upper_cells FROM {_RUN_CELLS}, p, (VALUES (0.004), (0.014), (0.024)) z(halfwidth) GROUP BY 1, 2, 3, 4)
 SELECT year, low::DOUBLE AS low, high::DOUBLE AS high, halfwidth::DOUBLE AS halfwidth, size, model, quantity, spanning_blocks, lower_cells, upper_cells, round(point, 5) + 0.0 AS point, round(q025, 5) + 0.0 AS q025, round(q975, 5) + 0.0 AS q975, round(se, 5) AS se, estimable, 'OK' AS status
 FROM h JOIN s USING (year, low, high) JOIN r USING (year, low, high)""",
)
def r29(t: Tables) -> DataFrame:
    """Years x fifteen pairs x three half-widths x two group sizes x three models x four quantities; the second call of the run makes what the first left."""
    cells = files.written(t.cells.select(F.substring("pass", 1, 4).alias("year"), "block", "x", (290 + F.col("y") / 10000).alias("k")).withColumn("f", physics.emitted_energy(F.lit(0.97), F.col("k"))), "run-cells")

    def make(units: DataFrame) -> DataFrame:
        moments = sensitivity.block_moments(cells.join(F.broadcast(units), "year", "left_semi"), "year", "block", "x", "k", "f")
        return sensitivity.effects(moments, "year", SIZES, PAIRS, RUN_REPLICATES, RUN_SEED, (300.0, 0.97))

    schema = "year string, size int, low double, high double, model string, quantity string, point double, q025 double, q975 double, se double, estimable bigint, requested bigint"
    run = ledger.Ledger(t.spark.createDataFrame([], schema), files.scratch_path(t.spark, "quadratic-run"), "year")
    years = cells.select("year").distinct()
    run.run(years.where("year % 2 = 0"), make)
    out = run.run(years, make)
    support = sensitivity.endpoint_support(cells, "year", "block", "x", PAIRS, HALFWIDTHS)
    both = support.join(out, ["year", "low", "high"])
    there = F.col("spanning_blocks") > 0
    values = {c: F.when(there, F.round(c, 5) + 0.0) for c in ("point", "q025", "q975", "se")}
    return both.withColumns(values).withColumn("status", F.when(there, "OK").otherwise("NOT_ESTIMATED_NO_SPANNING_BLOCKS")).drop("requested")
