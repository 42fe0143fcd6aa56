"""Paired linear and quadratic effects of endpoint pairs with their bootstrap, for all units and group sizes in one job.

Block moments are made once. For each group size they are added up to groups, and the groups of a unit are drawn with
replacement; one table of draws serves both models, both outcomes, all pairs and all quantities, so that differences of
models are differences within a draw. A draw whose moments do not determine a model counts as failed, not as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.functions import physics
from swathkit.operators import resampling
from swathkit.sources.files import written

MOMENTS = ("a", "b", "c", "d1", "e1", "d2", "e2")
MODELS = ("linear", "quadratic", "quadratic_minus_linear")
QUANTITIES = ("cooling_k", "cooling_flux", "equivalent_k", "departure_k")


def block_moments(cells: DataFrame, unit: str, block: str, x: str, kelvin: str, flux: str) -> DataFrame:
    """__unit, __block: centred cross products of x and x^2 with each other and with both outcomes."""
    df = cells.select(F.col(unit).alias("__unit"), F.col(block).alias("__block"), F.col(x).alias("x"), (F.col(x) * F.col(x)).alias("x2"), F.col(kelvin).alias("k"), F.col(flux).alias("f"))
    cross = lambda p, q, name: (F.covar_pop(p, q) * F.count("*")).alias(name)
    pairs = (("x", "x", "a"), ("x", "x2", "b"), ("x2", "x2", "c"), ("x", "k", "d1"), ("x2", "k", "e1"), ("x", "f", "d2"), ("x2", "f", "e2"))
    return df.groupBy("__unit", "__block").agg(*(cross(*p) for p in pairs))


def coefficients(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys and, of each outcome, the linear coefficient and both quadratic ones; null where not determined."""
    a, b, c = (F.col(n) for n in "abc")
    line, det = F.when(a > 0, a), F.when(a * c - b * b > 1e-12 * a * c, a * c - b * b)
    out = []
    for k in "12":
        d, e = F.col(f"d{k}"), F.col(f"e{k}")
        out += [(d / line).alias(f"l{k}"), ((c * d - b * e) / det).alias(f"q{k}"), ((a * e - b * d) / det).alias(f"r{k}")]
    return sums.select(*keys, *out)


def effects(moments: DataFrame, unit: str, sizes: list[int], pairs: list[tuple[float, float]], replicates: int, seed: int, reference: tuple[float, float]) -> DataFrame:
    """unit, size, low, high, model, quantity, point, q025, q975, se, estimable, requested."""
    sized = moments.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("g", F.floor(F.col("__block") / F.col("size")))
    groups = written(sized.groupBy("__unit", "size", "g").agg(*(F.sum(m).alias(m) for m in MOMENTS)), "groups")
    drawn = resampling.resampled_rows(groups, ["__unit", "size"], "g", replicates, seed)
    sums = drawn.groupBy("__unit", "size", "rep").agg(*(F.sum(F.col("times") * F.col(m)).alias(m) for m in MOMENTS))
    whole = groups.groupBy("__unit", "size").agg(*(F.sum(m).alias(m) for m in MOMENTS)).withColumn("rep", F.lit(-1).cast("bigint"))
    fits = coefficients(sums.unionByName(whole), ["__unit", "size", "rep"])
    fits = fits.withColumn("p", F.explode(F.array(*(F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high")) for lo, hi in pairs)))).select("*", "p.*").drop("p")
    low, high = F.col("low"), F.col("high")
    change = {m: [-(F.col(f"l{k}") * (high - low)) if m == "linear" else -(F.col(f"q{k}") * (high - low) + F.col(f"r{k}") * (high * high - low * low)) for k in "12"] for m in MODELS[:2]}
    made = {m: list(physics.cooling_quantities(*c, F.lit(reference[0]), F.lit(reference[1])).values()) for m, c in change.items()}
    made[MODELS[2]] = [q - p for p, q in zip(made["linear"], made["quadratic"], strict=True)]
    listed: list[Column] = [F.struct(F.lit(m).alias("model"), F.lit(q).alias("quantity"), v.alias("v")) for m in MODELS for q, v in zip(QUANTITIES, made[m], strict=True)]
    values = fits.select("__unit", "size", "rep", "low", "high", F.explode(F.array(*listed)).alias("e")).select("__unit", "size", "rep", "low", "high", "e.*")
    draw = F.when(F.col("rep") >= 0, F.col("v"))
    q = F.percentile(draw, F.array(F.lit(0.025), F.lit(0.975)))  # of the replicates of one effect
    return values.groupBy("__unit", "size", "low", "high", "model", "quantity").agg(
        F.max(F.when(F.col("rep") < 0, F.col("v"))).alias("point"), q[0].alias("q025"), q[1].alias("q975"), F.stddev_samp(draw).alias("se"),
        F.count(draw).alias("estimable"), F.count_if(F.col("rep") >= 0).alias("requested"),
    ).withColumnRenamed("__unit", unit)


def endpoint_support(cells: DataFrame, unit: str, block: str, x: str, pairs: list[tuple[float, float]], halfwidths: list[float]) -> DataFrame:
    """unit, low, high, halfwidth: blocks that span both endpoints, and cells in the closed band around each."""
    ends = F.explode(F.array(*(F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high")) for lo, hi in pairs)))
    rows = cells.select(F.col(unit).alias("__unit"), F.col(block).alias("__block"), F.col(x).alias("__x"))
    bounds = rows.groupBy("__unit", "__block").agg(F.min("__x").alias("x0"), F.max("__x").alias("x1")).withColumn("p", ends).select("*", "p.*")
    spanning = bounds.groupBy("__unit", "low", "high").agg(F.count_if((F.col("x0") <= F.col("low")) & (F.col("x1") >= F.col("high"))).alias("spanning_blocks"))
    counts = rows.groupBy("__unit", "__x").agg(F.count("*").alias("n")).withColumn("p", ends).select("*", "p.*").withColumn("halfwidth", F.explode(F.array(*map(F.lit, halfwidths))))
    band = lambda c: F.sum(F.when(F.abs(F.col("__x") - F.col(c)) <= F.col("halfwidth"), F.col("n")).otherwise(0))
    bands = counts.groupBy("__unit", "low", "high", "halfwidth").agg(band("low").alias("lower_cells"), band("high").alias("upper_cells"))
    return bands.join(spanning, ["__unit", "low", "high"]).withColumnRenamed("__unit", unit)
