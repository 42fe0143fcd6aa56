"""Grouped summaries: support, quantile profiles, strata, bins, reuse."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.operators.select import first_per


def compared_mean(c: str, limit: str) -> Column:
    """Sign of the mean of a column less a limit (a decimal's text), an aggregate: by decimals, whatever order rows come in.

    A sum of doubles can fall on either side of a limit that the mean equals. Values count to twelve digits after the point;
    where one is NaN, infinite or too large for that, doubles decide. Null without a value.
    """
    exact = F.col(c).try_cast("decimal(26,12)")
    by_decimals = F.signum((F.sum(exact) - F.count(c) * F.lit(Decimal(limit))).cast("double"))
    by_doubles = F.signum((F.avg(c) > float(limit)).cast("int") - (F.avg(c) < float(limit)).cast("int"))
    return F.when(F.count(exact) == F.count(c), by_decimals).otherwise(by_doubles.cast("double"))


def mode_of(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Most frequent value per key (smallest on ties), its count and its share."""
    counted = df.groupBy(*key, value).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(*key))
    return first_per(counted.withColumn("share", share), key, [F.col("n").desc(), F.col(value)])


def mean_of_means(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Mean per finest level, then of those means level by level; one row."""
    out = df.groupBy(*levels).agg(F.avg(value).alias(value))
    for k in range(len(levels) - 1, 0, -1):
        out = out.groupBy(*levels[:k]).agg(F.avg(value).alias(value))
    return out.agg(F.avg(value).alias(value))


def equal_weight_moments(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Mean and population sd where every group of every level weighs the same; one row."""
    out = df.groupBy(*levels).agg(F.avg(value).alias("m"), F.avg(F.col(value) * F.col(value)).alias("q"))
    for k in range(len(levels) - 1, -1, -1):
        out = out.groupBy(*levels[:k]).agg(F.avg("m").alias("m"), F.avg("q").alias("q"))
    return out.select(F.col("m").alias("mean"), F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("sd"))


def profile(df: DataFrame, key: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per key as an array."""
    return df.groupBy(*key).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("quantiles"), F.count(value).alias("n"))


def span(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """p10, p90 and their difference over finite values; null where there is none."""
    fine = F.when(~F.isnan(value), F.col(value))
    out = df.groupBy(*key).agg(F.percentile(fine, F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return out.select(*key, F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"), (F.col("q")[1] - F.col("q")[0]).alias("span"))


def binned(df: DataFrame, value: str, edges: list[float], measure: str) -> DataFrame:
    """Counts and mean of a measure in fixed bins, the last one closed, empty ones kept."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    v, place = F.col(value), F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        upper = v <= edges[k + 1] if k == len(edges) - 2 else v < edges[k + 1]
        place = F.when((v >= edges[k]) & upper, k).otherwise(place)
    got = df.withColumn("bin", place).groupBy("bin").agg(F.count("*").alias("n"), F.avg(measure).alias("mean"))
    return spine.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal bins of [0, 1], the last one closed; only bins with rows."""
    return df.groupBy(F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def reuse(df: DataFrame, ids: list[str]) -> DataFrame:
    """Over several id columns: distinct ids, uses and the largest number of uses of one id."""
    uses = df.select(F.explode(F.array(*ids)).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("uses"))
    return uses.agg(F.count("*").alias("n_ids"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"))


def strata_summary(df: DataFrame, spine: DataFrame, key: list[str], ok: Column) -> DataFrame:
    """Per stratum of a declared spine: rows, passed rows and share (null without rows)."""
    got = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"))
    out = spine.join(got, key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_ok": F.coalesce("n_ok", F.lit(0))})
    return out.withColumn("share", F.when(F.col("n") > 0, F.col("n_ok") / F.col("n")))


def pooled_within_variance(groups: DataFrame, n: str, variance: str) -> Column:
    return F.sum((F.col(n) - 1) * F.col(variance)) / F.sum(n)


def information_shares(df: DataFrame, block: str, x: str) -> DataFrame:
    """Share of within-block sum of squares per block (0 for single rows)."""
    sxx = df.groupBy(block).agg(F.regr_sxx(x, x).alias("sxx"))
    total = sxx.agg(F.sum("sxx").alias("__total"))  # one row
    return sxx.join(F.broadcast(total)).withColumn("share", F.col("sxx") / F.col("__total")).drop("__total")


def concentration(shares: DataFrame) -> DataFrame:
    """Effective number of blocks, largest share and the sum of the five largest; one row."""
    top = shares.select("share").orderBy(F.desc("share")).limit(5).agg(F.sum("share").alias("top_five"))
    whole = shares.agg((1.0 / F.sum(F.col("share") * F.col("share"))).alias("effective"), F.max("share").alias("largest"))
    return whole.join(top)  # one row each


def upper_median(df: DataFrame, key: list[str], value: str, width: int) -> DataFrame:
    """The element at place floor(n / 2) (from 0) of each key's values in order.

    Values are counted by stretches of `width`; only those of the median's stretch are sorted, so a key with many rows
    fills no task. value is a whole number.
    """
    stretch = F.floor(F.col(value) / width)
    rows = df.select(*key, F.col(value).alias("__v"), stretch.alias("__s"))
    counts = rows.groupBy(*key, "__s").agg(F.count("*").alias("__n"))
    w = W.partitionBy(*key)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.floor(F.sum("__n").over(w) / 2)
    placed = counts.select(*key, "__s", "__n", before.alias("__before"), place.alias("__place"))
    middle = placed.where("__place >= __before and __place < __before + __n").select(*key, "__s", (F.col("__place") - F.col("__before")).alias("__at"))
    ranked = rows.join(middle, [*key, "__s"]).withColumn("__k", F.row_number().over(W.partitionBy(*key, "__s").orderBy("__v")) - 1)
    return ranked.where("__k = __at").select(*key, F.col("__v").alias(value))


def supported_pair(df: DataFrame, group: str, block: str, value: str, candidates: DataFrame, width: float) -> DataFrame:
    """The low endpoint that maximises, over groups, the least number of blocks that span [low, low + width]; smallest on ties."""
    ranges = df.groupBy(group, block).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    declared = F.array(*(F.lit(float(r["low"])) for r in candidates.collect()))  # a short list
    met = ranges.withColumn("low", F.explode(F.filter(declared, lambda v: (F.col("lo") <= v) & (F.col("hi") >= v + width))))
    counts = met.groupBy("low", group).agg(F.count("*").alias("blocks"))
    n_groups = df.agg(F.count_distinct(group).alias("n_groups"))
    least = counts.groupBy("low").agg(F.min("blocks").alias("least"), F.count("*").alias("held")).join(F.broadcast(n_groups)).where("held = n_groups")
    return least.orderBy(F.desc("least"), "low").limit(1).select("low", (F.col("low") + width).alias("high"), "least")
