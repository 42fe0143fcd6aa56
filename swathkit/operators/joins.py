"""Joins with declared cardinality, intervals, brackets and common support."""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.functions import clock
from swathkit.operators.contracts import ContractError, require_empty, require_unique
from swathkit.sources.files import written

DAY_US = 86_400_000_000


def keyed_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner", cardinality: str = "many_to_one") -> DataFrame:
    """Equi-join after checking the side(s) that must be unique."""
    ones, _, twos = cardinality.partition("_to_")
    if ones == "one":
        require_unique(left, key)
    if twos == "one":
        require_unique(right, key)
    return left.join(right, key, how)


def join_all_matched(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left rows with their one right row; an error if one has none."""
    require_empty(left.join(right, key, "left_anti"), "rows without a match")
    return keyed_join(left, right, key, "left")


def key_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("right"))
    )


def dense_counts(df: DataFrame, axes: list[DataFrame], count: str = "n") -> DataFrame:
    """Counts on the whole product of small axes (a bounded grid); 0 where nothing fell."""
    spine = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)
    counted = df.groupBy(*spine.columns).agg(F.count("*").alias(count))
    return spine.join(counted, spine.columns, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def bracket(points: DataFrame, hourly: DataFrame, time: str, hour: str, values: list[str]) -> DataFrame:
    """Each point with the hourly values interpolated between the hour before and the hour after.

    At an exact hour the next one is not needed; a missing bracket gives null.
    """
    ts = F.col(time)
    based = points.withColumns({"__lo": clock.hour_floor(ts), "__hi": clock.hour_ceil(ts), "__w": clock.hour_weight(ts)})
    low = hourly.select(F.col(hour).alias("__lo"), *(F.col(v).alias(f"__a_{v}") for v in values))
    high = hourly.select(F.col(hour).alias("__hi"), *(F.col(v).alias(f"__b_{v}") for v in values))
    both = based.join(low, "__lo", "left").join(high, "__hi", "left")
    made = {
        v: F.when(F.col("__w") == 0, F.col(f"__a_{v}")).otherwise((1 - F.col("__w")) * F.col(f"__a_{v}") + F.col("__w") * F.col(f"__b_{v}"))
        for v in values
    }
    return both.withColumns(made).select(*points.columns, *values)


def within_days(passes: DataFrame, found: DataFrame, key: list[str], low: float, high: float) -> DataFrame:
    """Pairs of a pass and an acquisition of its key whose lag (acquisition minus pass) lies in [low, high] days.

    Both sides are dealt to bins as long as the span of lags, so that each pass meets two bins in an equi-join;
    passes has pass_time, found has acq_time; lag_days is added.
    """
    width = int((high - low) * DAY_US) or 1
    start = F.unix_micros("pass_time") + F.lit(int(low * DAY_US))
    first = F.floor(start / width)
    left = passes.withColumn("__bin", F.explode(F.array(first, first + 1)))
    right = found.withColumn("__bin", F.floor(F.unix_micros("acq_time") / width))
    lag = clock.days_between(F.col("acq_time"), F.col("pass_time"))
    return left.join(right, [*key, "__bin"]).withColumn("lag_days", lag).where(F.col("lag_days").between(low, high)).drop("__bin")


def match_before_after(
    passes: DataFrame, found: DataFrame, key: list[str], sensor: str, *, low: float = 1.0, high: float = 15.0, imbalance: float = 3.0,
    enough: Column | None = None, extra: list[str] | None = None,
) -> DataFrame:
    """Per pass and sensor the best pair of an acquisition before and one after it.

    Lags lie in [-high, -low] and [low, high] days and differ by at most `imbalance`; the pair with the least
    (imbalance, total lag, earlier id, later id) wins. `enough` is a further condition on the pair, over pre_* and
    post_* of the extra columns.
    """
    extra = extra or []
    by = [*key, "pass_id", sensor]
    near = within_days(passes, found, key, -high, high)
    keep = [*by, "acq_id", "lag_days", *extra]
    pre = near.where(F.col("lag_days").between(-high, -low)).select(*keep)
    post = near.where(F.col("lag_days").between(low, high)).select(*keep)
    named = lambda df, side: df.select(*by, *(F.col(c).alias(f"{side}_{c}") for c in ("acq_id", "lag_days", *extra)))
    pairs = named(pre, "pre").join(named(post, "post"), by).where("pre_acq_id <> post_acq_id").withColumns(
        {"imbalance": F.abs(F.col("post_lag_days") + F.col("pre_lag_days")), "total": F.col("post_lag_days") - F.col("pre_lag_days")}
    ).where(F.col("imbalance") <= imbalance)
    if enough is not None:
        pairs = pairs.where(enough)
    rank = F.struct("imbalance", "total", "pre_acq_id", "post_acq_id")
    best = pairs.groupBy(*by).agg(F.min(rank).alias("best"), F.count("*").alias("n_pairs"))
    return best.select(*by, "best.*", "n_pairs")


def common_keys(df: DataFrame, member: str, group: str) -> DataFrame:
    """Members that occur in every group."""
    n = df.agg(F.count_distinct(group).alias("n_groups"))
    held = df.groupBy(member).agg(F.count_distinct(group).alias("held"))
    return held.join(F.broadcast(n), F.col("held") == F.col("n_groups")).select(member)  # n is one row


def neighbours(cells: DataFrame, key: list[str], x: str, y: str, value: str) -> DataFrame:
    """Pairs of cells next to each other along x or y: value and neighbour value, each pair once."""
    steps = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    moved = cells.select(*key, x, y, F.col(value).alias("value"), F.explode(steps).alias("s")).select(
        *key, F.col(x).alias("x0"), F.col(y).alias("y0"), (F.col(x) + F.col("s.dx")).alias(x), (F.col(y) + F.col("s.dy")).alias(y), "value"
    )
    return moved.join(cells.select(*key, x, y, F.col(value).alias("neighbour")), [*key, x, y])


MOST_SCENARIOS = 1_000_000  #: scenarios are declared by a person; more are a mistake


def scenarios(axes: list[DataFrame]) -> DataFrame:
    """The product of the axes' distinct values (one column each), which are few: their number is checked first."""
    values = [[r[0] for r in a.distinct().limit(MOST_SCENARIOS + 1).collect()] for a in axes]
    if math.prod(map(len, values)) > MOST_SCENARIOS:
        raise ContractError("axes have too many values for scenarios")
    spark, schema = axes[0].sparkSession, ", ".join(f"{a.columns[0]} {a.dtypes[0][1]}" for a in axes)
    return spark.createDataFrame(sorted(itertools.product(*values), key=repr), schema)


def trailing_totals(points: DataFrame, hourly: DataFrame, key: list[str], time: str, hour: str, value: str, hours: int) -> DataFrame:
    """Sum of the closed hours before each point's hour; null unless every hour is there and not negative.

    The hours of a point are listed and met by an equi-join, so no window is scanned twice.
    """
    top = clock.hour_floor(F.col(time))
    listed = points.withColumn("__h", F.explode(F.sequence(top - F.expr(f"interval {hours} hours"), top - F.expr("interval 1 hour"), F.expr("interval 1 hour"))))
    series = hourly.select(F.col(hour).alias("__h"), F.when(F.col(value) >= 0, F.col(value)).alias("__v"))
    return listed.join(series, "__h", "left").groupBy(*key).agg(
        F.count("__v").alias("hours_there"), F.when(F.count("__v") == hours, F.sum("__v")).alias("total")
    )


def latest_before(points: DataFrame, found: DataFrame, key: list[str], time: str, found_time: str, values: list[str]) -> DataFrame:
    """As-of join: the last row of `found` at or before each point, by one sorted pass over both sides."""
    a = points.select(*points.columns, F.col(time).alias("__t"), F.lit(1).alias("__side"), *(F.lit(None).cast(found.schema[v].dataType).alias(f"__{v}") for v in values))
    b = found.select(*(F.col(c) if c in key else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns),
                     F.col(found_time).alias("__t"), F.lit(0).alias("__side"), *(F.col(v).alias(f"__{v}") for v in values))
    w = W.partitionBy(*key).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b)
    filled = both.withColumns({v: F.last(f"__{v}", ignorenulls=True).over(w) for v in values})
    return filled.where("__side = 1").select(*points.columns, *values)
