"""Window designs: balanced weights, leave-one-out schedules, arm contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 1024


def balanced_weights(df: DataFrame, stratum: str, arm: str, arms: tuple[str, str]) -> DataFrame:
    """Adds weight: equal mass per stratum that has both arms and per arm; 0 elsewhere. Each arm sums to 1."""
    at_ends = F.col(arm).isin(*arms)
    held = df.where(at_ends).groupBy(stratum, arm).agg(F.count("*").alias("__n"))
    both = held.groupBy(stratum).agg(F.count("*").alias("__arms")).where("__arms = 2").select(stratum)
    shared = both.agg(F.count("*").alias("__strata"))
    table = held.join(both, stratum, "left_semi").join(F.broadcast(shared))  # shared is one row
    return (
        df.join(table, [stratum, arm], "left")
        .withColumn("weight", F.coalesce(1.0 / (F.col("__strata") * F.col("__n")), F.lit(0.0)))
        .drop("__n", "__strata")
    )


def leave_one_out(df: DataFrame, unit: str, counts: dict[str, Column]) -> DataFrame:
    """For each unit that is dropped: units_left, and each of the sums over the rows of all other units.

    A unit's own sums are taken from the whole table's, so rows are counted once, not once per unit.
    """
    own = df.groupBy(unit).agg(*(F.sum(c).alias(n) for n, c in counts.items()))
    whole = own.agg(F.count("*").alias("__units"), *(F.sum(n).alias(f"__{n}") for n in counts))  # one row
    return own.join(F.broadcast(whole)).select(
        F.col(unit).alias("dropped"), (F.col("__units") - 1).alias("units_left"), *((F.col(f"__{n}") - F.col(n)).alias(n) for n in counts)
    )


def arm_contrast(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of positive-weight rows minus that of negative-weight rows; null unless each arm sums to 1."""
    w, v = F.col(weight), F.col(value)
    plus, minus = F.sum(F.greatest(w, F.lit(0.0))), F.sum(F.greatest(-w, F.lit(0.0)))
    sound = (F.abs(plus - 1) < 1e-9) & (F.abs(minus - 1) < 1e-9)
    return df.groupBy(*by).agg(F.when(sound, F.sum(w * v)).alias("difference"))


def natural_gap(df: DataFrame, value: str) -> DataFrame:
    """low and high side of the largest gap between distinct values; null where two gaps tie or there are not two values.

    Values are cut into BINS even bins; neighbours are found inside each bin, and between the ends of bins with values.
    """
    values = df.select(F.col(value).alias("v")).where("v is not null").distinct()
    ends = values.agg(F.min("v").alias("__a"), F.max("v").alias("__b"))  # one row
    share = F.try_divide(F.col("v") - F.col("__a"), F.col("__b") - F.col("__a"))
    binned = values.join(F.broadcast(ends)).select("v", F.coalesce(F.floor(share * (BINS - 1)), F.lit(0)).alias("__bin"))
    inner = binned.select("v", F.lead("v").over(W.partitionBy("__bin").orderBy("v")).alias("nxt"))
    bins = binned.groupBy("__bin").agg(F.min("v").alias("__lo"), F.max("v").alias("v"))
    outer = bins.select("v", F.lead("__lo").over(W.orderBy("__bin")).alias("nxt"))  # BINS rows at most
    gaps = inner.unionByName(outer).where("nxt is not null").withColumn("gap", F.col("nxt") - F.col("v"))
    top = gaps.groupBy().agg(F.max("gap").alias("gap"))
    return gaps.join(F.broadcast(top), "gap").groupBy().agg(
        F.when(F.count("*") == 1, F.max("v")).alias("low"), F.when(F.count("*") == 1, F.max("nxt")).alias("high")
    )
