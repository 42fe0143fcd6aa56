"""Whole-group multinomial resampling as Spark jobs.

Draw k of replicate r picks the group at place SHA-256("seed:r:k") mod G among the G sorted labels: as uniform as any
generator, and the same on every run, in every order and in other engines. Draws are rows, counted by (replicate, place)
and joined to one row of sums per group, so neither groups nor replicates pass through the driver or one task. Draws are made by
explode, which size estimates do not see: the joins ask for a merge, or the draws would be broadcast through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.operators import ranks
from swathkit.operators.select import spread

TOLERANCE = 1e-10


def drawn_place(n: Column, *parts: Column) -> Column:
    """Place 0 .. n - 1 named by a digest of the parts."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint") % n


def numbered(groups: DataFrame, label: str) -> DataFrame:
    """Adds place: 0, 1, .. in order of the label's text; labels are distinct, one row each."""
    return ranks.placed(groups.withColumn("__text", F.col(label).cast("string")), ["__text"]).drop("__text")


def multiplicities(spark: SparkSession, n: int, replicates: int, seed: int) -> DataFrame:
    """rep, place, times: how often each replicate drew each place of n."""
    reps = spark.range(replicates).select(F.col("id").alias("rep"))
    if not n:
        return reps.limit(0).select("rep", F.col("rep").alias("place"), F.col("rep").alias("times"))
    draws = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    place = drawn_place(F.lit(n), F.lit(seed), F.col("rep"), F.col("k"))
    return draws.groupBy("rep", place.alias("place")).agg(F.count(F.lit(1)).alias("times"))


def resampled_sums(groups: DataFrame, label: str, values: list[str], replicates: int, seed: int) -> DataFrame:
    """rep and the sums of the values over each replicate's groups, each as often as it was drawn."""
    placed = numbered(groups.select(label, *values), label)
    times = multiplicities(groups.sparkSession, groups.count(), replicates, seed)
    return times.hint("merge").join(placed, "place").groupBy("rep").agg(*(F.sum(F.col("times") * F.coalesce(v, F.lit(0.0))).alias(v) for v in values))


def resampled_rows(rows: DataFrame, stratum: list[str], label: str, replicates: int, seed: int) -> DataFrame:
    """rep, times and all columns of rows: rows resampled inside each stratum, as many draws as it has rows.

    A draw of stratum s is named by SHA-256("seed:r:s:k"), s being its columns joined by "/"; a label is unique in its stratum.
    """
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in stratum)) if stratum else F.lit("")
    named = rows.withColumn("__s", name)
    placed = named.withColumn("__place", F.row_number().over(W.partitionBy("__s").orderBy(F.col(label).cast("string"))).cast("bigint") - 1)
    sizes = named.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))
    reps = rows.sparkSession.range(replicates).select(F.col("id").alias("rep"))
    runs = spread(sizes.crossJoin(F.broadcast(reps)), "__s", "rep")  # few rows, which make very many
    draws = runs.select("rep", "__s", "__n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)).alias("__k"))
    place = drawn_place(F.col("__n"), F.lit(seed), F.col("rep"), F.col("__s"), F.col("__k"))
    times = draws.groupBy("rep", "__s", place.alias("__place")).agg(F.count(F.lit(1)).alias("times"))
    return times.hint("merge").join(placed, ["__s", "__place"]).drop("__s", "__place")


def coefficients(sums: DataFrame, p: int, k: int, keep: list[int] | None = None, prefix: str = "") -> DataFrame:
    """rep, outcome (0 ..), coef (array over the kept predictors, null where the replicate is rank-deficient).

    sums has xx_i_j (i <= j) and xy_i_k of p predictors; a batch of replicates is solved at once.
    """
    own = list(range(p)) if keep is None else keep

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            xx = np.stack([np.stack([f[f"{prefix}xx_{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in own], 1) for i in own], 1)
            xy = np.stack([np.stack([f[f"{prefix}xy_{i}_{o}"].to_numpy(float) for o in range(k)], 1) for i in own], 1)
            scale = np.sqrt(np.maximum(np.einsum("rii->ri", xx), 1e-300))
            unit = xx / scale[:, :, None] / scale[:, None, :]
            good = np.linalg.matrix_rank(unit, tol=TOLERANCE, hermitian=True) == len(own)
            beta = np.full(xy.shape, np.nan)
            beta[good] = np.linalg.solve(unit[good], xy[good] / scale[good][:, :, None]) / scale[good][:, :, None]
            for o in range(k):
                yield pd.DataFrame({"rep": f["rep"], "outcome": o, "coef": [b.tolist() if g else None for b, g in zip(beta[:, :, o], good, strict=True)]})

    return sums.mapInPandas(run, "rep bigint, outcome int, coef array<double>")
