"""Selection and de-duplication of passes, granules and catalogue rows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.functions import clock


GROUP_LIMIT = 1000  #: rows of a group up to which Spark keeps only the first before a shuffle (spark.sql.optimizer.windowGroupLimitThreshold)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the keys to as many tasks as shuffles have: for work that costs more than its bytes say, which would be coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def latest_revision(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The row of each key with the largest values of `by`, compared as they are typed (cast revisions to numbers)."""
    return first_per(df, key, [F.col(c).desc_nulls_last() for c in by])


def select_passes(
    df: DataFrame, *, key: list[str], time: str, tie: str, quality: Column, years: tuple[int, int], season: tuple[str, str], longitude: Column
) -> DataFrame:
    """Good rows of the years, the first per key, whose local solar date lies in the season; adds solar_date."""
    good = df.where(quality & F.year(time).between(*years))
    first = first_per(good, key, [F.col(time), F.col(tie)])
    date = clock.local_solar_date(F.col(time), longitude)
    return first.withColumn("solar_date", date).where(clock.in_season(F.col("solar_date"), *season))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where no column is null or NaN."""
    floats = {c for c, k in df.dtypes if k in ("double", "float")}
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (~F.isnan(c) if c in floats else F.lit(True)))
    return df


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(a).alias(b) for a, b in names.items()))


def complete_bundles(layers: DataFrame, key: list[str], version: list[str], layer: str, required: list[str]) -> DataFrame:
    """The latest version of each key that has all required layers."""
    whole = (
        layers.where(F.col(layer).isin(required)).groupBy(*key, *version)
        .agg(F.count_distinct(layer).alias("n_layers")).where(F.col("n_layers") == len(required))
    )
    return latest_revision(whole, key, version).drop("n_layers")


def hash_sample(df: DataFrame, key: list[str], identity: Column, n: int) -> DataFrame:
    """n rows per key with the lowest SHA-256 of their identity.

    Spark cuts groups before its shuffle where n is at most GROUP_LIMIT. For a larger n, rows are counted by the digest's
    first digits, and of keys with more than n rows only those up to the digits that hold the n-th are ranked.
    """
    digest = F.sha2(identity.cast("string"), 256)
    if n > GROUP_LIMIT:
        head = F.coalesce(F.substring(digest, 1, 3), F.lit(""))  # 4,096 of a key; null digests come first
        w = W.partitionBy(*key)
        counts = df.groupBy(*key, head.alias("__h")).agg(F.count(F.lit(1)).alias("__c"))
        upto = counts.withColumns({"__sum": F.sum("__c").over(w.orderBy("__h")) - F.col("__c"), "__all": F.sum("__c").over(w)})
        cut = upto.where((F.col("__all") > n) & (F.col("__sum") < n)).groupBy(*(F.col(k).alias(f"__k_{k}") for k in key)).agg(F.max("__h").alias("__cut"))
        same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key), F.lit(True))
        df = df.join(F.broadcast(cut), same, "left").where(F.col("__cut").isNull() | (head <= F.col("__cut"))).select(*df.columns)  # at most rows / n keys
    w = W.partitionBy(*key).orderBy(digest)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def merge_agreeing(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(distinct rows of keys without conflict, keys whose rows disagree)."""
    distinct = df.distinct()
    conflicts = distinct.groupBy(*key).agg(F.count("*").alias("n_versions")).where("n_versions > 1")
    return distinct.join(conflicts, key, "left_anti"), conflicts
