"""Registry of queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by name; timestamps without a zone are read as UTC instants."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})

    @property
    def cells(self) -> DataFrame:
        """Line items as grid cells: unique id, block, group, pass (month), predictor in [0, 1], outcome, covariates."""
        t = self.lineitem
        return t.select(
            F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
                        F.unix_seconds("l_shipdate").cast("string")).alias("cell_id"),
            F.col("l_suppkey").alias("block"),
            F.floor(F.col("l_suppkey") / 8).alias("grp"),
            F.date_format("l_shipdate", "yyyy-MM").alias("pass"),
            F.col("l_discount").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_tax").alias("tax"),
            (F.col("l_quantity") / 50).alias("qty"), F.col("l_partkey").alias("word"),
        )

    @property
    def passes(self) -> DataFrame:
        return self.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")

    @property
    def hourly(self) -> DataFrame:
        """Mean value per hour of all other events."""
        return (
            self.events.where("event_type <> 'purchase'")
            .groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v"))
        )


CELLS = """(SELECT concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
 CAST(l_suppkey AS VARCHAR), CAST(CAST(epoch(l_shipdate) AS BIGINT) AS VARCHAR)) AS cell_id, l_suppkey AS block,
 CAST(floor(l_suppkey / 8.0) AS BIGINT) AS grp, strftime(l_shipdate, '%Y-%m') AS pass, l_discount AS x,
 l_extendedprice AS y, l_tax AS tax, l_quantity / 50 AS qty, l_partkey AS word FROM lineitem)"""
PASSES = "(SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase')"
HOURLY = "(SELECT date_trunc('hour', ts) AS hour, avg(value) AS v FROM events WHERE event_type <> 'purchase' GROUP BY 1)"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under a name, with its SQL."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql.replace("{cells}", CELLS).replace("{passes}", PASSES).replace("{hourly}", HOURLY)
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, for comparison with SQL."""
    return df.select(*(F.round(c, digits).alias(c) if k in ("double", "float") and c not in skip else F.col(c) for c, k in df.dtypes))
