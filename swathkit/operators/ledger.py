"""Runs that are done unit by unit and go on where they stopped: a ledger of finished units beside their rows.

A run writes the rows of all pending units in one job (an attempt), folders by unit, and only then one ledger row for each
unit: how many rows it has and a digest of them that does not depend on their order. A second call reads the ledger,
checks the digests, and makes what is missing or has changed. A job that dies leaves no ledger rows, so its units are
pending again; its folder is never read. Units without rows are finished too, and are not asked again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "unit string, attempt string, n bigint, digest bigint"


def _stamps(rows: DataFrame, unit: str) -> DataFrame:
    """unit, n and an order-free digest of its rows."""
    names = sorted(c for c in rows.columns if c != unit)
    by = rows.groupBy(F.col(unit).cast("string").alias("unit"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in names)}))").alias("digest"))


class Ledger:
    """Finished units of a run below a folder."""

    def __init__(self, like: DataFrame, path: str, unit: str):
        """like: a frame with the columns of the rows to come."""
        self.spark, self.path, self.unit = like.sparkSession, path.rstrip("/"), unit
        fields = [f for f in like.schema.fields if f.name != unit]
        self.columns, self.kind = like.columns, like.schema[unit].dataType.simpleString()
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/ledger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def _rows(self, entries: DataFrame) -> DataFrame:
        attempts = [r[0] for r in entries.where("n > 0").select("attempt").distinct().collect()]  # one a call
        if not attempts:
            return self.spark.createDataFrame([], f"{self.schema}, unit string, attempt string")
        reader = self.spark.read.schema(f"{self.schema}, attempt string, unit string").option("basePath", f"{self.path}/rows")
        return reader.parquet(*(f"{self.path}/rows/attempt={a}" for a in attempts))

    def finished(self) -> DataFrame:
        """Ledger rows whose rows are still those that were finished."""
        entries = self.entries()
        rows = self._rows(entries).join(entries.select("unit", "attempt"), ["unit", "attempt"], "left_semi")
        held = _stamps(rows.drop("attempt"), "unit").select("unit", F.col("n").alias("__n"), F.col("digest").alias("__d"))
        met = entries.join(held, "unit", "left")
        same = (F.coalesce("__n", F.lit(0)) == F.col("n")) & F.coalesce(F.col("__d") == F.col("digest"), F.col("n") == 0)
        return met.where(same).select(*entries.columns)

    def run(self, units: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of all units; make(pending) gives those of the units that are not finished."""
        wanted = units.select(F.col(self.unit)).distinct()
        named = wanted.withColumn("unit", F.col(self.unit).cast("string"))
        pending = named.join(self.finished().select("unit"), "unit", "left_anti")
        todo = [r[0] for r in pending.select(self.unit).collect()]  # units are passes, years: a list
        if todo:
            attempt = uuid.uuid4().hex
            asked = self.spark.createDataFrame([(u,) for u in todo], f"`{self.unit}` {self.kind}")
            rows = make(asked).select(*self.columns).withColumn("unit", F.col(self.unit).cast("string")).drop(self.unit)
            rows.write.partitionBy("unit").parquet(f"{self.path}/rows/attempt={attempt}")
            entry = asked.select(F.col(self.unit).cast("string").alias("unit"), F.lit(attempt).alias("attempt"))
            own = self._written(attempt)
            done = entry.join(_stamps(own, "unit"), "unit", "left").select("unit", "attempt", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.lit(0)).alias("digest"))
            done.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        finished = self.finished().select("unit", "attempt")
        rows = self._rows(self.entries()).join(finished, ["unit", "attempt"], "left_semi").withColumn(self.unit, F.col("unit").cast(self.kind))
        return rows.join(wanted, self.unit, "left_semi").select(*self.columns)

    def _written(self, attempt: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{self.schema}, unit string").parquet(f"{self.path}/rows/attempt={attempt}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{self.schema}, unit string")
