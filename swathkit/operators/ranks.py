"""Ranks and exact quantiles of keys of any size: no window and no buffer ever holds all rows of a key.

order_table() counts equal values once (so ties are one row and cannot be cut), deals the distinct (key, value) rows to
ranges by Spark's sampled splitters, and adds up counts per range and key; a prefix sum over those few numbers, joined
back, turns places inside a range into places of the key. Ranks, shares and quantiles then are arithmetic, and quantiles
read only the ranges that hold the ranks they want.

Null values have no place; NaN is the largest. Null keys are a key like others. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.sources.files import written


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Null-safe equality of columns, those of b named with two underscores before."""
    return functools.reduce(operator.and_, (a[c].eqNullSafe(b[f"__{c}"]) for c in columns), F.lit(True))


def _renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"__{c}" for c in columns})


@dataclass
class OrderTable:
    """rows: keys, values, n (equal rows), range; parts: keys, range, first (rows of the key in ranges before), held, total."""

    rows: DataFrame
    parts: DataFrame
    keys: list[str]
    order: list[Column]

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with before and total."""
        inside = F.sum("n").over(W.partitionBy(*self.keys, "range").orderBy(*self.order).rowsBetween(W.unboundedPreceding, -1))
        first = _renamed(self.parts.drop("held"), [*self.keys, "range"])
        rows = rows.withColumn("before", F.coalesce(inside, F.lit(0)))
        met = rows.join(first, _same(rows, first, self.keys) & (rows["range"] == first["__range"]))
        return met.withColumn("before", F.col("before") + F.col("first")).drop("first", "range", "__range", *(f"__{k}" for k in self.keys))

    def places(self) -> DataFrame:
        """keys, values, n, before (rows of the key that come earlier) and total (rows of the key)."""
        return self._placed(self.rows)

    def quantiles(self, shares: list[float]) -> DataFrame:
        """keys, share (its place in the list) and q, linearly interpolated; of tables ordered by one value."""
        value = next(c for c in self.rows.columns if c not in (*self.keys, "n", "range"))
        wanted = self.parts.select(*self.keys, "total").distinct().select(*self.keys, "total", F.posexplode(F.array(*(F.lit(float(s)) for s in shares))).alias("share", "at"))
        at = F.col("at") * (F.col("total") - 1)
        ends = F.array(F.struct(F.floor(at).alias("place"), F.lit(0).alias("upper")), F.struct(F.ceil(at).alias("place"), F.lit(1).alias("upper")))
        wanted = _renamed(wanted.select(*self.keys, "share", (at - F.floor(at)).alias("rest"), F.explode(ends).alias("e")), self.keys)
        held = (F.col("e.place") >= F.col("first")) & (F.col("e.place") < F.col("first") + F.col("held"))
        found = self.parts.join(wanted, _same(self.parts, wanted, self.keys) & held)  # a few places of a few ranges
        found = written(found.select(*self.keys, "range", "share", "rest", "e.place", "e.upper"), "places")
        need = _renamed(found.select(*self.keys, "range").distinct(), [*self.keys, "range"])
        some = self.rows.join(need, _same(self.rows, need, self.keys) & (self.rows["range"] == need["__range"]), "left_semi")
        rows, sought = self._placed(some), _renamed(found.drop("range"), self.keys)
        hit = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
        met = rows.join(sought, _same(rows, sought, self.keys) & hit)
        low, high = (F.max(F.when(F.col("upper") == k, F.col(value))) for k in (0, 1))
        ends = met.groupBy(*self.keys, "share", "rest").agg(low.alias("low"), high.alias("high"))
        return ends.select(*self.keys, "share", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("rest")).alias("q"))


def _sorted(order: list[str]) -> list[Column]:
    """Columns in order; a minus before a name turns it round."""
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def _parts(rows: DataFrame, keys: list[str], n: Column) -> DataFrame:
    parts = rows.groupBy(*keys, "range").agg(n.alias("held"))
    w = W.partitionBy(*keys)  # a row a range
    before = F.sum("held").over(w.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    return written(parts.select(*keys, "range", "held", F.coalesce(before, F.lit(0)).alias("first"), F.sum("held").over(w).alias("total")), "ranges")


def order_table(df: DataFrame, keys: list[str], order: list[str]) -> OrderTable:
    """Places of all values of each key. order: value columns, with a minus before the name for a falling order."""
    names = [c.lstrip("-") for c in order]
    counts = df.where(functools.reduce(operator.and_, (F.col(c).isNotNull() for c in names))).groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("n"))
    # written: the splitters are sampled, so a second run could cut elsewhere
    rows = written(counts.repartitionByRange(*(F.asc(k) for k in keys), *_sorted(order)).withColumn("range", F.spark_partition_id()), "ordered")
    return OrderTable(rows, _parts(rows, keys, F.sum("n")), keys, _sorted(order))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, share (place in shares), q: exact, linearly interpolated quantiles of each key."""
    return order_table(df, keys, [value]).quantiles(shares)


def quantile_columns(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each named quantile."""
    q = quantiles(df, keys, value, list(shares.values()))
    return q.groupBy(*keys).agg(*(F.max(F.when(F.col("share") == i, F.col("q"))).alias(c) for i, c in enumerate(shares)))


def placed(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """df with each row's place (0, 1, ..) in the order, which must tell all rows apart; rows keep their columns."""
    rows = written(df.repartitionByRange(*_sorted(order)).withColumn("range", F.spark_partition_id()), "placed")
    parts = _parts(rows, [], F.count(F.lit(1))).select("range", "first")
    inside = F.row_number().over(W.partitionBy("range").orderBy(*_sorted(order))) - 1
    return rows.withColumn(name, inside).join(parts, "range").withColumn(name, F.col(name) + F.col("first")).drop("range", "first")


def ecdf(df: DataFrame, keys: list[str], value: str, name: str = "ecdf") -> DataFrame:
    """df with the share of the key's rows that are no larger; null where the value is."""
    places = order_table(df, keys, [value]).places()
    share = _renamed(places.select(*keys, value, ((F.col("before") + F.col("n")) / F.col("total")).alias(name)), [*keys, value])
    return df.join(share, _same(df, share, [*keys, value]), "left").drop(*(f"__{c}" for c in (*keys, value)))


def rank_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, n, pearson, spearman (null below three rows) over rows where both are there; ties share their mean rank.

    Mean ranks average (n + 1) / 2, so Spearman's is a ratio of sums over the distinct (a, b) of a key.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("__m"))
    for c, name in ((a, "__ra"), (b, "__rb")):
        place = order_table(both, keys, [c]).places()
        away = F.col("before") + (F.col("n") + 1) / 2.0 - (F.col("total") + 1) / 2.0
        rank = _renamed(place.select(*keys, c, away.alias(name)), [*keys, c])
        cells = cells.join(rank, _same(cells, rank, [*keys, c])).drop(*(f"__{k}" for k in (*keys, c)))
    product = lambda x, y: F.sum(F.col("__m") * F.col(x) * F.col(y))
    spearman = product("__ra", "__rb") / F.sqrt(product("__ra", "__ra") * product("__rb", "__rb"))
    rho = cells.groupBy(*keys).agg(F.sum("__m").alias("n"), F.when(F.sum("__m") >= 3, spearman).alias("spearman"))
    r = _renamed(both.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, F.corr(a, b)).alias("pearson")), keys)
    return rho.join(r, _same(rho, r, keys)).select(*keys, "n", "pearson", "spearman")
