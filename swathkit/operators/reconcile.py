"""Checks of one table against another that name what disagrees, row by row; nothing is collected."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal up to the tolerance, relative to the larger and at least one; both null is equal."""
    near = F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    return (a.isNull() & b.isNull()) | F.coalesce(near, F.lit(False))


def _sides(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Full join on the key; columns of the sides are a_* and b_*, __a and __b say which side has the row."""
    named = lambda df, s: df.select(
        *(F.col(k).alias(f"__{s}_{k}") for k in key), *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in key), F.lit(True).alias(f"__{s}")
    )
    a, b = named(left, "a"), named(right, "b")
    met = a.join(b, functools.reduce(operator.and_, (F.col(f"__a_{k}").eqNullSafe(F.col(f"__b_{k}")) for k in key)), "full")
    return met.select(*(F.when(F.col("__a"), F.col(f"__a_{k}")).otherwise(F.col(f"__b_{k}")).alias(k) for k in key), *(c for c in met.columns if not c.startswith(("__a_", "__b_"))))


def compared(recorded: DataFrame, recomputed: DataFrame, key: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """key, recorded, recomputed and status: ok, differs, missing (recorded only) or extra (recomputed only); keys are unique."""
    both = _sides(recorded.select(*key, value), recomputed.select(*key, value), key)
    a, b = F.col(f"a_{value}"), F.col(f"b_{value}")
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(_close(a, b, tolerance), "ok").otherwise("differs")
    return both.select(*key, a.alias("recorded"), b.alias("recomputed"), status.alias("status"))


def scope(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """key and status of every declared or found cell: ok, missing (declared, not found) or extra."""
    both = _sides(expected.select(*key).distinct(), found.select(*key).distinct(), key)
    return both.select(*key, F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").otherwise("ok").alias("status"))


def estimates(released: DataFrame, precision: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Released estimates against independently computed precision: key, failed (criteria joined by /, '' if none hold against it).

    released: gradient, cooling, se, low, high, n_cells, n_blocks; precision: se, width, requested, estimable, failed,
    n_cells, n_blocks. A key on one side only fails as `missing`.
    """
    both = _sides(released, precision, key)
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    true = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "sign": _close(a("gradient"), -a("cooling"), tolerance) & a("gradient").isNotNull(),
        "interval": true((a("low") <= a("high")) & (a("se") >= 0)),
        "se": _close(a("se"), b("se"), tolerance),
        "width": _close(a("high") - a("low"), b("width"), tolerance),
        "draws": true((b("requested") == b("estimable") + b("failed")) & (b("failed") >= 0) & (b("estimable") >= 2)),
        "population": true((a("n_cells") == b("n_cells")) & (a("n_blocks") == b("n_blocks"))),
    }
    failed = F.concat_ws("/", *(F.when(~ok, F.lit(name)) for name, ok in rules.items()))
    return both.select(*key, F.when(F.col("__a").isNull() | F.col("__b").isNull(), "missing").otherwise(failed).alias("failed"))


def chained_pages(pages: DataFrame, key: list[str]) -> DataFrame:
    """Pages of listings continued by a token (key, page, items, after, hits): n, chained and complete of each page.

    chained: the token is the last item of some page, or the page is the listing's first and has none; complete: the items
    of all pages of the listing are as many as each page announced.
    """
    rows = pages.select(*key, "page", "after", "hits", F.size("items").cast("bigint").alias("n"), F.array_max("items").alias("last"))
    whole = rows.groupBy(*key).agg(F.sum("n").alias("__got"), F.min("hits").alias("__low"), F.max("hits").alias("__high"), F.min("page").alias("__first"))
    ends = rows.select(*key, F.col("last").alias("after")).distinct().withColumn("__there", F.lit(True))
    met = rows.join(ends, [*key, "after"], "left").join(whole, key)
    first = F.col("after").isNull() & (F.col("page") == F.col("__first"))
    complete = (F.col("__got") == F.col("__low")) & (F.col("__got") == F.col("__high"))
    return met.select(*key, "page", "n", "after", (first | F.coalesce("__there", F.lit(False))).alias("chained"), complete.alias("complete"))
