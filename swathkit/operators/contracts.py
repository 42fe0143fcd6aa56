"""Fail-closed contracts on DataFrames: each check is one aggregate, nothing is collected but counts."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A frame breaks a declared rule."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError("missing columns: " + ", ".join(missing))
    return df


def require_exact_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns and no others, as for public outputs."""
    if set(df.columns) != set(columns) or len(df.columns) != len(columns):
        raise ContractError(f"columns must be {sorted(columns)}, not {sorted(df.columns)}")
    return df.select(*columns)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    if not duplicate_keys(df, key).isEmpty():
        raise ContractError(f"repeated keys in {key}")
    return df


def require_finite(df: DataFrame, columns: list[str], nulls: bool = False) -> DataFrame:
    """Neither NaN nor infinite nor, unless nulls are allowed, null."""
    wrong = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    bad = [F.count_if((F.lit(False) if nulls else F.col(c).isNull()) | F.coalesce(wrong(F.col(c).cast("double")), F.lit(False))).alias(c) for c in columns]
    if broken := {c: n for c, n in df.agg(*bad).first().asDict().items() if n}:
        raise ContractError(f"missing values: {broken}")
    return df


def require_count(df: DataFrame, expected: int) -> DataFrame:
    if (n := df.count()) != expected:
        raise ContractError(f"{n} rows, expected {expected}")
    return df


def require_empty(df: DataFrame, what: str) -> None:
    if not df.isEmpty():
        raise ContractError(what)


def require_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that must hold nothing, as outcomes of held-out rows."""
    filled = df.agg(*(F.count(c).alias(c) for c in columns)).first().asDict()
    if any(filled.values()):
        raise ContractError(f"values where none may be: {filled}")
    return df


def readiness(checks: DataFrame) -> DataFrame:
    """Of rows (name, observed, expected): one row with counts and whether all agree."""
    ok = F.col("observed").eqNullSafe(F.col("expected"))
    return checks.agg(
        F.count("*").alias("n_checks"), F.count_if(ok).alias("n_passed"),
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("ready"),
        F.concat_ws("|", F.array_sort(F.collect_list(F.when(~ok, F.col("name"))))).alias("failed"),
    )


def guarded_path(root: str, relative: str, forbidden: tuple[str, ...] = ()) -> str:
    """A path below root; refuses absolute paths, steps upward and forbidden name parts."""
    path = PurePosixPath(relative)
    if path.is_absolute() or ".." in path.parts or not path.parts:
        raise ContractError(f"unsafe path {relative!r}")
    if hit := [x for x in forbidden if any(x in part.lower() for part in path.parts)]:
        raise ContractError(f"path {relative!r} holds {hit}")
    return str(PurePosixPath(root) / path)
