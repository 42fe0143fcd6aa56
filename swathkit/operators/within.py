"""Within-group (fixed-effect) regression from per-group moments.

One pass over the cells gives each group's centred cross products; everything else - the fit, its clustered
standard error, bootstrap refits, information shares - needs only those moments, which are one row per group.
Only sums over groups, a few numbers, come to the driver.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from swathkit.operators import resampling, tsqr
from swathkit.operators.contracts import ContractError, require_columns, require_finite
from swathkit.sources.files import written

def centred_products(df: DataFrame, block: str, predictors: list[str], outcomes: list[str], weight: str | None = None, also: list[str] | None = None) -> DataFrame:
    """Per block: n, w, xx_i_j (i <= j) and xy_i_k: weighted sums of products of values centred on the block's means."""
    w = F.col(weight) if weight else F.lit(1.0)
    sw = F.sum(w)

    def product(a: str, b: str) -> Column:
        """sum(w a b) - sum(w a) sum(w b) / sum(w); covar_pop is the stable form without weights."""
        if not weight:
            return F.covar_pop(a, b) * F.count("*")
        return F.sum(w * F.col(a) * F.col(b)) - F.sum(w * F.col(a)) * F.sum(w * F.col(b)) / sw

    aggs = [F.count("*").alias("n"), sw.alias("w")]
    aggs += [F.first(c).alias(c) for c in also or []]
    aggs += [product(predictors[i], predictors[j]).alias(f"xx_{i}_{j}") for i, j in combinations_with_replacement(range(len(predictors)), 2)]
    aggs += [product(p, o).alias(f"xy_{i}_{k}") for i, p in enumerate(predictors) for k, o in enumerate(outcomes)]
    return df.groupBy(block).agg(*aggs)


@dataclass
class Moments:
    """Moments by group: a written table (g, n, blocks, xx_i_j, xy_i_k), a row per group, and their sums."""

    table: DataFrame
    predictors: list[str]
    outcomes: list[str]

    @functools.cached_property
    def names(self) -> list[str]:
        return [c for c in self.table.columns if c.startswith(("xx_", "xy_"))]

    @functools.cached_property
    def sums(self) -> Row:
        return self.table.agg(F.count("*").alias("groups"), *(F.sum(c).alias(c) for c in ("n", "blocks", *self.names))).first()

    @property
    def total(self) -> tuple[np.ndarray, np.ndarray]:
        p, k = len(self.predictors), len(self.outcomes)
        value = lambda c: float(self.sums[c] or 0.0)
        xx = np.array([[value(f"xx_{min(i, j)}_{max(i, j)}") for j in range(p)] for i in range(p)])
        return xx, np.array([[value(f"xy_{i}_{o}") for o in range(k)] for i in range(p)])


def gather(products: DataFrame, group: str, predictors: list[str], outcomes: list[str]) -> Moments:
    """Block moments summed by group (blocks may not cross groups), written for the passes that follow."""
    names = [c for c in products.columns if c.startswith(("xx_", "xy_"))]
    summed = products.groupBy(F.col(group).cast("string").alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), *(F.sum(c).alias(c) for c in names))
    return Moments(written(summed, "moments"), predictors, outcomes)


SURE = 1e-6  #: a pivot of X'X (for columns of length one) above which its columns are surely independent


def clearly_independent(xx: np.ndarray) -> bool:
    """Whether X'X alone shows that no column depends on the others; it holds half the digits, so a small pivot says nothing."""
    norms = np.sqrt(np.diag(xx))
    if (norms <= 1e-12).any():
        return False
    values = np.linalg.eigvalsh(xx / np.outer(norms, norms))
    return bool(values[0] > SURE)


def centred_rows(df: DataFrame, block: str, columns: list[str], weight: str | None = None, also: list[str] | None = None) -> DataFrame:
    """Rows with the columns less their (weighted) block means, times the root of the weight; block and `also` are kept."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    means = df.groupBy(block).agg(*((F.sum(w * F.col(c)) / F.sum(w)).alias(f"__m_{c}") for c in columns))
    return df.join(means, block).select(block, *(also or []), *(((F.col(c) - F.col(f"__m_{c}")) * F.sqrt(w)).alias(c) for c in columns))


def fit_by_qr(df: DataFrame, block: str, group: str, predictors: list[str], outcomes: list[str], weight: str | None = None) -> Fit:
    """fit() by another way: QR factors of the centred rows in place of sums of products; ranks are decided on R.

    Two passes over the written rows: the factors, then the influence of each group on the first coefficient.
    """
    rows = written(centred_rows(df, block, [*predictors, *outcomes], weight, [group] if group != block else None), "centred")
    r = tsqr.r_factor(rows, [*predictors, *outcomes])
    keep = tsqr.independent(r[:, : len(predictors)])
    beta, first = tsqr.solve(r, keep, len(outcomes))
    names = [predictors[i] for i in keep]
    along = sum((F.col(c) * float(v) for c, v in zip(names, first, strict=True)), F.lit(0.0))
    left = [F.col(o) - sum((F.col(c) * float(b) for c, b in zip(names, beta[:, k], strict=True)), F.lit(0.0)) for k, o in enumerate(outcomes)]
    by = rows.groupBy(group).agg(F.count("*").alias("n"), *(F.sum(along * e).alias(f"s{k}") for k, e in enumerate(left)))
    total = by.agg(F.count("*").alias("g"), F.sum("n").alias("n"), *(F.sum(F.col(f"s{k}") * F.col(f"s{k}")).alias(f"m{k}") for k in range(len(outcomes)))).first()
    blocks = df.select(block).distinct().count()
    groups, n = int(total["g"]), int(total["n"] or 0)
    dof = n - blocks - len(keep)
    if groups < 2 or dof <= 0:
        raise ContractError("too few groups or residual degrees of freedom")
    se = np.sqrt(np.array([float(total[f"m{k}"]) for k in range(len(outcomes))]) * groups / (groups - 1) * (n - 1) / dof)
    removed = [c for i, c in enumerate(predictors) if i not in keep]
    return Fit(names, beta, se, {"n": n, "blocks": blocks, "groups": groups, "rank": len(keep), "dof": dof, "removed": removed})


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray  # (p, k)
    cluster_se: np.ndarray  # (k,)
    diagnostics: dict


def fit(m: Moments) -> Fit:
    """Weighted fixed-effect OLS with clustered standard errors of the first predictor, of independent predictors.

    Two aggregates over the groups: their sums, then the squares of the first coefficient's influence.
    """
    xx_all, xy_all = m.total
    keep = list(range(len(m.predictors)))
    if not clearly_independent(xx_all):
        raise ContractError("predictors may depend on each other: fit_frame() decides that on the rows")
    norms = np.sqrt(np.diag(xx_all))[keep]
    inverse = np.linalg.inv(xx_all[np.ix_(keep, keep)] / np.outer(norms, norms)) / np.outer(norms, norms)
    beta = inverse @ xy_all[keep]
    groups, n, p = int(m.sums["groups"]), int(m.sums["n"]), len(keep)
    dof = n - int(m.sums["blocks"]) - p
    if groups < 2 or dof <= 0:
        raise ContractError("too few groups or residual degrees of freedom")

    def influence(o: int) -> Column:
        """inverse[0] . (xy_g - xx_g beta)"""
        score = [
            F.col(f"xy_{i}_{o}") - sum((F.col(f"xx_{min(i, j)}_{max(i, j)}") * float(beta[b, o]) for b, j in enumerate(keep)), F.lit(0.0)) for i in keep
        ]
        return sum((score[a] * float(inverse[0, a]) for a in range(p)), F.lit(0.0))

    squares = m.table.agg(*(F.sum(F.pow(influence(o), F.lit(2.0))).alias(f"m{o}") for o in range(len(m.outcomes)))).first()
    factor = groups / (groups - 1) * (n - 1) / dof
    se = np.sqrt(np.array([float(squares[f"m{o}"]) for o in range(len(m.outcomes))]) * factor)
    return Fit(
        [m.predictors[i] for i in keep], beta, se,
        {"n": n, "blocks": int(m.sums["blocks"]), "groups": groups, "rank": p, "dof": dof, "removed": [c for c in m.predictors if c not in {m.predictors[i] for i in keep}]},
    )


def bootstrap_table(m: Moments, replicates: int, seed: int, keep: list[int] | None = None) -> DataFrame:
    """rep, outcome, coef of whole-group multinomial refits; coef is null where a draw is rank-deficient."""
    sums = resampling.resampled_sums(m.table, "g", m.names, replicates, seed)
    return resampling.coefficients(sums, len(m.predictors), len(m.outcomes), keep)


def joint_bootstrap(populations: list[Moments], replicates: int, seed: int) -> DataFrame:
    """rep, population, outcome, coef under one multiplicity of each group for all populations (absent groups add nothing)."""
    both, names = None, []
    for j, m in enumerate(populations):
        own = m.table.select("g", *(F.col(c).alias(f"p{j}_{c}") for c in m.names))
        names += [f"p{j}_{c}" for c in m.names]
        both = own if both is None else both.join(own, "g", "full")
    sums = written(resampling.resampled_sums(both, "g", names, replicates, seed), "joint")
    parts = [
        resampling.coefficients(sums, len(m.predictors), len(m.outcomes), prefix=f"p{j}_").withColumn("population", F.lit(j)) for j, m in enumerate(populations)
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def fit_frame(df: DataFrame, block: str, group: str, predictors: list[str], outcomes: list[str], weight: str | None = None) -> tuple[Fit, Moments]:
    """Check, aggregate and fit; group may equal block, otherwise a block lies in one group.

    Where the products leave open whether predictors depend on each other, the rows decide: fit_by_qr().
    """
    require_columns(df, [block, group, *predictors, *outcomes, *([weight] if weight else [])])
    require_finite(df, [*predictors, *outcomes])
    products = centred_products(df, block, predictors, outcomes, weight, [group] if group != block else None)
    m = gather(products, group, predictors, outcomes)
    return (fit(m) if clearly_independent(m.total[0]) else fit_by_qr(df, block, group, predictors, outcomes, weight)), m
