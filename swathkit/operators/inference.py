"""Small-sample regression, intervals, diagnostics and simulation."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.operators.select import spread


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@functools.cache
def t_quantile(p: float, df: float) -> float:
    """Student-t quantile by bisection of the distribution function."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1e8
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - 0.5 * beta_cdf(df / 2, 0.5, df / (df + mid * mid)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def normal_equations(df: DataFrame, predictors: list[str], outcome: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X (with an intercept first), X'y, y'y and n, by one aggregate."""
    cols = ["1", *predictors]
    term = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    aggs = [F.sum(term(a) * term(b)) for i, a in enumerate(cols) for b in cols[i:]] + [F.sum(term(a) * F.col(outcome)) for a in cols]
    row = list(df.agg(*aggs, F.sum(F.col(outcome) * F.col(outcome)), F.count("*")).first())
    p = len(cols)
    xx = np.zeros((p, p))
    xx[np.triu_indices(p)] = row[: p * (p + 1) // 2]
    xx = xx + np.triu(xx, 1).T
    return xx, np.array(row[p * (p + 1) // 2 : -2]), float(row[-2]), int(row[-1])


def ols(df: DataFrame, predictors: list[str], outcome: str) -> dict:
    """Coefficients, standard errors, residual sd, t limits of an OLS with intercept."""
    xx, xy, yy, n = normal_equations(df, predictors, outcome)
    p = len(xx)
    if n <= p or np.linalg.matrix_rank(xx) < p:
        raise ValueError("insufficient degrees of freedom or rank")
    inverse = np.linalg.inv(xx)
    beta = inverse @ xy
    variance = max(0.0, yy - beta @ xy) / (n - p)
    se = np.sqrt(np.diag(inverse) * variance)
    t = t_quantile(0.975, n - p)
    return {"terms": ["intercept", *predictors], "coef": beta, "se": se, "low": beta - t * se, "high": beta + t * se, "sigma2": variance, "inverse": inverse, "dof": n - p, "t": t}


def predict_interval(df: DataFrame, model: dict) -> DataFrame:
    """Adds mean, low and high of an individual prediction as columns built from the model's numbers."""
    x: list[Column] = [F.lit(1.0), *(F.col(c).cast("double") for c in model["terms"][1:])]
    mean = sum((F.lit(float(b)) * c for b, c in zip(model["coef"], x, strict=True)), F.lit(0.0))
    quad = sum((F.lit(float(model["inverse"][i, j])) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    half = F.lit(float(model["t"] * math.sqrt(model["sigma2"]))) * F.sqrt(1 + quad)
    return df.withColumns({"mean": mean, "low": mean - half, "high": mean + half})


def interval_summary(draws: DataFrame, key: list[str], value: str) -> DataFrame:
    """q025, q975, sd (n - 1) and counts of draws per key; failed (null or NaN) draws are counted, not replaced."""
    good = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(good, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*key).agg(q[0].alias("q025"), q[1].alias("q975"), F.stddev_samp(good).alias("se"), F.count(good).alias("estimable"), F.count("*").alias("requested"))


def coverage(df: DataFrame, key: list[str], target: Column) -> DataFrame:
    """Share of intervals [low, high] that hold the target, its Monte-Carlo error, mean width and bias of `point`."""
    ok = F.col("low").isNotNull() & F.col("high").isNotNull() & F.col("point").isNotNull()
    covered = F.when(ok, target.between(F.col("low"), F.col("high")).cast("double"))
    p = F.avg(covered)
    return df.groupBy(*key).agg(
        F.count_if(ok).alias("estimable"), p.alias("coverage"), F.sqrt(p * (1 - p) / F.count_if(ok)).alias("coverage_mcse"),
        F.avg(F.when(ok, F.col("high") - F.col("low"))).alias("mean_width"), F.avg(F.when(ok, F.col("point") - target)).alias("bias"),
    )


def gram(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """Correlation matrix of columns and n, by one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = list(df.agg(F.count("*"), *(F.corr(columns[i], columns[j]) for i, j in pairs)).first())
    out = np.eye(len(columns))
    for (i, j), r in zip(pairs, row[1:], strict=True):
        out[i, j] = out[j, i] = r
    return out, row[0]


def collinearity(df: DataFrame, columns: list[str]) -> tuple[float, int, dict[str, float]]:
    """Condition index of the standardised design, its rank, and the VIF of each column (inf if dependent)."""
    r, _ = gram(df, columns)
    values = np.linalg.eigvalsh(r)
    rank = int((values > 1e-10 * values.max()).sum())
    index = float(np.sqrt(values.max() / max(values.min(), 1e-300)))
    inverse = np.diag(np.linalg.inv(r)) if rank == len(columns) else np.full(len(columns), np.inf)
    return index, rank, dict(zip(columns, map(float, inverse), strict=True))


def ridge_loo(pdf: pd.DataFrame, outcome: str, predictors: list[str], knots: int = 4, penalty: float = 1.0) -> float:
    """Leave-one-out R2 of a spline ridge whose scaler is refitted in each fold."""
    parts = []
    for c in predictors:
        x = pdf[c].to_numpy(float)
        parts.append(x[:, None])
        for k in np.quantile(x, np.linspace(0, 1, knots)[1:-1]):
            parts.append(np.maximum(x - k, 0)[:, None] ** 3)
    x, y = np.hstack(parts), pdf[outcome].to_numpy(float)
    miss = np.empty(len(y))
    for i in range(len(y)):
        rest = np.arange(len(y)) != i
        m, s = x[rest].mean(axis=0), x[rest].std(axis=0)
        s[s == 0] = 1
        z, c = (x[rest] - m) / s, y[rest].mean()
        beta = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ (y[rest] - c))
        miss[i] = y[i] - c - ((x[i] - m) / s) @ beta
    return float(1 - (miss**2).sum() / ((y - y.mean()) ** 2).sum())


def concurvity(df: DataFrame, key: list[str], outcome: str, predictors: list[str]) -> DataFrame:
    """Leave-one-out R2 per key (groups are passes of a city: tens to hundreds of rows)."""
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in key), "n bigint", "r2 double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r2 = ridge_loo(pdf, outcome, predictors) if len(pdf) > 3 else float("nan")
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in key), len(pdf), r2]], columns=[*key, "n", "r2"])

    return spread(df.select(*key, outcome, *predictors), *key).groupBy(*key).applyInPandas(run, schema)


CHUNK_ROWS = 1 << 16  #: rows of whole groups that are fitted side by side


def whole_groups(frames: Iterator[pd.DataFrame], key: list[str], rows: int = CHUNK_ROWS) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames sorted by key as frames of whole groups, of about `rows` rows or one group, each with the row where a group starts."""

    def heads(f: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(f), bool)
        for c in key:
            own, null = f[c].to_numpy(), f[c].isna().to_numpy()
            new[1:] |= ~((own[1:] == own[:-1]) | (null[1:] & null[:-1]))
        new[:1] = True
        return np.flatnonzero(new)

    held, n, least = [], 0, rows
    for f in frames:
        held, n = [*held, f], n + len(f)
        if n >= least:
            f = pd.concat(held, ignore_index=True)
            first = heads(f)
            if len(first) > 1:  # the last group may go on
                yield f.iloc[: first[-1]], first[:-1]
                f = f.iloc[first[-1] :]
            held, n = [f], len(f)
            least = max(rows, 2 * n)
    if n:
        f = pd.concat(held, ignore_index=True)
        yield f, heads(f)


class Segments:
    """Rows that lie group after group; first is where each group starts."""

    def __init__(self, first: np.ndarray, rows: int):
        self.first, self.n = first, np.diff(np.r_[first, rows])
        self.of = np.repeat(np.arange(len(first)), self.n)

    @classmethod
    def of_groups(cls, of: np.ndarray) -> Segments:
        return cls(np.flatnonzero(np.r_[len(of) > 0, of[1:] != of[:-1]]), len(of))

    def sum(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.first) if len(self.first) else v[:0]

    def span(self, v: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(v, self.first) - np.minimum.reduceat(v, self.first) if len(self.first) else v[:0]


def group_fits(d: list[np.ndarray], v: np.ndarray, by: Segments) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Least squares of v on the columns d in each group: whether the design has full rank, an orthonormal basis, coefficients.

    Gram-Schmidt, twice, with the sums of all groups side by side.
    """
    p, groups = len(d), len(by.first)
    q, r, fine = [c.astype(float) for c in d], np.zeros((p, p, groups)), by.n > p
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):  # of groups without full rank
        for j in range(p):
            for _ in range(2):
                for i in range(j):
                    along = by.sum(q[i] * q[j])
                    r[i, j] += along
                    q[j] -= along[by.of] * q[i]
            r[j, j] = np.sqrt(by.sum(q[j] * q[j]))
            fine &= ~(r[j, j] <= 1e-12 * np.sqrt(by.sum(d[j] * d[j])))
            q[j] /= r[j, j][by.of]
        beta = np.zeros((p, groups))
        for j in reversed(range(p)):
            beta[j] = (by.sum(q[j] * v) - (r[j, j + 1 :] * beta[j + 1 :]).sum(axis=0)) / r[j, j]
    return fine, q, beta


def neighbour_moran(e: np.ndarray, gx: np.ndarray, gy: np.ndarray, by: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Moran's I of each group over pairs of cells one step apart along a row or column, and how many pairs; NaN without one.

    Cells of one place all pair with those of the next: sums and counts by place stand for the weights' matrix. Cells with
    a NaN for a place pair with none.
    """
    z = e - (by.sum(e) / by.n)[by.of]
    some = np.flatnonzero(~(np.isnan(gx) | np.isnan(gy)))
    order = some[np.lexsort((gy[some], gx[some], by.of[some]))]
    x, y, g = gx[order], gy[order], by.of[order]
    first = np.flatnonzero(np.r_[len(g) > 0, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (g[1:] != g[:-1])])
    place = Segments(first, len(g))
    total, n, x, y, g = place.sum(z[order]), place.n, x[first], y[first], g[first]
    products, pairs = np.zeros(len(by.first)), np.zeros(len(by.first))
    for way, (same, on) in ((np.arange(len(g)), (x, y)), (np.lexsort((x, y, g)), (y, x))):
        a, b = way[:-1], way[1:]  # the place after a in its line
        met = (g[a] == g[b]) & (same[a] == same[b]) & (on[b] == on[a] + 1)
        a, b = a[met], b[met]
        products += np.bincount(g[a], total[a] * total[b], len(by.first))
        pairs += np.bincount(g[a], n[a] * n[b], len(by.first))
    spread = by.sum(z * z)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((pairs > 0) & (spread > 0), by.n * products / (pairs * spread), np.nan), pairs.astype(np.int64)


def jackknife_errors(d: list[np.ndarray], v: np.ndarray, quadrant: np.ndarray, by: Segments) -> np.ndarray:
    """Error of the second coefficient of each group, from fits that leave out one quadrant; NaN if one of them has no fit."""
    order = np.lexsort((quadrant, by.of))
    new = np.r_[len(order) > 0, quadrant[order][1:] != quadrant[order][:-1]]
    new[by.first] = True
    place = np.cumsum(new)
    number = np.empty(len(order), np.int64)
    number[order] = place - place[by.first][by.of]  # of a row's quadrant among those of its group
    many = np.zeros(len(by.first), np.int64)
    np.maximum.at(many, by.of, number + 1)
    slopes = np.full((int(many.max(initial=0)), len(by.first)), np.nan)
    for k in range(len(slopes)):
        rest = np.flatnonzero((number != k) & (many > k)[by.of])
        own = by.of[rest]
        part = Segments.of_groups(own)
        fine, _, beta = group_fits([c[rest] for c in d], v[rest], part)
        slopes[k, own[part.first[fine]]] = beta[1, fine]
    used = np.arange(len(slopes))[:, None] < many
    mean = np.where(used, slopes, 0).sum(axis=0) / many
    error = np.sqrt((many - 1) * (np.where(used, slopes - mean, 0) ** 2).sum(axis=0) / many)
    return np.where(many > 1, error, np.nan)


def block_pass_fits(
    df: DataFrame, key: list[str], x: str, y: str, context: list[str], quadrant: str, place: tuple[str, str], least: int = 20, span: float = 0.08
) -> DataFrame:
    """OLS slope per block and pass with a leave-one-quadrant-out jackknife error, leverage and Moran's I of the residuals.

    leverage is the largest diagonal of the hat matrix, high_leverage whether it exceeds max(0.25, 2 p / n); reason says
    which gate failed. A group is one block in one pass, a few hundred cells; all groups of a chunk are fitted together, so
    the cost is that of the rows, not of a call for each group.
    """
    kinds = "n bigint, slope double, jackknife_se double, leverage double, high_leverage boolean, moran double, n_pairs bigint, reason string"
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in key), kinds])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, first in whole_groups(frames, key):
            yield fitted(f, Segments(first, len(f)))

    def fitted(f: pd.DataFrame, every: Segments) -> pd.DataFrame:
        out = f.iloc[every.first][key].reset_index(drop=True).assign(n=every.n, n_pairs=0)
        reason = np.where(every.n < least, "few_cells", np.where(every.span(f[x].to_numpy(float)) < span, "narrow_span", None))
        rows = np.flatnonzero((reason == None)[every.of])  # noqa: E711  element by element
        group, by = every.of[rows], Segments.of_groups(every.of[rows])
        d, v = [np.ones(len(rows)), *(f[c].to_numpy(float)[rows] for c in (x, *context))], f[y].to_numpy(float)[rows]
        fine, _, _ = group_fits(d, v, by)
        reason[group[by.first[~fine]]] = "rank"
        kept = fine[by.of]
        rows, d, v, group = rows[kept], [c[kept] for c in d], v[kept], group[kept]
        by = Segments.of_groups(group)
        _, q, beta = group_fits(d, v, by)
        hat = np.maximum.reduceat(sum(c * c for c in q), by.first) if len(rows) else v
        gx, gy = (f[c].to_numpy(float)[rows] for c in place)
        moran, pairs = neighbour_moran(v - sum(c * b[by.of] for c, b in zip(d, beta, strict=True)), gx, gy, by)
        quad = pd.factorize(f[quadrant], use_na_sentinel=False)[0][rows]
        found = {"slope": beta[1], "jackknife_se": jackknife_errors(d, v, quad, by), "leverage": hat, "moran": moran}
        at = group[by.first]
        for c, values in found.items():
            out[c] = np.nan
            out.loc[at, c] = np.where(np.isfinite(values), values, np.nan)
        out["high_leverage"] = pd.array([None] * len(out), "boolean")
        out.loc[at, "high_leverage"] = hat > np.maximum(0.25, 2 * len(d) / by.n)
        out.loc[at, "n_pairs"] = pairs
        return out.assign(reason=reason)

    needed = list(dict.fromkeys([*key, x, y, *context, quadrant, *place]))
    return spread(df.select(*needed), *key).sortWithinPartitions(*key).mapInPandas(run, schema)


def moment_interval(y: np.ndarray, weights: np.ndarray, spatial: np.ndarray, design: np.ndarray) -> tuple[float, float, float]:
    """(low, high, tau2): day variance left after the nuisance design, less the known spatial part, cut at zero."""
    q, _ = np.linalg.qr(design)
    project = np.eye(len(y)) - q @ q.T
    df = len(y) - design.shape[1]
    tau2 = max(0.0, float(y @ project @ y - np.trace(project @ spatial)) / df)
    half = t_quantile(0.975, df) * math.sqrt(max(0.0, float(weights @ spatial @ weights) + tau2 * float(weights @ weights)))
    return float(y @ weights) - half, float(y @ weights) + half, tau2


def trend_moment_interval(n: int, syy: float, sxy: float, sxx: float, first: float, second: float, spatial: float) -> tuple[float, float, float]:
    """moment_interval of the first half's mean less the second's, from centred moments: nuisance a line, spatial part a multiple of the identity."""
    if n < 3:
        raise ValueError("a line leaves no degree of freedom")
    tau2 = max(0.0, (syy - sxy**2 / sxx) / (n - 2) - spatial)
    half = t_quantile(0.975, n - 2) * math.sqrt((spatial + tau2) * (1 / (n // 2) + 1 / (n - n // 2)))
    return first - second - half, first - second + half, tau2
