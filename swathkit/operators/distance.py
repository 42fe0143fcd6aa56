"""Exact Euclidean distance of grid cells to the nearest target cell, at any distance.

Two passes of lines. Along columns, strips of STRIP columns find each row's distance to the nearest target of its column;
they hand tiles (strip of columns x strip of rows) to the rows' strips. Along rows, the lower envelope of the parabolas
(x - column)^2 + that distance^2 gives each cell's least squared distance. A task holds one strip of columns, or one
strip of rows with the columns that have targets; there is no reach, and no cell meets a list of targets.

x and y are whole numbers. Cells may repeat and lie anywhere; each keeps its row. Null coordinates, and cells of a table
without targets, have a null distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.operators.select import spread

STRIP = 128  #: lines of a strip


def column_distances(targets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distance of each row to the nearest of a column's sorted target rows."""
    right = np.searchsorted(targets, rows)
    below, above = targets[np.maximum(right - 1, 0)], targets[np.minimum(right, len(targets) - 1)]
    return np.minimum(np.abs(rows - below), np.abs(above - rows))


def envelope(columns: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line (row of height): places of the parabolas on the lower envelope, where each begins, and how many.

    columns (C) ascending; height (R, C) of the parabolas at their columns. All lines advance together.
    """
    n, m = height.shape
    line = np.arange(n)
    place, begins, top = np.zeros((n, m), np.int64), np.full((n, m), -np.inf), np.zeros(n, np.int64)
    for j in range(1, m):
        open_ = np.ones(n, bool)
        at = np.empty(n)
        while open_.any():
            some = line[open_]
            i = place[some, top[some]]
            at[some] = (height[some, j] - height[some, i] + (columns[j] ** 2 - columns[i] ** 2)) / (2.0 * (columns[j] - columns[i]))
            covered = (at[some] <= begins[some, top[some]]) & (top[some] > 0)
            top[some[covered]] -= 1
            open_[some[~covered]] = False
        top += 1
        place[line, top], begins[line, top] = j, at
    return place, begins, top + 1


def distance_to_nearest(cells: DataFrame, targets: DataFrame, x: str = "x", y: str = "y", name: str = "distance", size: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """cells with the distance of their centre to the nearest target's centre; size: width and height of a cell."""
    width, height = size
    strip = lambda c: F.floor(F.col(c) / STRIP).cast("bigint")
    there = targets.select(F.col(x).cast("bigint").alias("tx"), F.col(y).cast("bigint").alias("ty")).where("tx is not null and ty is not null").distinct()
    rows = [r[0] for r in cells.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(strip(y)).distinct().collect()]  # one per STRIP lines
    wanted = np.array(sorted(rows), np.int64)

    def along_columns(frame: pd.DataFrame) -> pd.DataFrame:
        lines = (wanted[:, None] * STRIP + np.arange(STRIP)).ravel()
        own = frame.sort_values(["tx", "ty"])
        columns, first = np.unique(own["tx"].to_numpy(), return_index=True)
        ends = np.r_[first[1:], len(own)]
        ty = own["ty"].to_numpy()
        g = np.stack([column_distances(ty[a:b], lines) for a, b in zip(first, ends, strict=True)]).astype(np.int64)
        tiles = g.reshape(len(columns), len(wanted), STRIP)
        packed = [tiles[:, k].tobytes() for k in range(len(wanted))]
        return pd.DataFrame({"__rows": wanted, "columns": [columns.tobytes()] * len(wanted), "tile": packed})

    tiles = there.groupBy(F.floor(F.col("tx") / STRIP).alias("s")).applyInPandas(along_columns, "__rows bigint, columns binary, tile binary")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in cells.dtypes), f"`{name}` double"])

    def along_rows(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        out = np.full(len(own), np.nan)
        own = own.drop(columns="__rows")
        known = own[x].notna() & own[y].notna() if len(parts) else np.zeros(len(own), bool)
        known = np.asarray(known)
        if known.any():
            columns = np.concatenate([np.frombuffer(c, np.int64) for c in parts["columns"]])
            order = np.argsort(columns)
            g = np.concatenate([np.frombuffer(t, np.int64).reshape(-1, STRIP) for t in parts["tile"]])[order]
            columns = columns[order].astype(float) * width
            place, begins, n = envelope(columns, (g.T * height) ** 2.0)
            qx, line = own[x].to_numpy(float)[known] * width, own[y].to_numpy(np.int64)[known] % STRIP
            found = np.empty(len(qx))
            for k in np.unique(line):
                some = line == k
                near = place[k, np.searchsorted(begins[k, : n[k]], qx[some], "right") - 1]
                found[some] = np.hypot(qx[some] - columns[near], g[near, k] * height)
            out[known] = found
        return own.assign(**{name: np.where(np.isnan(out), None, out)})

    dealt = cells.withColumn("__rows", F.coalesce(strip(y), F.lit(0)))
    return spread(dealt, "__rows").groupBy("__rows").cogroup(spread(tiles, "__rows").groupBy("__rows")).applyInPandas(along_rows, schema)
