"""Convex hulls of groups of any size, and whether two hulls meet.

Each Arrow batch leaves only the hulls of its groups (monotone chain), so what is shuffled does not grow with the rows of
a group but with its hulls' corners; hulls of hulls are merged in two steps, FAN groups and then one. Corners are rows, and
the groups of a chunk are done side by side, so many small groups cost what their rows cost. Two hulls meet
unless an edge's normal parts them; touching counts as meeting. Points and segments are hulls too. Rows with a null
coordinate are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.operators.inference import Segments, whole_groups
from swathkit.operators.select import spread

FAN = 256  #: hulls of the middle step
FEW = 64  #: points of a group whose hull is made side by side with others
PRODUCTS = 1 << 20  #: corners laid along axes at once


def hull(points: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the smallest; points on edges are no corners."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def chain(way: list) -> list:
        out: list = []
        for p in way:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(ordered) + chain(ordered[::-1])


def side_by_side(x: np.ndarray, y: np.ndarray, by: Segments) -> tuple[np.ndarray, np.ndarray]:
    """hull() of each group: the places of the corners, group after group, and how many each group has.

    Points lie in order of (x, y) in each group and none twice. The chains of up to FEW points grow together, a step for all groups.
    """
    large = np.flatnonzero(by.n > FEW)
    corners, owner = [], []
    for k in large.tolist():
        a, b = by.first[k], by.first[k] + by.n[k]
        at = {p: a + i for i, p in enumerate(zip(x[a:b].tolist(), y[a:b].tolist(), strict=True))}
        corners.append(np.array([at[p] for p in hull(at)], np.int64))
        owner.append(np.full(len(corners[-1]), k))
    few = np.flatnonzero(by.n <= 2)
    own = Segments.of_groups(np.repeat(few, by.n[few]))
    corners.append(np.repeat(by.first[few], by.n[few]) + np.arange(len(own.of)) - own.first[own.of])
    owner.append(np.repeat(few, by.n[few]))
    lanes = np.flatnonzero((by.n > 2) & (by.n <= FEW))
    for step in (1, -1):  # below, then above and backwards
        first, n = by.first[lanes], by.n[lanes]
        held, top = np.zeros((len(lanes), int(n.max(initial=0))), np.int64), np.zeros(len(lanes), np.int64)
        for k in range(held.shape[1]):
            on = np.flatnonzero(n > k)
            p = (first + (k if step > 0 else n - 1 - k))[on]
            again = np.arange(len(on))
            while len(again := again[top[on[again]] > 1]):
                lane = on[again]
                o1, o2, q = held[lane, top[lane] - 1], held[lane, top[lane] - 2], p[again]
                again = again[(x[o1] - x[o2]) * (y[q] - y[o2]) <= (y[o1] - y[o2]) * (x[q] - x[o2])]
                top[on[again]] -= 1
            held[on, top[on]] = p
            top[on] += 1
        kept = np.arange(held.shape[1]) < top[:, None] - 1
        corners.append(held[kept])
        owner.append(np.repeat(lanes, kept.sum(axis=1)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(corners)[order], np.bincount(owner, minlength=len(by.first))


def meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the hulls with these corners have a point in common."""
    if not len(a) or not len(b):
        return False
    return bool(all_meet(np.concatenate([a, b]).astype(float), np.array([len(a)]), np.array([len(b)]))[0])


def all_meet(corners: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the two hulls of each pair meet: n_a and then n_b corners, pair after pair, each at least one."""
    sides = np.stack([n_a, n_b], 1).ravel()
    first = np.cumsum(sides) - sides
    turn = np.arange(len(corners)) + 1
    turn[first + sides - 1] = first  # the next corner of the same hull
    along = corners[turn] - corners
    of = np.repeat(np.arange(len(sides)), sides)
    two = np.flatnonzero(sides[of] == 2)
    one = np.flatnonzero((n_a == 1) & (n_b == 1))
    axes = np.concatenate([np.stack([-along[:, 1], along[:, 0]], 1), along[two], corners[first[2 * one + 1]] - corners[first[2 * one]], np.tile(np.eye(2), (len(n_a), 1))])
    pair = np.r_[of // 2, of[two] // 2, one, np.repeat(np.arange(len(n_a)), 2)]
    apart = np.zeros(len(n_a), bool)
    size = (n_a + n_b)[pair]
    done, total = 0, np.cumsum(size)
    while done < len(axes):  # some axes at a time, each with all corners of its pair
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PRODUCTS, "right")))
        own, n = pair[done:stop], size[done:stop]
        at = np.cumsum(n) - n
        point = np.repeat(first[2 * own] - at, n) + np.arange(n.sum())
        axis = np.repeat(np.arange(done, stop), n)
        along_axis = axes[axis, 0] * corners[point, 0] + axes[axis, 1] * corners[point, 1]
        cut = np.stack([at, at + n_a[own]], 1).ravel()
        low, high = np.minimum.reduceat(along_axis, cut), np.maximum.reduceat(along_axis, cut)
        apart[own[(high[::2] < low[1::2]) | (high[1::2] < low[::2])]] = True
        done = stop
    return ~apart


def cornered(f: pd.DataFrame, by: Segments) -> tuple[pd.DataFrame, Segments]:
    """The corners of each group's points as rows, in hull()'s order, and the groups of them."""
    x, y = f["__x"].to_numpy(float), f["__y"].to_numpy(float)
    order = np.lexsort((y, x, by.of))
    same = (by.of[order][1:] == by.of[order][:-1]) & (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
    order = order[np.r_[len(order) > 0, ~same]]
    at, n = side_by_side(x[order], y[order], Segments.of_groups(by.of[order]))
    return f.iloc[order[at]], Segments(np.cumsum(n) - n, int(n.sum()))


def corner_rows(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, __x, __y: few points of each group, its hull's corners among them."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, __x double, __y double"
    plain = df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x is not null and __y is not null")

    def of_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A batch leaves the corners of each of its groups."""
        for f in frames:
            if len(f):
                group = f.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
                order = np.argsort(group, kind="stable")
                yield cornered(f.iloc[order], Segments.of_groups(group[order]))[0]

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, first in whole_groups(frames, keys):
            yield cornered(f, Segments(first, len(f)))[0]

    first = plain.mapInPandas(of_batches, schema).withColumn("__g", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    return spread(first, *keys, "__g").sortWithinPartitions(*keys).drop("__g").mapInPandas(merged, schema)


def hulls(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys and corners (array<array<double>>) of each group's hull."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, first in whole_groups(frames, keys):
            rows, by = cornered(f, Segments(first, len(f)))
            points = rows[["__x", "__y"]].to_numpy(float).tolist()
            yield rows.iloc[by.first][keys].assign(corners=[points[a : a + n] for a, n in zip(by.first.tolist(), by.n.tolist(), strict=True)])

    return spread(corner_rows(df, keys, x, y), *keys).sortWithinPartitions(*keys).mapInPandas(last, f"{kinds}, corners array<array<double>>")


def overlaps(df: DataFrame, keys: list[str], arm: str, x: str, y: str) -> DataFrame:
    """keys, corners_a, corners_b, meets: hulls of rows with and without the flag arm; false where one has no rows."""
    rows = corner_rows(df.withColumn("__arm", F.coalesce(F.col(arm), F.lit(False))), [*keys, "__arm"], x, y)
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "corners_a int, corners_b int, meets boolean"])

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, first in whole_groups(frames, keys):
            pair = Segments(first, len(f))
            side = 2 * pair.of + ~f["__arm"].to_numpy(bool)  # rows with the flag come first
            every = Segments.of_groups(side)
            sides, by = cornered(f, every)
            n = np.zeros(2 * len(first), np.int64)
            n[side[every.first]] = by.n
            a, b = n[::2], n[1::2]
            both = (a > 0) & (b > 0)
            meets = np.zeros(len(first), bool)
            meets[both] = all_meet(sides[["__x", "__y"]].to_numpy(float)[np.repeat(both, a + b)], a[both], b[both])
            yield f.iloc[first][keys].assign(corners_a=a, corners_b=b, meets=meets)

    return spread(rows, *keys).sortWithinPartitions(*keys, F.col("__arm").desc()).mapInPandas(test, schema)
