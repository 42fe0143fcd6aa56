"""Nearest neighbours in several dimensions by a partitioned k-d tree.

Equal points are one point (that with the smallest id), so points at one spot cannot fill a leaf; equal queries are asked
once. Splits at the medians of a sample of at most SAMPLE points deal all points to leaves of about LEAF points. A query
first visits the leaf it lies in, whose task searches a tree of its own over the leaf's points; then the leaves whose
bounding box is no farther than what it has found, and no others. Leaves that many queries visit are dealt to several
tasks with a copy of their points. No round joins all queries with all points.

Distances are Euclidean; of points equally near the smallest id counts. Rows with a null or NaN feature are no points, and
as queries find nothing. Without points every query finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.operators.select import spread
from swathkit.sources.files import written

SAMPLE, LEAF, BUCKET = 50_000, 50_000, 32  #: sampled points; points of a leaf, and of a bucket of its own tree
TOGETHER, PAIRS = 512, 2048  #: queries searched side by side; pairs of a query and a bucket looked at together
UNKNOWN = np.iinfo(np.int64).max
MOST_QUERIES = 16_000  #: of a leaf in one task


def standardised(df: DataFrame, by: DataFrame, features: list[str]) -> DataFrame:
    """df with each feature less its mean, over its standard deviation, both of `by` (0 where it does not vary)."""
    whole = by.agg(*(F.avg(f).alias(f"__m_{f}") for f in features), *(F.stddev_pop(f).alias(f"__s_{f}") for f in features))  # one row
    z = {f: F.when(F.col(f).isNull(), None).otherwise(F.coalesce((F.col(f) - F.col(f"__m_{f}")) / F.nullif(F.col(f"__s_{f}"), F.lit(0.0)), F.lit(0.0))) for f in features}
    return df.join(F.broadcast(whole)).withColumns(z).select(*df.columns)


@dataclass
class Splits:
    """A tree of median splits: node k splits at `at[k]` along `axis[k]` into nodes 2 k + 1 and 2 k + 2."""

    axis: np.ndarray
    at: np.ndarray
    depth: int

    @classmethod
    def of(cls, sample: np.ndarray, leaves: int) -> Splits:
        depth = max(0, int(np.ceil(np.log2(max(leaves, 1)))))
        axis, at = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        parts = {0: sample}
        for k in range(2**depth - 1):
            own = parts.pop(k)
            if len(own):
                axis[k] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                at[k] = np.median(own[:, axis[k]])
            left = own[:, axis[k]] <= at[k]
            parts[2 * k + 1], parts[2 * k + 2] = own[left], own[~left]
        return cls(axis, at, depth)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node


class Tree:
    """A k-d tree over the points of one leaf, searched for many queries side by side.

    Nodes are halved at the median of their widest axis, all nodes of a level together, down to buckets of BUCKET points.
    Queries and the nodes that they may have to see are pairs in flat arrays, so no step is made for a single query or node.
    """

    def __init__(self, points: np.ndarray, rank: np.ndarray):
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(n / BUCKET))))
        slots = -(-n // 2**depth) * 2**depth  # some slots hold no point
        low, high = (np.full((slots, points.shape[1]), v) for v in (np.inf, -np.inf))
        low[:n] = high[:n] = points
        order = np.arange(slots)[None, :]
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []  # of each level: edges by feature and node
        for level in range(depth + 1):
            own = low[order]
            a, b = own.min(axis=1), high[order].max(axis=1)
            self.boxes.append((a.T.copy(), b.T.copy()))
            if level < depth:
                axis = np.argmax(b - a, axis=1)
                by = np.argsort(np.take_along_axis(own, axis[:, None, None], 2)[:, :, 0], axis=1, kind="stable")
                order = np.take_along_axis(order, by, 1).reshape(2 * len(order), -1)
        ranks = np.r_[rank, np.full(slots - n, UNKNOWN)]
        order = np.take_along_axis(order, np.argsort(ranks[order], axis=1), 1)  # so that of equally near points the first is the one
        self.rank, self.place, self.depth = ranks[order], np.where(order < n, order, -1), depth
        self.points = np.ascontiguousarray(low[order].transpose(2, 0, 1))  # feature, bucket, point

    def nearest(self, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and place of the nearest point of each query, if it is within bound (else infinity and -1)."""
        parts = [self._nearest(queries[k : k + TOGETHER], bound[k : k + TOGETHER]) for k in range(0, len(queries), TOGETHER)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0, np.int64))

    def _nearest(self, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(queries)
        best, rank, place = bound.copy(), np.full(n, UNKNOWN), np.full(n, -1)
        asked = np.flatnonzero(self._away(queries, np.arange(n), 0, np.zeros(n, np.int64)) <= best)
        first = np.zeros(n, np.int64)
        for level in range(1, self.depth + 1):  # down to a near bucket
            left, right = (self._away(queries, asked, level, 2 * first[asked] + k) for k in (0, 1))
            first[asked] = 2 * first[asked] + (right < left)
        self._meet(queries, asked, first[asked], best, rank, place)
        node, least = np.zeros(len(asked), np.int64), np.zeros(len(asked))
        for level in range(1, self.depth + 1):
            asked, node = np.repeat(asked, 2), np.repeat(2 * node, 2)
            node[1::2] += 1
            least = self._away(queries, asked, level, node)
            near = least <= best[asked]
            asked, node, least = asked[near], node[near], least[near]
        more = node != first[asked]
        asked, node, least = asked[more], node[more], least[more]
        by = np.lexsort((least, asked))
        asked, node, least = asked[by], node[by], least[by]
        head = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]][: len(asked)])
        turn = np.arange(len(asked)) - np.repeat(head, np.diff(np.r_[head, len(asked)]))
        a = 0
        for b in (1, 4, 16, UNKNOWN):  # the nearest buckets first: they leave fewer to see
            now = (turn >= a) & (turn < b) & (least <= best[asked])
            self._meet(queries, asked[now], node[now], best, rank, place)
            a = b
        return np.where(place >= 0, best, np.inf), place

    def _away(self, queries: np.ndarray, asked: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
        """Squared distance of the query to the box of the node, pair by pair."""
        out = np.zeros(len(asked))
        for f, (low, high) in enumerate(zip(*self.boxes[level], strict=True)):
            x = queries[asked, f]
            out += np.maximum(np.maximum(low[node] - x, x - high[node]), 0) ** 2
        return out

    def _meet(self, queries: np.ndarray, asked: np.ndarray, bucket: np.ndarray, best: np.ndarray, rank: np.ndarray, place: np.ndarray) -> None:
        """All points of the bucket against the query, pair by pair in ascending order of queries; equally near ones by rank."""
        for a in range(0, len(asked), PAIRS):
            q, own = asked[a : a + PAIRS], bucket[a : a + PAIRS]
            d2 = np.zeros((len(q), self.rank.shape[1]))
            for f, points in enumerate(self.points):  # one order of adding up, whatever the leaf
                d = points[own]
                d -= queries[q, f, None]
                d *= d
                d2 += d
            k = d2.argmin(axis=1)
            near, ranked, at = d2[np.arange(len(k)), k], self.rank[own, k], self.place[own, k]
            by = np.lexsort((ranked, near, q))
            by = by[np.r_[True, q[by][1:] != q[by][:-1]]]  # the best of each query
            q, near, ranked, at = q[by], near[by], ranked[by], at[by]
            better = (at >= 0) & ((near < best[q]) | ((near == best[q]) & (ranked < rank[q])))
            q = q[better]
            best[q], rank[q], place[q] = near[better], ranked[better], at[better]


def box_distance(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to a box."""
    out = np.zeros(len(queries))
    for f in range(queries.shape[1]):
        out += np.maximum(np.maximum(low[f] - queries[:, f], queries[:, f] - high[f]), 0) ** 2
    return out


def nearest(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, features: list[str], leaf: int = LEAF, most: int = MOST_QUERIES) -> DataFrame:
    """query_id, nearest_id, distance of every row of queries."""
    names = [f"__f{k}" for k in range(len(features))]
    value = lambda f: F.col(f).cast("double") + F.lit(0.0)  # noqa: E731  no minus zero
    fine = lambda df: df.where(" and ".join(f"{n} is not null and not isnan({n})" for n in names))
    asked = written(queries.select(F.col(query_id).alias("__q"), *(value(f).alias(n) for f, n in zip(features, names, strict=True))), "queries")
    pool = fine(points.select(F.col(point_id).alias("__p"), *(value(f).alias(n) for f, n in zip(features, names, strict=True)))).groupBy(*names).agg(F.min("__p").alias("__p"))
    pool = written(pool, "points")
    n = pool.count()
    kind = points.schema[point_id].dataType.simpleString()
    if not n:
        return asked.select(F.col("__q").alias(query_id), F.lit(None).cast(kind).alias("nearest_id"), F.lit(None).cast("double").alias("distance"))
    share = min(1.0, SAMPLE / n)
    chosen = pool.where(F.pmod(F.xxhash64(*names), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(*names)
    sample = chosen.limit(2 * SAMPLE).toPandas().to_numpy(float)
    splits = Splits.of(sample[np.lexsort(sample.T)], -(-n // leaf))
    columns = ", ".join(f"{c} double" for c in names)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(leaf=splits.leaf(f[names].to_numpy(float)))

    dealt = written(pool.mapInPandas(deal, f"{columns}, __p {kind}, leaf bigint"), "leaves")
    rows = dealt.groupBy("leaf").agg(*(F.min(c).alias(f"a{c}") for c in names), *(F.max(c).alias(f"b{c}") for c in names)).orderBy("leaf").collect()  # a row a leaf
    leaves = np.array([r["leaf"] for r in rows], np.int64)
    low, high = (np.array([[r[f"{s}{c}"] for c in names] for r in rows]) for s in "ab")
    spots = fine(asked.select(*names).distinct())

    def own_leaf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = f[names].to_numpy(float)
            own = splits.leaf(at)
            missing = ~np.isin(own, leaves)  # a leaf without points: the nearest box instead
            if missing.any():
                own[missing] = leaves[np.stack([box_distance(at[missing], a, b) for a, b in zip(low, high, strict=True)]).argmin(axis=0)]
            yield f.assign(leaf=own, bound=np.inf, near=None)

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at, bound, own = f[names].to_numpy(float), f["bound"].to_numpy(float), f["leaf"].to_numpy()
            for k, number in enumerate(leaves):
                some = (box_distance(at, low[k], high[k]) <= bound) & (own != number)
                if some.any():
                    yield f[some].assign(leaf=number)

    def visit(visits: DataFrame) -> DataFrame:
        """Each (query, leaf): the nearest point of the leaf within the bound; leaves with many queries in several tasks."""
        visits = written(visits, "visits")
        counts = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))  # a row a leaf
        number: Column = F.pmod(F.xxhash64(*names), F.col("parts"))
        left = visits.join(F.broadcast(counts), "leaf").withColumn("part", number).drop("parts")
        right = dealt.join(F.broadcast(counts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def search(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            ids = b["__p"].to_numpy()
            rank = np.empty(len(b), np.int64)
            rank[np.argsort(ids, kind="stable")] = np.arange(len(b))
            d2, place = Tree(b[names].to_numpy(float), rank).nearest(a[names].to_numpy(float), a["bound"].to_numpy(float))
            found = place >= 0
            return a[found][names].assign(leaf=key[0], bound=d2[found], near=ids[place[found]])

        return spread(left, "leaf", "part").groupBy("leaf", "part").cogroup(spread(right, "leaf", "part").groupBy("leaf", "part")).applyInPandas(search, f"{columns}, leaf bigint, bound double, near {kind}")

    first = written(visit(spots.mapInPandas(own_leaf, f"{columns}, leaf bigint, bound double, near {kind}")), "first")
    second = visit(first.select(*names, "leaf", "bound").withColumn("near", F.lit(None).cast(kind)).mapInPandas(others, f"{columns}, leaf bigint, bound double, near {kind}"))
    best = first.unionByName(second).groupBy(*names).agg(F.min(F.struct("bound", "near")).alias("best"))
    out = asked.join(best, names, "left")
    return out.select(F.col("__q").alias(query_id), F.col("best.near").alias("nearest_id"), F.sqrt("best.bound").alias("distance"))
