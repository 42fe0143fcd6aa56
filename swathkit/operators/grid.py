"""Operators on cells of regular grids in long form (tile, row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wholly_inside(x: Column, low: Column, width: float, half: float) -> Column:
    """A cell's footprint lies inside [low, low + width]."""
    return (x - half >= low) & (x + half <= low + width)


def core_origin(x: Column, size: float = 1e5) -> Column:
    """Origin of the canonical tile core next to a coordinate."""
    return F.round(x / size) * size


def cell_centre(origin: Column, index: Column, step: float) -> Column:
    return origin + (index + 0.5) * step


def bucket(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size), F.floor(y / size)


def linear_key(row: Column, col: Column, n_cols: int) -> Column:
    return (row * n_cols + col).cast("bigint")


def shifted(cells: DataFrame, key: list[str], row: str, col: str, value: str, shifts: list[tuple[int, int]]) -> DataFrame:
    """Each cell's value from (dy, dx) away for every shift, null beyond the edge (no wrap)."""
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in shifts))
    wanted = cells.select(*key, row, col, F.explode(steps).alias("s")).select(
        *key, F.col(row).alias("__r"), F.col(col).alias("__c"), (F.col(row) - F.col("s.dy")).alias(row), (F.col(col) - F.col("s.dx")).alias(col), "s.dy", "s.dx"
    )
    met = wanted.join(cells.select(*key, row, col, value), [*key, row, col], "left")
    return met.select(*key, F.col("__r").alias(row), F.col("__c").alias(col), "dy", "dx", value)


def area_average(fine: DataFrame, key: list[str], x: str, y: str, value: str, fine_size: float, coarse_size: float, shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean of fine cells over coarse cells, weighted by overlap; x and y are the fine cells' lower corners.

    shape: columns and rows of the target grid, from 0, where one is declared; without it every coarse cell that is reached.
    """

    def cover(start: Column) -> Column:
        first = F.floor(start / coarse_size)
        last = F.ceil((start + fine_size) / coarse_size) - 1
        return F.transform(
            F.sequence(first, last),
            lambda k: F.struct(
                k.alias("i"),
                (F.least(start + fine_size, (k + 1) * coarse_size) - F.greatest(start, k * coarse_size)).alias("w"),
            ),
        )

    parts = fine.where(F.col(value).isNotNull()).select(*key, F.explode(cover(F.col(x))).alias("cx"), y, value)
    parts = parts.select(*key, "cx", F.explode(cover(F.col(y))).alias("cy"), value)
    if shape:
        parts = parts.where(F.col("cx.i").between(0, shape[0] - 1) & F.col("cy.i").between(0, shape[1] - 1))
    w = F.col("cx.w") * F.col("cy.w")
    return parts.groupBy(*key, F.col("cx.i").alias("gx"), F.col("cy.i").alias("gy")).agg(
        (F.sum(w * F.col(value)) / F.sum(w)).alias("mean"), (F.sum(w) / (coarse_size * coarse_size)).alias("covered")
    )


def merge_scenes(cells: DataFrame, key: list[str], value: str, bad: Column, order: list[str]) -> DataFrame:
    """One row per cell: a bad scene spoils it, otherwise the last valid scene supplies the value."""
    valid = F.col(value).isNotNull() & ~bad
    picked = F.max_by(F.when(valid, F.col(value)), F.when(valid, F.struct(*order)))
    spoiled = F.bool_or(bad & F.col(value).isNotNull())
    return cells.groupBy(*key).agg(F.when(~spoiled, picked).alias(value), F.count("*").alias("n_scenes"))


def block_counts(cells: DataFrame, block: list[str], clear: Column, least: int) -> DataFrame:
    """Clear cells per block, and whether there are enough."""
    n = F.count_if(clear)
    return cells.groupBy(*block).agg(F.count("*").alias("n_cells"), n.alias("n_clear"), (n >= least).alias("usable"))


def moran(pairs: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """Moran's I over neighbour pairs (each pair once) of the cells: n * sum(zi zj) / (E * sum z^2)."""
    whole = cells.agg(F.avg(value).alias("m"), F.count(value).alias("n"), (F.var_pop(value) * F.count(value)).alias("ss"))
    joined = pairs.join(F.broadcast(whole))  # whole is one row
    z = (F.col("value") - F.col("m")) * (F.col("neighbour") - F.col("m"))
    return joined.groupBy().agg((F.first("n") * F.sum(z) / (F.count("*") * F.first("ss"))).alias("moran"), F.count("*").alias("n_pairs"))


def box_meets_convex(x0: Column, y0: Column, x1: Column, y1: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a box and a convex (literal) polygon overlap: they do unless an axis of the box or an edge's normal parts them."""
    axes = {(1.0, 0.0), (0.0, 1.0)} | {(b[1] - a[1], a[0] - b[0]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)}
    meets = F.lit(True)
    for ax, ay in sorted(axes):
        reach = [ax * px + ay * py for px, py in ring]
        low = ax * (x0 if ax >= 0 else x1) + ay * (y0 if ay >= 0 else y1)
        high = ax * (x1 if ax >= 0 else x0) + ay * (y1 if ay >= 0 else y0)
        meets = meets & (low < max(reach)) & (high > min(reach))
    return meets


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a (small, literal) ring, after its bounding box."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y0 == y1:
            continue
        straddles = (F.lit(y0) > y) != (F.lit(y1) > y)
        at = (x1 - x0) * (y - y0) / (y1 - y0) + x0
        crossings = crossings + (straddles & (x < at)).cast("int")
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)
