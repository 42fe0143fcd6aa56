"""Bit-field and quality predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(word: Column, low: int, width: int) -> Column:
    """An unsigned field of a word."""
    return F.shiftright(word, low).bitwiseAND(F.lit((1 << width) - 1))


def clear_word(word: Column, max_level: int = 2) -> Column:
    """Bits 1 to 5 zero and the two-bit level above bit 6 at most max_level."""
    return (bits(word, 1, 5) == 0) & (bits(word, 6, 2) <= max_level)


def usable_cell(value: Column, qc: Column, cloud: Column, water: Column) -> Column:
    """Finite value, quality in the two best classes, no cloud, no water; null counts as unusable."""
    fine = value.isNotNull() & ~F.isnan(value) & (bits(qc, 0, 2) <= 1) & (cloud == 0) & (water == 0)
    return F.coalesce(fine, F.lit(False))


def physical_cell(kelvin: Column, emissivity: Column) -> Column:
    return F.coalesce((kelvin > 0) & (emissivity > 0) & (emissivity <= 1), F.lit(False))


def scaled(raw: Column, scale: float, offset: float, fill: int) -> Column:
    """Stored integer to value; the fill value is null."""
    return F.when(raw != fill, raw * scale + offset)


def within_or_null(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def band(fraction: Column, endpoint: float, halfwidth: float) -> Column:
    """Closed neighbourhood of an endpoint, cut to [0, 1]."""
    return fraction.between(max(0.0, endpoint - halfwidth), min(1.0, endpoint + halfwidth))
