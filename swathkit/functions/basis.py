"""Polynomial and spline bases, design sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spline_terms(x: Column, knots: tuple[float, float, float, float]) -> list[Column]:
    """Restricted cubic basis of four knots over the squared outer span: x and two cubic terms."""
    if list(knots) != sorted(set(knots)) or len(knots) != 4:
        raise ValueError("four ascending knots are needed")
    k1, k2, k3, k4 = (float(k) for k in knots)

    def cube(k: float) -> Column:
        return F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3.0))

    return [
        x,
        *(
            (cube(k) - cube(k3) * ((k4 - k) / (k4 - k3)) + cube(k4) * ((k3 - k) / (k4 - k3))) / (k4 - k1) ** 2
            for k in (k1, k2)
        ),
    ]


def quadratic_terms(x: Column) -> list[Column]:
    return [x, x * x]


def quadratic_contrast(x: Column, f0: float, f1: float) -> Column:
    """x^2 - (f0 + f1) x: has the same value at both endpoints."""
    return x * x - (f0 + f1) * x


def basis_change(low: float, high: float) -> tuple[float, float]:
    """Change of (x, x^2) from low to high."""
    return high - low, high * high - low * low


def required_count(sd: Column, reliability: Column, constant: float, target: float, design_effect: float) -> Column:
    """Planning count with the target attenuated by the root of the reliability."""
    return F.ceil(constant * design_effect * sd * sd / (target * target * reliability)).cast("bigint")
