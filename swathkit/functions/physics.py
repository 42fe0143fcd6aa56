"""Radiation, humidity and interpolation columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA = 5.670374419e-8  #: W m-2 K-4


def emitted_energy(emissivity: Column, kelvin: Column) -> Column:
    """eps sigma T^4; null unless 0 < eps <= 1 and T > 0."""
    return F.when((emissivity > 0) & (emissivity <= 1) & (kelvin > 0), emissivity * F.lit(SIGMA) * F.pow(kelvin, F.lit(4.0)))


def temperature_equivalent(flux_change: Column, reference_k: Column, reference_eps: Column) -> Column:
    """Temperature change at the reference for a change of emitted flux; null where the flux would not stay positive."""
    anchor = reference_eps * F.lit(SIGMA) * F.pow(reference_k, F.lit(4.0))
    left = anchor + flux_change
    return F.when(left > 0, reference_k * (F.pow(left / anchor, F.lit(0.25)) - 1.0))


def cooling_effect(slope: Column, change: float = 0.1) -> Column:
    """Effect of a change of the predictor, cooling positive."""
    return -slope * change


def cooling_quantities(cooling_k: Column, cooling_flux: Column, reference_k: Column, reference_eps: Column) -> dict[str, Column]:
    equivalent = -temperature_equivalent(-cooling_flux, reference_k, reference_eps)
    return {"cooling_k": cooling_k, "cooling_flux": cooling_flux, "equivalent_k": equivalent, "departure_k": cooling_k - equivalent}


def vapour_pressure_kpa(celsius: Column) -> Column:
    """Magnus saturation pressure over water."""
    return 0.6108 * F.exp(17.27 * celsius / (celsius + 237.3))


def vpd_kpa(kelvin: Column, dewpoint_k: Column) -> Column:
    """Vapour pressure deficit, never below 0."""
    return F.greatest(vapour_pressure_kpa(kelvin - 273.15) - vapour_pressure_kpa(dewpoint_k - 273.15), F.lit(0.0))


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def interpolate(a: Column, b: Column, weight: Column) -> Column:
    """a at weight 0, b at 1; at weight 0 b is not needed."""
    return F.when(weight == 0, a).otherwise((1 - weight) * a + weight * b)


def mixed(fraction: Column, inside: Column, outside: Column) -> Column:
    """Value of a cell of which a fraction is inside."""
    return fraction * inside + (1 - fraction) * outside


def polar_stereographic_scale(latitude: Column, true_latitude: float) -> Column:
    """Spherical scale factor of a polar stereographic grid."""
    return (1 + F.sin(F.radians(F.lit(true_latitude)))) / (1 + F.sin(F.radians(latitude)))
