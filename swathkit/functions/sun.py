"""Solar geometry columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * 3.141592653589793


def declination(day_of_year: Column, hour: Column, year_days: Column) -> Column:
    g = F.lit(TWO_PI) / year_days * (day_of_year - 1.0 + (hour - 12.0) / 24.0)
    # Published Fourier coefficients of the declination.
    return (
        F.lit(0.006918) - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2.0 * g)
        + 0.000907 * F.sin(2.0 * g) - 0.002697 * F.cos(3.0 * g) + 0.001480 * F.sin(3.0 * g)
    )


def clip_unit(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def cos_zenith(latitude: Column, day_of_year: Column, hour: Column, year_days: Column) -> Column:
    phi, decl, angle = F.radians(latitude), declination(day_of_year, hour, year_days), F.radians(15.0 * (hour - 12.0))
    return clip_unit(F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(angle))


def zenith(latitude: Column, day_of_year: Column, hour: Column, year_days: Column) -> Column:
    """Degrees from the vertical."""
    return F.degrees(F.acos(cos_zenith(latitude, day_of_year, hour, year_days)))


def azimuth(latitude: Column, day_of_year: Column, hour: Column, year_days: Column) -> Column:
    """Degrees clockwise from north."""
    phi, decl, angle = F.radians(latitude), declination(day_of_year, hour, year_days), F.radians(15.0 * (hour - 12.0))
    bearing = F.atan2(F.sin(angle), F.cos(angle) * F.sin(phi) - F.tan(decl) * F.cos(phi))
    return F.pmod(F.degrees(bearing) + 180.0, F.lit(360.0))


def shortwave_between(sw0: Column, sw1: Column, cos0: Column, cos1: Column, cos_at: Column, weight: Column) -> tuple[Column, Column]:
    """Shortwave by interpolating radiation over cosine, and how; hours of a cosine under 0.1 are not used.

    Null where neither hour can be used, an input is out of range or the sun is down.
    """
    use0, use1 = cos0 >= 0.1, cos1 >= 0.1
    sound = (sw0 >= 0) & (sw1 >= 0) & weight.between(0, 1) & (cos_at > 0) & (cos_at <= 1)
    ratio = (
        F.when(use0 & use1, (1 - weight) * sw0 / cos0 + weight * sw1 / cos1).when(use0, sw0 / cos0).when(use1, sw1 / cos1)
    )
    method = F.when(use0 & use1, "both_hours").when(use0, "floor_hour").when(use1, "ceiling_hour")
    return F.when(sound, ratio * cos_at), F.when(sound, method)
