"""Time columns: hour brackets, solar clocks, windows of the day and season."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def days_between(later: Column, earlier: Column) -> Column:
    """Signed lag in days, microseconds kept."""
    return (micros(later) - micros(earlier)) / F.lit(86_400e6)


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def hour_ceil(ts: Column) -> Column:
    """The next full hour; an exact hour is its own."""
    floor = hour_floor(ts)
    return F.when(floor == ts, floor).otherwise(floor + F.expr("interval 1 hour"))


def hour_weight(ts: Column) -> Column:
    """Share of the hour that has passed, sub-seconds kept; 0 on an exact hour."""
    return (micros(ts) - micros(hour_floor(ts))) / F.lit(3600e6)


def utc_hour(ts: Column, subseconds: bool = False) -> Column:
    """Hour of the day as a fraction; whole seconds unless told otherwise."""
    whole = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    return F.pmod(micros(ts), F.lit(86_400_000_000)) / F.lit(3600e6) if subseconds else whole


def days_in_year(ts: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31)))


def equation_of_time(ts: Column, subseconds: bool = False) -> Column:
    """Minutes by the harmonic series over the fraction of the (leap-aware) year."""
    hour = utc_hour(ts, subseconds)
    g = F.lit(2 * 3.141592653589793) / days_in_year(ts) * (F.dayofyear(ts) - 1.0 + (hour - 12.0) / 24.0)
    # Published Fourier coefficients of the equation of time.
    series = (
        F.lit(0.000075) + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2.0 * g) - 0.040849 * F.sin(2.0 * g)
    )
    return 229.18 * series


def wrap_hours(hours: Column) -> Column:
    return F.pmod(hours, F.lit(24.0))


def mean_solar_hour(ts: Column, longitude: Column, subseconds: bool = False) -> Column:
    return wrap_hours(utc_hour(ts, subseconds) + longitude / 15.0)


def apparent_solar_hour(ts: Column, longitude: Column, subseconds: bool = False) -> Column:
    return wrap_hours(utc_hour(ts, subseconds) + longitude / 15.0 + equation_of_time(ts, subseconds) / 60.0)


def local_solar_date(ts: Column, longitude: Column) -> Column:
    """Date of UTC shifted by longitude/15 hours."""
    return F.to_date(F.timestamp_micros((micros(ts) + F.round(longitude / 15.0 * 3600e6)).cast("bigint")))


def month_day(date: Column) -> Column:
    return F.date_format(date, "MM-dd")


def in_season(date: Column, first: str, last: str) -> Column:
    """Between two MM-dd days, both included."""
    return month_day(date).between(first, last)


def window_of_day(hour: Column) -> Column:
    """Half-open windows of the apparent solar day."""
    return (
        F.when((hour >= 9.5) & (hour < 11.5), "morning").when((hour >= 11.5) & (hour < 15), "middle")
        .when((hour >= 15) & (hour < 18), "afternoon").otherwise("outside")
    )


def after_noon(hour: Column) -> Column:
    return (hour > 12).cast("int")


def clock_difference_seconds(a: Column, b: Column) -> Column:
    """Signed cyclic difference of two hours of the day, in seconds."""
    return (F.pmod(a - b + 12.0, F.lit(24.0)) - 12.0) * 3600.0


def utc_strict(text: Column) -> Column:
    """Timestamp of ISO text that names its zone; null if it names none."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))


def utc_lenient(text: Column) -> Column:
    """Timestamp of ISO text; text without a zone is taken as UTC (the session's zone)."""
    return F.try_to_timestamp(text)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position in a period."""
    angle = value * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)
