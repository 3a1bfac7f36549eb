"""Numbers: missing values, safe division, percent errors, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
#: Temperatures kept in Kelvin.
KELVIN_VARIABLES = ("t2m", "d2m", "stl1", "stl2")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float) -> Column:
    return F.lit(float(x))


def finite(c) -> Column:
    """The number as double, or NULL for NaN and infinities: missing is NULL only."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def number(c) -> Column:
    """Text or number as a finite double, NULL where it can't be read."""
    x = col(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a, b, least: float = 0.0) -> Column:
    """a / b, NULL where |b| is not above `least`."""
    b = col(b)
    return F.when(F.abs(b) > least, col(a) / b)


def is_temperature(variable) -> Column:
    return col(variable).isin(*KELVIN_VARIABLES)


def display_value(variable, value) -> Column:
    """Kelvin to Celsius, precipitation metres to millimetres, others as they are."""
    v = col(value)
    return F.when(is_temperature(variable), v - 273.15).when(col(variable) == "tp", v * 1000.0).otherwise(v)


def display_unit(variable) -> Column:
    return F.when(is_temperature(variable), "°C").when(col(variable) == "tp", "mm/month").otherwise("native")


def pct_error(predicted, observed) -> Column:
    """|p - o| / |o| in percent; for an observed zero 0 if the prediction is zero too, else 100."""
    p, o = col(predicted), col(observed)
    zero = F.when(F.abs(p) < EPS, 0.0).otherwise(100.0)
    return F.when(p.isNull() | o.isNull(), None).when(F.abs(o) < EPS, zero).otherwise(F.abs(p - o) / F.abs(o) * 100.0)


def pct_error_kelvin(predicted_c, observed_c) -> Column:
    return pct_error(col(predicted_c) + 273.15, col(observed_c) + 273.15)


def decimal_comma(c) -> Column:
    """A double as text with a decimal comma."""
    return F.translate(col(c).cast("string"), ".", ",")
