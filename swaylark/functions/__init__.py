"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

PI = 3.141592653589793


def finite(c: Column) -> Column:
    """A number, or null where it is missing, NaN or infinite."""
    x = c.try_cast("double") if hasattr(c, "try_cast") else c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def wrapped(angle: Column) -> Column:
    """An angle between -pi and pi."""
    return F.atan2(F.sin(angle), F.cos(angle))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low)))


def natural_key(c: Column) -> list[Column]:
    """Sort keys that put whole numbers first, by value, and other names after."""
    number = F.when(c.rlike("^[0-9]+$"), c.cast("decimal(38,0)"))
    return [number.isNull(), number, c]


def hashed_integer(*parts: Column) -> Column:
    """A non-negative integer below 2 ** 32 from the first 8 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, null where either is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def joined_flags(flags: Column) -> Column:
    """Sorted distinct names with bars between."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(flags, lambda x: x.isNotNull()))), "|")


def ordered(key: str = "record_id", by: tuple[str, ...] = ("t", "seq")) -> Window:
    return Window.partitionBy(key).orderBy(*by)
