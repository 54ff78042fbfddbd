"""Small column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area_km2(square_metres: Column) -> Column:
    return square_metres.cast("double") / 1e6


def share_of_area(area: Column, percent: Column) -> Column:
    return area * percent / 100


def rounded(value: Column, digits: int) -> Column:
    """A double to so many digits as SQL engines in binary round it: the product with the power of ten to the nearest whole
    number, halves away from zero. Spark's round goes by the shortest decimal text instead: 0.145, whose product is
    14.499999999999998, it rounds to 0.15."""
    power = 10.0**digits
    return F.round(value * power) / power


def size_kb(n_bytes: Column) -> Column:
    """To one digit, halves to even."""
    return F.bround(n_bytes / 1024, 1)


def value_number(text: Column) -> Column:
    """'1,234' as a number; suppressed or other text is null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def fips_text(key: Column, width: int = 5) -> Column:
    return F.lpad(key.cast("string"), width, "0")


def pollutant_load(concentration: Column, discharge: Column) -> Column:
    """lb/day from mg/L and cubic feet per second."""
    return concentration * discharge * 5.39377


def pollutant_yield(load: Column, area: Column) -> Column:
    return F.try_divide(load, area)


def year_in(name: Column) -> Column:
    """The first run of digits, as a number."""
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("int")


def exceeds(value: Column, threshold: float = 10.0) -> Column:
    return value > threshold


def log1p_or_null(value: Column) -> Column:
    return F.when(value > -1, F.log1p(value))


def comma_list(*values: Column) -> Column:
    return F.concat_ws(",", *values)
