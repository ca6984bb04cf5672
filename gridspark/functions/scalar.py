"""Column-level functions.

Every function returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen; none uses a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- missing data

def nan_to_null(c: ColumnOrName) -> Column:
    """NaN is the grids' only missing marker; Spark treats NaN as a
    value, so turn it into NULL once at the scan."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """S6 over every float/double column of a frame."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType))]
    if not fl:
        return df
    return df.withColumns({n: nan_to_null(n) for n in fl})


def guarded_sum(c: ColumnOrName) -> Column:
    """Aggregate: sum that is missing when any input is missing (``skipna=False``)."""
    c = _c(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def guarded_avg(c: ColumnOrName) -> Column:
    """Aggregate: mean that is missing when any input is missing."""
    c = _c(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def mask(value: ColumnOrName, condition: Column) -> Column:
    """keep the value where the mask holds, else missing (``da.where``)."""
    return F.when(condition, _c(value))


def wet_flag(value: ColumnOrName, threshold: float) -> Column:
    """1.0 for a wet day (``value >= threshold``), 0.0 for a dry one,
    missing where the value is missing."""
    v = _c(value)
    return F.when(v.isNotNull(), (v >= F.lit(threshold)).cast("double"))


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Division that gives missing on a zero denominator (ANSI-safe)."""
    return F.try_divide(_c(num), _c(den))


# ---------------------------------------------------------------- calendar

# Meteorological seasons and the months they cover.
SEASONS = ["DJF", "MAM", "JJA", "SON"]
# DJF = 12, 1, 2; MAM = 3, 4, 5; JJA = 6, 7, 8; SON = 9, 10, 11


def season(time: ColumnOrName) -> Column:
    """Meteorological season label of a date; December belongs to the DJF
    pool of its own year (season is a calendar label, not a winter)."""
    idx = F.floor((F.month(_c(time)) % 12) / 3).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), idx + 1)


def year(time: ColumnOrName) -> Column:
    return F.year(_c(time))


def month(time: ColumnOrName) -> Column:
    return F.month(_c(time))


def day_of_year(time: ColumnOrName) -> Column:
    return F.dayofyear(_c(time))


def month_end(time: ColumnOrName) -> Column:
    """Label of the monthly bin (pandas' ``'1M'`` labels bins by month end)."""
    return F.last_day(_c(time))


# ---------------------------------------------------------------- encodings

def cyclical(feature: ColumnOrName, max_val: float) -> tuple[Column, Column]:
    """``sin/cos(2*pi*v/max)`` as float32."""
    ang = F.lit(2.0 * math.pi) * _c(feature).cast("double") / F.lit(float(max_val))
    return F.sin(ang).cast("float"), F.cos(ang).cast("float")


def doy_encoding(time: ColumnOrName, period: float = 365.0) -> tuple[Column, Column]:
    """Day-of-year on a 365-day period; day 366 has the phase of day 1."""
    return cyclical(F.dayofyear(_c(time)), period)


# ---------------------------------------------------------------- units

def kelvin_to_celsius(c: ColumnOrName) -> Column:
    """X3."""
    return _c(c) - F.lit(273.15)


def metres_to_mm(c: ColumnOrName) -> Column:
    """X4."""
    return _c(c) * F.lit(1000.0)


def rounded(c: ColumnOrName, digits: int = 4) -> Column:
    """Round for reports and engine-to-engine comparison: the tiny offset
    keeps exact binary ties away from the rounding edge."""
    return F.round(_c(c) + F.lit(1e-9), digits) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Apply :func:`rounded` to every double/float column."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType))]
    if not fl:
        return df
    return df.withColumns({n: rounded(F.col(n).cast("double"), digits) for n in fl})
