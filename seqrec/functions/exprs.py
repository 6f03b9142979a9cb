"""Column expressions shared by the operators (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_micros(col) -> Column:
    """Epoch microseconds of a TIMESTAMP_NTZ, independent of the session zone."""
    c = _c(col)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def epoch_seconds(col) -> Column:
    """Whole epoch seconds of a TIMESTAMP_NTZ (floor)."""
    return F.floor(epoch_micros(col) / F.lit(1_000_000)).cast("bigint")


def clamp(col, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), _c(col)))


def dot(a, b) -> Column:
    """Dot product of two numeric arrays of equal length."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a) -> Column:
    """L2-normalised copy of an array (zero vectors stay zero)."""
    n = l2_norm(a)
    return F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def age_bucket(t0, t, day_units: int, phase_days: int, top: int = 4) -> Column:
    """``least(top, floor(floor((t0 - t) / day) / phase))`` in whole days."""
    days = F.floor((_c(t0) - _c(t)) / F.lit(day_units))
    return F.least(F.lit(top).cast("bigint"), F.floor(days / F.lit(phase_days))).cast("bigint")
