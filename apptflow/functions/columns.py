"""Scalar column functions (F1–F8 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """0/1 integer from a boolean; a null condition gives 0 (CASE WHEN)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def prefix_event(event, seq) -> Column:
    """put one event in front of a sequence (newest event is leftmost)."""
    return F.concat(F.lit(str(event)), col(seq))


def drop_last_char(s) -> Column:
    """remove the last (oldest) character; '' stays ''."""
    s = col(s)
    return F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0)))


def ratio(num, den) -> Column:
    """double ratio of two counts (null, not an error, for 0/0)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def lead_days(appointment, booked) -> Column:
    """F8: days between booking and appointment, as a double."""
    return F.datediff(col(appointment), col(booked)).cast("double")


def iso_weekday(d) -> Column:
    """F8: ISO weekday, Monday = 1 ... Sunday = 7."""
    return F.weekday(col(d)) + 1


def join_null_safe(left, right, keys: list[str], how: str = "inner"):
    """Equi-join on ``keys`` where null matches null (R ``left_join`` and
    ``group_by`` semantics); the right side's key columns are dropped."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
