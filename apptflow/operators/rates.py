"""Rates, clinic support rules and per-patient counts.

All aggregations here are plain ``groupBy().agg`` so Spark runs a partial
(map-side) aggregate before the shuffle: a clinic or patient holding a third
of all rows still ships one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flag, ratio
from ..schemas import CANCEL, CLINIC, DATE, DNA, PATIENT

OTHER = "Other"  # fixed value: reserved clinic name for small clinics


def _count_ones(c: str) -> Column:
    return F.count(F.when(F.col(c) == 1, F.lit(1)))


def event_rate(df: DataFrame, flags: dict[str, str] | None = None) -> DataFrame:
    """A1: share of rows with flag = 1 over *all* rows (null flags included).

    ``flags`` maps a flag column to its output name.  Returns one row.
    """
    flags = flags or {DNA: "rate", CANCEL: "cancel_rate"}
    n = F.count(F.lit(1))
    return df.agg(*[ratio(_count_ones(c), n).alias(a) for c, a in flags.items()])


def clinic_groups(df: DataFrame, clinic: str = CLINIC, min_count: int = 500) -> DataFrame:
    """A2: clinic sizes with clinics under ``min_count`` folded into 'Other'."""
    sizes = df.groupBy(clinic).agg(F.count(F.lit(1)).alias("n"))
    folded = F.when(F.col("n") < min_count, F.lit(OTHER)).otherwise(F.col(clinic))
    return (sizes.select(folded.alias(clinic), "n")
            .groupBy(clinic).agg(F.sum("n").alias("count")))


def clinic_stats(df: DataFrame, clinic: str = CLINIC, flags=(DNA, CANCEL),
                 date: str | None = DATE) -> DataFrame:
    """Per-clinic counts in one scan: rows, ones per flag, newest date.

    The result has one row per clinic; overall rates (A1) and the data set's
    newest date (A7) are sums / maxima over it, so the feature pipeline scans
    the appointments once for all of them.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [_count_ones(f).alias(f"ones_{f}") for f in flags]
    if date:
        aggs.append(F.max(date).alias("max_dt"))
    return df.groupBy(clinic).agg(*aggs)


def rates_from_stats(stats: DataFrame, flags: dict[str, str] | None = None,
                     with_max_date: bool = True) -> DataFrame:
    """A1 + A7 from :func:`clinic_stats` (one row)."""
    flags = flags or {DNA: "rate", CANCEL: "cancel_rate"}
    aggs = [ratio(F.sum(f"ones_{c}"), F.sum("n")).alias(a) for c, a in flags.items()]
    if with_max_date:
        aggs.append(F.max("max_dt").alias("max_dt"))
    return stats.agg(*aggs)


def clinic_rates_from_stats(stats: DataFrame, clinic: str = CLINIC, flag_col: str = DNA,
                            min_count: int = 500, out: str = "clinic_prop") -> DataFrame:
    """A3 from :func:`clinic_stats`.

    A clinic gets a rate only if it has ``min_count`` rows or is literally
    named 'Other', and only if it has at least one flagged row; every other
    clinic falls through to the overall rate when joined.
    """
    ones = F.col(f"ones_{flag_col}")
    supported = (F.col("n") >= min_count) | F.col(clinic).eqNullSafe(F.lit(OTHER))
    return (stats.where(supported & (ones > 0))
            .select(clinic, ratio(ones, "n").alias(out)))


def clinic_rates(df: DataFrame, clinic: str = CLINIC, flag_col: str = DNA,
                 min_count: int = 500, out: str = "clinic_prop") -> DataFrame:
    """A3: per-clinic event rate for supported clinics."""
    stats = clinic_stats(df, clinic, flags=(flag_col,), date=None)
    return clinic_rates_from_stats(stats, clinic, flag_col, min_count, out)


def supported_clinic_rows(df: DataFrame, clinic: str = CLINIC,
                          min_count: int = 500) -> DataFrame:
    """Rows whose clinic is in the supported set (null-safe semi join)."""
    sizes = df.groupBy(clinic).agg(F.count(F.lit(1)).alias("n"))
    keep = sizes.where((F.col("n") >= min_count) | F.col(clinic).eqNullSafe(F.lit(OTHER))) \
        .select(F.col(clinic).alias("_k"))
    # One row per clinic; AQE broadcasts it when its measured size is small.
    return df.join(keep, df[clinic].eqNullSafe(keep["_k"]), "left_semi")


def same_day(df: DataFrame, patient: str = PATIENT, date: str = DATE) -> DataFrame:
    """A4: rows per (patient, day) and the flag ``n > 1``."""
    return (df.groupBy(patient, date).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("multi_day", flag(F.col("n") > 1)))


def max_date(df: DataFrame, date: str = DATE, out: str = "max_dt") -> DataFrame:
    """Newest date of the data set (one row; null dates ignored)."""
    return df.agg(F.max(date).alias(out))


def recent_count(df: DataFrame, patient: str = PATIENT, date: str = DATE,
                 days: int = 90, newest: DataFrame | None = None,
                 out: str = "three_mo_count") -> DataFrame:
    """Appointments per patient with date > newest date - ``days``.

    ``newest`` is a one-row DataFrame with ``max_dt`` (computed if absent);
    it enters the filter as a scalar subquery (evaluated once, no join).
    """
    newest = newest if newest is not None else max_date(df, date)
    cut = F.date_sub(newest.select("max_dt").scalar(), days)
    return (df.select(patient, date).where(F.col(date) > cut)
            .groupBy(patient).agg(F.count(F.lit(1)).alias(out)))


def share_within(df: DataFrame, count_col: str, by: list[str] | None = None,
                 out: str = "prop") -> DataFrame:
    """``count / sum(count)`` within groups (whole table when ``by`` is empty).

    With groups, the totals come from a window over the (already counted) rows,
    so the counts are computed once; null keys are a group.  Without groups the
    total is a scalar subquery: no task has to hold the table.
    """
    if not by:
        tot = df.agg(F.sum(count_col)).scalar()
        return df.withColumn(out, ratio(count_col, tot))
    return (df.withColumn("_tot", F.sum(count_col).over(Window.partitionBy(*by)))
            .withColumn(out, ratio(count_col, "_tot")).drop("_tot"))
