"""Feature assembly, one row per patient, model table.

Spark-first restructuring of the reference's flow: the reference attaches every
derived column to *all* appointment rows and only then keeps each patient's
latest row.  Every attached value is keyed by patient (or by clinic, or by the
latest row's own day), so attaching to the latest row only gives the same
table while joining patient-level tables instead of the appointment table.

The table is scanned three times: a partial aggregate by clinic (rates, clinic
rates, newest date); the sequence pass (two shuffles, by patient and day, then by
patient, each pre-limited map-side) for sequences, the same-day flag and the latest
row, whose columns it carries; and a count of the recent rows by patient, hashed
before its shuffle.  One-row values (rates, count maps) enter as scalar subqueries;
the clinic join is left to AQE, which broadcasts it only after measuring its size;
the remaining join is between patient-level tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe
from ..session import cut_lineage
from ..schemas import (CANCEL, CLINIC, DATE, DISPLAY_NAMES, DNA, ID_COLUMNS,
                       PATIENT, PRUNED_FEATURES, TIEBREAK)
from .rates import clinic_rates_from_stats, clinic_stats, rates_from_stats
from .sequences import count_map, patient_sequences, probability_map, sequence_counts


def latest_rows(df: DataFrame, patient: str = PATIENT, date: str = DATE,
                tiebreak: str = TIEBREAK) -> DataFrame:
    """Each patient's latest appointment (first row of the newest
    date; patients with only null dates are dropped).  Rank filter = 1 is
    planned as a partial WindowGroupLimit before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy(patient).orderBy(F.col(date).desc_nulls_last(),
                                            F.col(tiebreak).asc())
    return (df.withColumn("_rn", F.row_number().over(w))
            .where((F.col("_rn") == 1) & F.col(date).isNotNull()).drop("_rn"))


def patient_features(appts: DataFrame, min_count: int = 500, days: int = 90,
                     order: int = 6, patient: str = PATIENT, clinic: str = CLINIC,
                     date: str = DATE, tiebreak: str = TIEBREAK, dna: str = DNA,
                     cancel: str = CANCEL, no_history_marginal: bool = False,
                     materialize: bool = True) -> DataFrame:
    """G1 + G2 + G5: latest appointment of every patient with all derived
    features, imputed as the reference does (overall rate for the sequence
    and clinic probabilities, 0 for the recent count).

    ``no_history_marginal=True`` gives patients without history the marginal
    c('1')/(c('0')+c('1')) instead of the overall rate (the reference's stored
    but unreachable value).

    ``materialize`` writes the two intermediate tables that have several
    consumers (per-clinic stats, per-patient sequences) with a reliable
    ``checkpoint`` to ``spark.checkpoint.dir``: each is computed once, and a
    lost executor does not force recomputation from the scan.
    """
    stats = clinic_stats(appts, clinic, flags=(dna, cancel), date=date)
    if materialize:
        stats = cut_lineage(stats)
    scal = rates_from_stats(stats, {dna: "rate", cancel: "cancel_rate"})
    crates = clinic_rates_from_stats(stats, clinic, dna, min_count)
    rest = [c for c in appts.columns if c not in (patient, date, tiebreak, dna, cancel)]
    seqs = patient_sequences(appts, {dna: "dna", cancel: "cancel"}, patient=patient,
                             date=date, tiebreak=tiebreak, order=order, carry=rest)
    if materialize:
        seqs = cut_lineage(seqs)
    # one-row values enter as scalar subqueries (each evaluated once, no join)
    p_dna, p_cancel = (F.try_element_at(probability_map(seqs, f"full_{e}", f"history_{e}").scalar(), F.col(f"history_{e}"))
                       for e in ("dna", "cancel"))
    rate, cancel_rate = scal.select("rate").scalar(), scal.select("cancel_rate").scalar()

    if no_history_marginal:
        m_dna, m_cancel = (count_map(sequence_counts(seqs, f"full_{e}")).scalar() for e in ("dna", "cancel"))
        p_dna = F.when(F.col("history_dna").isNull(), _marginal(m_dna)).otherwise(p_dna)
        p_cancel = F.when(F.col("history_cancel").isNull(),
                          _marginal(m_cancel)).otherwise(p_cancel)
    last = (seqs.where(F.col("latest").isNotNull())
            .select(*[F.col(c) if c == patient else F.col(f"latest.{c}").alias(c) for c in appts.columns],
                    F.coalesce(p_dna, rate).alias("dna_markov"),
                    F.coalesce(p_cancel, cancel_rate).alias("cancel_markov"),
                    F.col("multi_day"), rate.alias("rate")))
    newest = scal.select("max_dt").scalar()
    recent = (appts.where(F.col(date) > F.date_sub(newest, days)).groupBy(F.col(patient).alias("_p"))
              .agg(F.count(F.lit(1)).alias("_recent")))
    # the patient-keyed join first, the clinic lookup last (AQE broadcasts it when
    # measured small)
    base = (last.join(recent, F.col(patient).eqNullSafe(F.col("_p")), "left")
            .withColumn("three_mo_count", F.coalesce("_recent", F.lit(0).cast("long"))).drop("_p", "_recent"))
    cr = crates.withColumnRenamed(clinic, "_clinic")
    return (base.join(cr, base[clinic].eqNullSafe(cr["_clinic"]), "left")
            .withColumn("clinic_prop", F.coalesce(F.col("clinic_prop"), F.col("rate")))
            .drop("_clinic", "rate"))


def _marginal(m):
    c1 = F.try_element_at(m, F.lit("1"))
    c0 = F.try_element_at(m, F.lit("0"))
    return F.when(c1.isNotNull() & c0.isNotNull(),
                  F.try_divide(c1.cast("double"), (c0 + c1).cast("double")))


def model_table(features: DataFrame, label: str = DNA, prune: bool = True,
                drop=ID_COLUMNS, keep=()) -> DataFrame:
    """G3 + G4 (P2, P3): drop ids, rename to display names, prune.

    Renaming is the last step so every earlier stage keeps plain names.
    """
    cols = [c for c in features.columns if c not in drop or c in keep]
    renamed = [F.col(c).alias(c if c in keep else DISPLAY_NAMES.get(c, c)) for c in cols]
    out = features.select(*renamed)
    if prune:
        out = out.drop(*PRUNED_FEATURES)
    return out


def null_profile(df: DataFrame) -> DataFrame:
    """P10: null count of every column, one aggregate, one row."""
    return df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c)
                    for c in df.columns])
