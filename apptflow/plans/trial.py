"""Reminder trial driven by the model (X1–X4 with model probabilities).

The fitted model scores every patient's feature row; each appointment gets
its patient's probability (a patient-keyed join: AQE splits a skewed
patient partition, the patient side has one row per key), then bands,
arms, reminders and the outcome follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe
from ..session import cut_lineage
from ..operators.model import assemble, score
from ..operators.trial import assign_arms, assign_bands, reminder_schedule, trial_outcome
from ..schemas import DATE, DNA, PATIENT, TIEBREAK


def patient_probabilities(model, table: DataFrame, features: list[str], rounds: int | None,
                          key: str = PATIENT, label: str = DNA) -> DataFrame:
    """(patient, probability) from a fitted run over a model table."""
    x = assemble(table.where(F.col(label).isNotNull()), features, label, keep=[key])
    return score(model, x, len(features), 0.5, rounds=rounds).select(key, "probability")


def run_trial(appts: DataFrame, probs: DataFrame, cut: float = 0.5, seed=2024,
              key: str = PATIENT, appt: str = TIEBREAK, date: str = DATE,
              outcome: str = DNA):
    """Returns (arms, reminders, outcome) DataFrames."""
    base = join_null_safe(appts.select(appt, key, date, outcome), probs, [key])
    # the arm assignment reads its input twice (the patients, their appointments)
    base = cut_lineage(assign_bands(base, "probability", cut))
    arms = assign_arms(base, key, "band", seed)
    return arms, reminder_schedule(arms, appt, date), trial_outcome(arms, outcome=outcome)
