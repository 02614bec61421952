import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from apptflow.operators.features import (latest_rows, model_table, null_profile,
                                         patient_features)
from apptflow.operators.sequences import count_map, patient_sequences, probability_expr, sequence_counts
from apptflow.schemas import DISPLAY_NAMES, PRUNED_FEATURES
from tests.fixtures import APPT

D = dt.date


def test_latest_row_ties_and_null_dates(spark):
    rows = [(0, "a", "c", D(2024, 1, 1), 0, 0), (1, "a", "c", D(2024, 2, 1), 1, 0),
            (2, "a", "c", D(2024, 2, 1), 0, 0), (3, "b", "c", None, 1, 0),
            (4, "c", "c", None, 1, 0), (5, "c", "c", D(2023, 1, 1), 0, 0)]
    df = spark.createDataFrame(rows, APPT)
    got = {r.patient_id: r.appt_id for r in latest_rows(df).collect()}
    assert got == {"a": 1, "c": 5}
    f = {r.patient_id: (r.appt_id, r.multi_day)
         for r in patient_features(df, min_count=1, materialize=False).collect()}
    assert f == {"a": (1, 1), "c": (5, 0)}


def test_a_row_looks_its_probability_up_once(spark):
    """The counts are looked up for each distinct history, a patient's row reads one
    entry an event: the figures are those of the expression over the counts."""
    rng = np.random.default_rng(2)
    rows = [(i, f"p{i % 40}", "c", None if rng.random() < 0.02 else D(2024, 1, 1 + int(rng.integers(0, 20))), int(rng.integers(0, 2)),
             int(rng.integers(0, 2))) for i in range(150)]
    df = spark.createDataFrame(rows, APPT)
    f = patient_features(df, min_count=1, materialize=False)
    names = {"dna_flag": "dna", "cancel_flag": "cancel"}
    seqs = patient_sequences(df, names)
    rate = df.agg(F.avg("dna_flag"), F.avg("cancel_flag")).first()
    for i, e in enumerate(names.values()):
        m = count_map(sequence_counts(seqs, f"full_{e}")).scalar()
        want = {r[0]: rate[i] if r[1] is None else r[1]
                for r in seqs.where("latest is not null").select("patient_id", probability_expr(f"history_{e}", m)).collect()}
        got = {r[0]: r[1] for r in f.select("patient_id", f"{e}_markov").collect()}
        assert got == pytest.approx(want, abs=1e-12) and len(set(want.values())) > 3
    lines = [ln for ln in f._jdf.queryExecution().analyzed().toString().splitlines() if "AS dna_markov" in ln]
    assert lines and all(ln.count("try_element_at(") <= 2 for ln in lines)


def test_model_table_names(spark):
    rows = [(0, "a", "c", D(2024, 1, 1), 0, 0), (1, "a", "c", D(2024, 2, 1), 1, 0)]
    f = patient_features(spark.createDataFrame(rows, APPT), min_count=1)
    m = model_table(f)
    assert set(m.columns) == {"dna_flag", DISPLAY_NAMES["dna_markov"],
                              DISPLAY_NAMES["cancel_markov"], DISPLAY_NAMES["clinic_prop"],
                              DISPLAY_NAMES["three_mo_count"], DISPLAY_NAMES["multi_day"]}
    assert not set(PRUNED_FEATURES) & set(m.columns)
    assert m.count() == 1


def test_null_profile(spark):
    rows = [(0, "a", None, None, 1, None), (1, "b", "c", D(2024, 1, 1), None, 0)]
    r = null_profile(spark.createDataFrame(rows, APPT)).first().asDict()
    assert r == {"appt_id": 0, "patient_id": 0, "clinic": 1, "appointment_dt": 1,
                 "dna_flag": 1, "cancel_flag": 1}
