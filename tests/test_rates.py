import datetime as dt

import pytest

from apptflow.operators import rates as R
from tests.fixtures import APPT

D = dt.date


def clinic_df(spark):
    rows = []
    i = 0

    def add(clinic, flags):
        nonlocal i
        for f in flags:
            rows.append((i, f"p{i}", clinic, D(2024, 1, 1), f, 0))
            i += 1
    add("big", [1, 0, 0, 1])          # large clinic, rate 1/2
    add("small", [1, 1])              # under min_count -> no rate
    add("zero", [0, 0, 0])            # large, no misses -> no rate
    add("Other", [1, 0])              # literally 'Other', small -> kept
    add(None, [1, None, 0])           # null clinic, large
    return spark.createDataFrame(rows, APPT)


def test_clinic_rates(spark):
    got = {r.clinic: r.clinic_prop for r in R.clinic_rates(clinic_df(spark), min_count=3).collect()}
    assert got == {"big": 0.5, "Other": 0.5, None: pytest.approx(1 / 3)}


def test_clinic_groups(spark):
    got = {r.clinic: r["count"] for r in R.clinic_groups(clinic_df(spark), min_count=3).collect()}
    assert got == {"big": 4, "zero": 3, None: 3, "Other": 4}


def test_overall_rate_counts_null_flags(spark):
    r = R.event_rate(clinic_df(spark)).first()
    assert r.rate == pytest.approx(6 / 14)


def test_supported_rows_null_safe(spark):
    rows = R.supported_clinic_rows(clinic_df(spark), min_count=3).collect()
    assert sorted({str(r.clinic) for r in rows}) == ["None", "Other", "big", "zero"]


def test_recent_count_edges(spark):
    mx = D(2024, 6, 30)
    rows = [(0, "a", "c", mx, 0, 0), (1, "a", "c", mx - dt.timedelta(days=89), 0, 0),
            (2, "a", "c", mx - dt.timedelta(days=90), 0, 0), (3, "b", "c", None, 0, 0),
            (4, "b", "c", mx - dt.timedelta(days=200), 0, 0)]
    got = {r.patient_id: r.three_mo_count
           for r in R.recent_count(spark.createDataFrame(rows, APPT), days=90).collect()}
    assert got == {"a": 2}


def test_same_day(spark):
    rows = [(0, "a", "c", D(2024, 1, 1), 0, 0), (1, "a", "c", D(2024, 1, 1), 1, 0),
            (2, "a", "c", D(2024, 1, 2), 0, 0), (3, "a", "c", None, 0, 0),
            (4, "a", "c", None, 0, 0)]
    got = {(r.appointment_dt, r.n, r.multi_day)
           for r in R.same_day(spark.createDataFrame(rows, APPT)).collect()}
    assert got == {(D(2024, 1, 1), 2, 1), (D(2024, 1, 2), 1, 0), (None, 2, 1)}


def test_share_within(spark):
    df = spark.createDataFrame([("x", 1), ("x", 3), ("y", 2)], "g string, c long")
    got = {(r.g, r.c): r.prop for r in R.share_within(df, "c", ["g"]).collect()}
    assert got == {("x", 1): 0.25, ("x", 3): 0.75, ("y", 2): 1.0}
    tot = {r.c: r.prop for r in R.share_within(df, "c").collect()}
    assert tot == {1: 1 / 6, 3: 0.5, 2: 1 / 3}


def test_empty_input_gives_null_rates(spark):
    from tests.fixtures import APPT as A
    r = R.event_rate(spark.createDataFrame([], A)).first()
    assert r.rate is None and r.cancel_rate is None


def test_no_history_marginal_without_short_sequences(spark):
    from apptflow.operators import sequences as S
    df = spark.createDataFrame([("p", "0101")], "patient_id string, sequence string")
    assert S.no_history_marginal(df, "sequence").first()[0] is None
