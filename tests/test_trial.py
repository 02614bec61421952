import random
import pytest
import datetime as dt
import math

from apptflow.operators import trial as TR


def test_bands_arms_reminders_outcome(spark):
    rows = [(i, i, dt.date(2024, 2, 10), 0.9 if i < 40 else 0.1, 1 if i % 4 == 0 else 0)
            for i in range(100)]
    df = spark.createDataFrame(rows, "appt_id long, patient_id long, appointment_dt date, p double, dna_flag int")
    b = TR.assign_bands(df, "p", 0.5)
    a = TR.assign_arms(b, "patient_id", "band", seed=1)
    c = {(r.band, r.arm): r["count"] for r in a.groupBy("band", "arm").count().collect()}
    assert c == {("high", "intervention"): 20, ("high", "control"): 20,
                 ("low", "intervention"): 30, ("low", "control"): 30}
    rem = TR.reminder_schedule(a)
    assert rem.count() == 50 * 2 + 50
    days = {(r.arm, r.days_before, r.reminder_dt) for r in rem.collect()}
    assert ("intervention", 3, dt.date(2024, 2, 7)) in days
    assert ("control", 5, dt.date(2024, 2, 5)) in days
    assert not any(a_ == "control" and d == 3 for a_, d, _ in days)
    out = {r.band: r for r in TR.trial_outcome(a).collect()}
    h = out["high"]
    p1, p0 = h.miss_intervention / 20, h.miss_control / 20
    pp = (h.miss_intervention + h.miss_control) / 40
    z = (p0 - p1) / math.sqrt(pp * (1 - pp) * (1 / 20 + 1 / 20)) if 0 < pp < 1 else None
    assert h.abs_reduction == p0 - p1
    assert (h.z is None and z is None) or abs(h.z - z) < 1e-12


def test_arms_are_drawn_by_patient(spark):
    rows = [(i, i % 37 if i % 37 else None, "high" if i % 37 < 20 else "low") for i in range(1000)]
    a = TR.assign_arms(spark.createDataFrame(rows, "appt_id long, patient_id long, band string"), seed=3)
    assert a.count() == 1000
    per = a.groupBy("patient_id").agg({"arm": "count"}).count()
    arms = a.select("patient_id", "band", "arm").distinct().collect()
    assert len(arms) == per == 37                              # no patient in two arms
    for band, n in (("high", 20), ("low", 17)):
        assert sum(r.arm == "intervention" for r in arms if r.band == band) in (n // 2, n - n // 2)


def test_two_sided_p_value(spark):
    """Published values of the normal distribution, far tails included."""
    known = {0.0: 1.0, 1.0: 0.31731050786291410, -1.959963984540054: 0.05, 2.5758293035489004: 0.01,
             3.0: 0.0026997960632601866, 6.0: 1.9731752900753855e-09, 10.0: 1.523970604832105e-23}
    df = spark.createDataFrame([(z,) for z in known] + [(None,)], "z double")
    got = {r.z: r.p for r in df.select("z", TR.two_sided_p(df.z).alias("p")).collect()}
    assert got.pop(None) is None
    for z, p in known.items():
        assert math.isclose(got[z], p, rel_tol=1e-12)


def test_run_trial_plan(spark):
    from pyspark.sql import functions as F

    from apptflow.operators.features import patient_features
    from apptflow.plans.trial import run_trial
    from apptflow.sources import appointments_from_orders
    a = appointments_from_orders(spark, "/root/testdata/sf0.001")
    probs = patient_features(a, min_count=50).select(
        "patient_id", F.col("dna_markov").alias("probability"))
    arms, rem, out = run_trial(a, probs, cut=0.4, seed=7)
    assert arms.count() == a.count()
    c = {(r.band, r.arm): r["count"] for r in arms.groupBy("band", "arm").count().collect()}
    by = {(r.band, r.arm): r["n"] for r in arms.groupBy("band", "arm").agg(F.countDistinct("patient_id").alias("n")).collect()}
    for band in {b for b, _ in c}:
        assert abs(by.get((band, "intervention"), 0) - by.get((band, "control"), 0)) <= 1
    n_iv = sum(v for (b, arm), v in c.items() if arm == "intervention")
    assert rem.count() == 2 * n_iv + (a.count() - n_iv)
    assert {r.band for r in out.collect()} == {b for b, _ in c}


def test_clustered_outcome_by_hand(spark):
    from apptflow.operators.trial import clustered_outcome
    rnd = random.Random(3)
    rows = [(b, f"{b}{i}", "intervention" if i % 2 else "control", rnd.choice([0, 1, 1, None])) for b in ("high", None) for i in range(12)
            for _ in range(rnd.randint(1, 5))] + [("one", "x", "control", 1)]
    got = {r.band: r for r in clustered_outcome(spark.createDataFrame(rows, "band string, patient_id string, arm string, dna_flag int"),
                                                replicates=200).collect()}
    assert set(got) == {"high", None, "one"}
    for b in ("high", None):
        rate, var = {}, {}
        for arm in ("intervention", "control"):
            per = {}
            for band, p, a, y in rows:
                if (band, a) == (b, arm):
                    n, m = per.get(p, (0, 0))
                    per[p] = n + 1, m + (y == 1)
            n, y = (sum(v[i] for v in per.values()) for i in (0, 1))
            rate[arm] = y / n
            var[arm] = len(per) / (len(per) - 1) * sum((v[1] - rate[arm] * v[0]) ** 2 for v in per.values()) / n**2
        r = got[b]
        assert r.abs_reduction == pytest.approx(rate["control"] - rate["intervention"])
        assert r.se_clustered == pytest.approx(sum(var.values()) ** 0.5)
        assert r.z_clustered == pytest.approx(r.abs_reduction / r.se_clustered) and 0 < r.p_rerandomised <= 1
    assert got["one"].z_clustered is None and got["one"].patients_control == 1


def test_clustered_z_keeps_its_level_where_appointments_of_a_patient_are_alike(spark):
    """4,000 trials without an effect, a band each, of 60 patients with 1 to 8
    appointments that share the patient's own miss rate."""
    import numpy as np
    from apptflow.operators.trial import clustered_outcome
    rng = np.random.default_rng(6)
    bands, patients = 4000, 60
    p = rng.beta(0.4, 0.8, (bands, patients))
    n = rng.integers(1, 9, (bands, patients))
    arm = rng.permuted(np.tile(np.arange(patients) % 2, (bands, 1)), axis=1)
    b, i = np.divmod(np.repeat(np.arange(bands * patients), n.ravel()), patients)
    y = rng.random(len(b)) < p[b, i]
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"band": b, "patient_id": b * patients + i, "arm": np.where(arm[b, i], "intervention", "control"),
                                             "dna_flag": y.astype(int)}))
    from apptflow.operators.trial import trial_outcome
    z = np.array([r[0] for r in clustered_outcome(df, replicates=1).select("z_clustered").collect()])
    naive = np.array([r[0] for r in trial_outcome(df).select("z").collect()])
    # 60 patients: the normal limit is a little small for 58 degrees of freedom
    assert abs((np.abs(z) > 2.0017).mean() - 0.05) < 0.01
    assert (np.abs(naive) > 1.96).mean() > 0.15


def test_rerandomisation_finds_an_effect_and_no_other(spark):
    import numpy as np
    from apptflow.operators.trial import clustered_outcome
    rng = np.random.default_rng(7)
    rows = [(band, f"{band}{i}", "intervention" if i % 2 else "control", int(rng.random() < (0.5 - 0.25 * (i % 2) * (band == "effect"))))
            for band in ("effect", "none") for i in range(150) for _ in range(3)]
    got = {r.band: r.p_rerandomised for r in clustered_outcome(spark.createDataFrame(rows, "band string, patient_id string, arm string, dna_flag int")).collect()}
    assert got["effect"] < 0.01 and got["none"] > 0.05
