"""Random appointment tables with nulls and ties: feature table vs a literal
pandas rendering of the documented steps (SURVEY §2.4, §2.10, §2.11)."""

import datetime as dt
import random

import pandas as pd
import pytest

from apptflow.operators.features import patient_features
from tests.fixtures import APPT

MIN_COUNT, DAYS, ORDER = 4, 10, 6


def random_rows(seed):
    rnd = random.Random(seed)
    rows, aid = [], 0
    for p in range(rnd.randint(3, 12)):
        for _ in range(rnd.randint(1, 14)):
            d = None if rnd.random() < 0.08 else dt.date(2024, 1, 1) + dt.timedelta(
                days=rnd.randint(0, 25))
            fl = lambda: rnd.choice([0, 1, 1, 0, None])
            clinic = rnd.choice(["a", "b", "c", "Other", None])
            rows.append((aid, None if p == 0 else f"p{p}", clinic, d, fl(), fl()))
            aid += 1
    rnd.shuffle(rows)   # file order = appt_id, not the list order
    return rows


def ch(v):
    return "" if v is None or pd.isna(v) else str(int(v))


def brute(rows):
    df = pd.DataFrame(rows, columns=[f.name for f in APPT.fields]).sort_values("appt_id")
    df["patient_id"] = df.patient_id.fillna("<NA>")   # R groups NA as one patient
    n = len(df)
    rate = (df.dna_flag == 1).sum() / n
    crate = (df.cancel_flag == 1).sum() / n
    cl = df.assign(k=df.clinic.fillna("<NA>")).groupby("k")
    size, ones = cl.size(), cl.dna_flag.apply(lambda s: (s == 1).sum())
    cprop = {k: ones[k] / size[k] for k in size.index
             if (size[k] >= MIN_COUNT or k == "Other") and ones[k] > 0}
    maxd = df.appointment_dt.dropna().max()
    out = {}
    seqs = {"dna_flag": {}, "cancel_flag": {}}
    for p, g in df.groupby("patient_id"):
        g = g.assign(nul=g.appointment_dt.isna(),
                     d=g.appointment_dt.fillna(dt.date(1900, 1, 1)))
        g = g.sort_values(["nul", "d", "appt_id"], ascending=[True, False, True])
        for ev in seqs:
            full = "".join(ch(v) for v in g[ev].head(ORDER))
            if g.nul.any():
                hist = None
            else:
                rest = g[g.d < g.d.max()]
                hist = "".join(ch(v) for v in rest[ev].head(ORDER - 1)) if len(rest) else None
            seqs[ev][p] = (full, hist)
    for ev in seqs:
        counts = pd.Series([f for f, _ in seqs[ev].values()]).value_counts().to_dict()

        def prob(h):
            k1, k0 = "1" + h, "0" + h
            if k1 in counts and k0 in counts:
                return counts[k1] / (counts[k0] + counts[k1])
            b1, b0 = k1[:-1], k0[:-1]
            if b1 in counts and b0 in counts:
                return counts[b1] / (counts[b0] + counts[b1])
            return None
        seqs[ev] = {p: (prob(h) if h is not None else None) for p, (_, h) in seqs[ev].items()}
    for p, g in df.groupby("patient_id"):
        dated = g[g.appointment_dt.notna()]
        if dated.empty:
            continue
        last = dated[dated.appointment_dt == dated.appointment_dt.max()].iloc[0]
        same = (g.appointment_dt == last.appointment_dt).sum()
        recent = (dated.appointment_dt > maxd - dt.timedelta(days=DAYS)).sum()
        k = "<NA>" if last.clinic is None or pd.isna(last.clinic) else last.clinic
        pd_ = seqs["dna_flag"][p]
        pc = seqs["cancel_flag"][p]
        out[p] = (int(last.appt_id), rate if pd_ is None else pd_, crate if pc is None else pc,
                  cprop.get(k, rate), int(recent), int(same > 1))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5, 6])
def test_features_match_bruteforce(spark, seed):
    rows = random_rows(seed)
    f = patient_features(spark.createDataFrame(rows, APPT).repartition(3),
                         min_count=MIN_COUNT, days=DAYS, materialize=False)
    got = {(r.patient_id or "<NA>"): (r.appt_id, r.dna_markov, r.cancel_markov, r.clinic_prop,
                          r.three_mo_count, r.multi_day) for r in f.collect()}
    exp = brute(rows)
    assert set(got) == set(exp)
    for p in exp:
        g, e = got[p], exp[p]
        assert g[0] == e[0] and g[4:] == e[4:], (p, g, e)
        assert g[1:4] == pytest.approx(e[1:4], abs=1e-12), (p, g, e)
