"""Four-arm reminder trial.

Bands by predicted probability, a random 50:50 intervention/control split
inside each band, the reminder schedule (intervention: 5 and 3 days before,
control: 5 days before) and the outcome analysis (miss rate per arm,
absolute difference, pooled two-proportion z statistic).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import join_null_safe
from ..schemas import DATE, DNA, PATIENT, TIEBREAK
from ..session import cut_lineage
from .sampling import half_split

# Reminder offsets in days before the appointment.
INTERVENTION_DAYS = [5, 3]
CONTROL_DAYS = [5]


def assign_bands(df: DataFrame, prob: str, cut: float = 0.5, out: str = "band") -> DataFrame:
    """X1: 'high' when probability >= cut, else 'low'."""
    return df.withColumn(out, F.when(F.col(prob) >= cut, F.lit("high")).otherwise(F.lit("low")))


def assign_arms(df: DataFrame, key: str = PATIENT, band: str = "band", seed=0,
                out: str = "arm") -> DataFrame:
    """Exact 50:50 intervention / control of the patients in every band; all
    appointments of a patient get the patient's arm, so the arms are independent."""
    patients = half_split(df.select(key, band).distinct(), key, [band], seed, out)
    return join_null_safe(df, patients, [key, band])


def reminder_schedule(df: DataFrame, key: str = TIEBREAK, date: str = DATE,
                      arm: str = "arm") -> DataFrame:
    """One row per reminder: (key, arm, days_before, reminder_dt)."""
    days = F.when(F.col(arm) == "intervention",
                  F.array(*[F.lit(d) for d in INTERVENTION_DAYS])).otherwise(
        F.array(*[F.lit(d) for d in CONTROL_DAYS]))
    return (df.select(key, date, arm, F.explode(days).alias("days_before"))
            .withColumn("reminder_dt", F.date_sub(F.col(date), F.col("days_before"))))


def two_sided_p(z) -> "F.Column":
    """P(|Z| >= |z|) for a standard normal, erfc(|z| / sqrt 2): one value a band."""
    @F.pandas_udf(T.DoubleType())
    def p(z):
        import math
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else None).astype("float64")
    return p(z)


def trial_outcome(df: DataFrame, band: str = "band", arm: str = "arm",
                  outcome: str = DNA) -> DataFrame:
    """Per band, miss rate per arm, control - intervention, pooled z.

    One aggregate by band with conditional counts (no pivot job needed).
    """
    iv, ct = F.col(arm) == "intervention", F.col(arm) == "control"
    miss = F.col(outcome) == 1
    g = df.groupBy(band).agg(
        F.count(F.when(iv, 1)).alias("n_intervention"),
        F.count(F.when(iv & miss, 1)).alias("miss_intervention"),
        F.count(F.when(ct, 1)).alias("n_control"),
        F.count(F.when(ct & miss, 1)).alias("miss_control"))
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    p1, p0 = d("miss_intervention", "n_intervention"), d("miss_control", "n_control")
    pooled = F.try_divide((F.col("miss_intervention") + F.col("miss_control")).cast("double"),
                          (F.col("n_intervention") + F.col("n_control")).cast("double"))
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) *
                (F.try_divide(F.lit(1.0), F.col("n_intervention").cast("double")) +
                 F.try_divide(F.lit(1.0), F.col("n_control").cast("double"))))
    return g.select(
        band, "n_intervention", "miss_intervention", "n_control", "miss_control",
        p1.alias("rate_intervention"), p0.alias("rate_control"),
        (p0 - p1).alias("abs_reduction"),
        F.try_divide(p0 - p1, se).alias("z"),
        two_sided_p(F.try_divide(p0 - p1, se)).alias("p_value"))


REPLICATES = 1024        # re-randomisations, 128 to an md5


def clustered_outcome(df: DataFrame, patient: str = PATIENT, band: str = "band", arm: str = "arm", outcome: str = DNA,
                      replicates: int = REPLICATES, seed=0) -> DataFrame:
    """X4 with the patient as the unit, as arms go by patient: a row a band with
    patients, appointments and misses of both arms, the difference of miss rates
    (control - intervention), its cluster-robust standard error and z, and the share
    of re-randomisations whose difference is at least as large either way.

    Robust variance of an arm's rate p: m / (m - 1) * sum over its m patients of
    (misses - p * appointments)^2, over appointments squared; the squares open up into
    sums of integers, so one aggregate of patients serves.  In replicate r a patient's
    arm is bit r of md5(patient | seed | r // 128): every task adds its patients to all
    replicates at once, and all replicates are one aggregate.  Null outcomes are no
    misses.  Without patients in both arms, or two in each for z, figures are null."""
    per = df.groupBy(band, patient, arm).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(outcome) == 1, 1)).alias("y"))
    # a row a patient, read by the sums and by the replicates: written once
    per = cut_lineage(per.select(F.col(band).alias("b"), F.col(patient).cast("string").alias("p"), F.col(arm).alias("a"), "n", "y"))
    aggs = []
    for a in ("intervention", "control"):
        own = F.col("a") == a
        aggs += [F.count(F.when(own, 1)).alias(f"m_{a}")]
        aggs += [F.sum(F.when(own, x).otherwise(0)).alias(f"{k}_{a}") for k, x in {
            "n": F.col("n"), "y": F.col("y"), "yy": F.col("y") * F.col("y"), "yn": F.col("y") * F.col("n"),
            "nn": F.col("n") * F.col("n")}.items()]
    one = per.groupBy("b").agg(*aggs)

    def d(x):
        return F.col(x).cast("double")

    def variance(a):
        rate = F.try_divide(d(f"y_{a}"), d(f"n_{a}"))
        ss = d(f"yy_{a}") - F.lit(2.0) * rate * d(f"yn_{a}") + rate * rate * d(f"nn_{a}")
        return F.try_divide(d(f"m_{a}") * F.greatest(ss, F.lit(0.0)), (d(f"m_{a}") - 1) * d(f"n_{a}") * d(f"n_{a}"))

    p1, p0 = (F.try_divide(d(f"y_{a}"), d(f"n_{a}")) for a in ("intervention", "control"))
    out = one.withColumn("rate_intervention", p1).withColumn("rate_control", p0).withColumn("abs_reduction", p0 - p1) \
        .withColumn("se_clustered", F.sqrt(variance("intervention") + variance("control"))) \
        .withColumn("z_clustered", F.try_divide("abs_reduction", "se_clustered"))
    rep = _replicates(per, replicates, seed).join(out.select(F.col("b").alias("_b"), "abs_reduction"), F.col("b").eqNullSafe(F.col("_b")))
    diff = F.try_divide(d("y0"), d("n0")) - F.try_divide(d("y1"), d("n1"))
    share = rep.groupBy(F.col("b").alias("_b")).agg(
        F.count(F.when(F.abs(diff) >= F.abs("abs_reduction") - 1e-12, 1)).alias("as_large"), F.count(diff).alias("replicates"))
    return out.join(share, F.col("b").eqNullSafe(F.col("_b")), "left").select(
        F.col("b").alias(band), F.col("m_intervention").alias("patients_intervention"), F.col("m_control").alias("patients_control"),
        *[F.col(f"{k}_{a}").alias(f"{v}_{a}") for a in ("intervention", "control") for k, v in (("n", "n"), ("y", "miss"))],
        "rate_intervention", "rate_control", "abs_reduction", "se_clustered", "z_clustered",
        F.try_divide(F.col("as_large").cast("double"), F.col("replicates").cast("double")).alias("p_rerandomised"))


def _replicates(per: DataFrame, replicates: int, seed) -> DataFrame:
    """(b, r, n1, y1, n0, y0): appointments and misses of both arms in each
    re-randomisation, of patients (b, p, n, y)."""
    import numpy as np
    import pyarrow as pa
    words = -(-replicates // 128)
    bits = F.concat(*[F.unhex(F.md5(F.concat_ws("|", "p", F.lit(str(seed)), F.lit(str(k))))) for k in range(words)])
    src = per.select("b", "n", "y", bits.alias("bits"))

    def run(batches):
        acc: dict = {}
        for batch in batches:
            b = batch.column(0).to_pylist()
            n, y = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            raw = np.stack([np.frombuffer(x, np.uint8) for x in batch.column(3).to_pylist()])
            on = np.unpackbits(raw, axis=1)[:, :replicates].astype(bool)
            for k in set(b):
                at = np.array([v == k if k is not None else v is None for v in b])
                v = np.stack([np.where(on[at], x[at][:, None], 0).sum(axis=0) for x in (n, y)]
                             + [np.where(on[at], 0, x[at][:, None]).sum(axis=0) for x in (n, y)])
                acc[k] = acc[k] + v if k in acc else v
        for k, v in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * replicates, batch.schema.field(0).type), pa.array(np.arange(replicates)),
                                              *[pa.array(x) for x in v]], ["b", "r", "n1", "y1", "n0", "y0"])

    kind = per.schema["b"].dataType.simpleString()
    sums = src.mapInArrow(run, f"b {kind}, r long, n1 long, y1 long, n0 long, y0 long")
    return sums.groupBy("b", "r").agg(*[F.sum(c).alias(c) for c in ("n1", "y1", "n0", "y0")])
