"""

Query names are ``<survey id>_<slug>``; every query reads the driver's tables
through one of two appointment views (``orders``: sparse histories,
``events``: dense same-day histories) and runs over the whole tables.
"""

from __future__ import annotations

import importlib.util
import os
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from apptflow.operators import rates as R  # noqa: E402
from apptflow.operators import sequences as S  # noqa: E402
from apptflow.operators.features import (latest_rows, model_table,  # noqa: E402
                                         null_profile, patient_features)
from apptflow.operators import metrics as MT  # noqa: E402
from apptflow.operators import sampling as SM  # noqa: E402
from apptflow.operators import trial as TR  # noqa: E402
from apptflow.plans.features import appointments  # noqa: E402
from apptflow.schemas import DISPLAY_NAMES, METRIC_NAMES, PRUNED_FEATURES  # noqa: E402
from apptflow.sources.appointments import EVENTS_VIEW_SQL, ORDERS_VIEW_SQL  # noqa: E402

# The training-data operators are an optional subpackage: without it (or without
# the pipeline on top of it) everything else here works as it does with it.
def _optional(name: str):
    """The module, or None where it isn't there; its own import errors pass."""
    try:
        there = importlib.util.find_spec(name) is not None
    except ModuleNotFoundError:
        there = False
    return importlib.import_module(name) if there else None


_LLM = _optional("apptflow.llm.queries")
_PIPELINE = _optional("corpus_pipeline") if _LLM else None

SMOKE_DIR = "/root/testdata/sf0.001"
MIN_COUNT = 500          # reference's clinic support threshold
DAYS = 90                # reference's recent-count window


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: one model-ready row per patient (sequence, clinic, recent-count
    and same-day features) on sf0.001."""
    return model_table(patient_features(appointments(spark, SMOKE_DIR, "orders"),
                                        min_count=MIN_COUNT, days=DAYS))


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def _a(spark, sf, view="orders"):
    return appointments(spark, sf, view)


def _seq(spark, sf, view="orders", event="dna_flag"):
    return S.patient_sequences(_a(spark, sf, view), {event: "e"})


def _q_seq_probs(view):
    def q(spark, sf):
        s = _seq(spark, sf, view)
        return S.sequence_probabilities(s, "full_e", "history_e")
    return q


def _q_full(view):
    return lambda spark, sf: S.full_sequences(_a(spark, sf, view))


def _q_hist(view):
    return lambda spark, sf: S.history_sequences(_a(spark, sf, view))


def _q_features(view):
    return lambda spark, sf: patient_features(_a(spark, sf, view), min_count=MIN_COUNT, days=DAYS)


def _features(spark, sf):
    """Feature table written once (reliable checkpoint): the sampling and
    trial queries read it twice (bucket counts, then ranks)."""
    from apptflow.session import cut_lineage
    return cut_lineage(patient_features(_a(spark, sf), min_count=MIN_COUNT, days=90))


def _split(spark, sf, seed=1, feats=None):
    f = feats if feats is not None else _features(spark, sf)
    f = f.select("patient_id", "dna_flag", "dna_markov")
    return SM.stratified_split(f, "patient_id", "dna_flag", 0.75, seed)


def _train_down(spark, sf, seed=1):
    from apptflow.session import cut_lineage
    tr = cut_lineage(_split(spark, sf, seed)).where(F.col("split") == "train").drop("split")
    return SM.down_sample(tr, "patient_id", "dna_flag", seed)


def _markov_pred(spark, sf, seed=1, feats=None):
    """Test rows of run ``seed`` with the sequence probability as a score."""
    t = _split(spark, sf, seed, feats).where(F.col("split") == "test")
    return t.select(F.when(F.col("dna_markov") >= 0.5, 1).otherwise(0).alias("pred"),
                    F.col("dna_flag").alias("obs"))


RUNS = 25                # the reference's number of runs


def _mean_runs(spark, sf):
    """All runs in one job: the run is a grouping column and its number the seed."""
    f = _features(spark, sf).select("patient_id", "dna_flag", "dna_markov",
                                    F.explode(F.sequence(F.lit(1), F.lit(RUNS))).alias("run"))
    t = SM.stratified_split(f, "patient_id", "dna_flag", 0.75, F.col("run"), by=["run"]).where(F.col("split") == "test")
    t = t.select("run", F.when(F.col("dna_markov") >= 0.5, 1).otherwise(0).alias("pred"), F.col("dna_flag").alias("obs"))
    # summed in any order: the last digits of a mean of doubles are left out
    m = MT.mean_metrics(MT.confusion_metrics(t, by=["run"]))
    return m.select(*[F.round(f"`{c}`", 12).alias(c) for c in m.columns])


def _staged_auc(spark, sf):
    from apptflow.operators.model import staged_auc
    f = _features(spark, sf).where(F.col("dna_flag").isNotNull())
    return staged_auc(f, label="dna_flag", col="dna_markov").withColumn("aucpr", F.round("aucpr", 12))


def _trial_base(spark, sf):
    from apptflow.functions.columns import join_null_safe
    from apptflow.session import cut_lineage
    a = _a(spark, sf).select("appt_id", "patient_id", "appointment_dt", "dna_flag")
    p = _features(spark, sf).select("patient_id", F.col("dna_markov").alias("probability"))
    return cut_lineage(TR.assign_bands(join_null_safe(a, p, ["patient_id"]), "probability", 0.5))


def _trial_arms(spark, sf):
    return TR.assign_arms(_trial_base(spark, sf), "patient_id", "band", seed=2024)


_RUNS: dict = {}         # fitted runs of the last tables, and the seconds that they took


def _stamp(spark, *frames):
    """Name, length and time of every file that the frames read."""
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for f in sorted({f for d in frames for f in d.inputFiles()}):
        p = fs.Path(f)
        st = p.getFileSystem(conf).getFileStatus(p)
        out.append((f, st.getLen(), st.getModificationTime()))
    return tuple(out)


def _model_runs(spark, sf, runs):
    """Full runs of the reference's procedure (split, down-sample, 5 folds of 150
    rounds, fit, score), grown in lockstep.  The model queries share them while the
    application and the files that they were fitted on stay as they are."""
    from apptflow.operators.boosting import BoostParams
    from apptflow.plans.training import run_together
    from apptflow.session import cut_lineage
    k = (spark.sparkContext.applicationId, _stamp(spark, _a(spark, sf)))
    if _RUNS.get("key") != k or len(_RUNS["found"]) < runs:
        table = cut_lineage(model_table(_features(spark, sf), keep=("patient_id",)))
        began = time.time()
        found = run_together(table, list(range(1, runs + 1)), BoostParams(), date="2024-05-14")
        _RUNS.update(key=k, found=found, seconds=round(time.time() - began, 3))
    return _RUNS["found"][:runs]


def _model_run(spark, sf):
    return _model_runs(spark, sf, 1)[0]


def fit_seconds():
    """Seconds of the last fit (split to scored test sets), or None."""
    return _RUNS.get("seconds")


def _run_metrics(spark, sf):
    out = None
    for r in _model_runs(spark, sf, RUNS):
        out = r.metrics if out is None else out.unionByName(r.metrics)
    return out


def _trees(spark, sf):
    """Nodes of the final model of run 1, up to its best watched round."""
    from apptflow.operators.boosting import node_rows
    r = _model_run(spark, sf)
    return node_rows(spark, r.model.first(r.rounds), r.features)


def _root_splits(spark, sf):
    """The first split of each of run 1's models: five folds and the final one (5)."""
    from apptflow.operators.boosting import node_rows
    r = _model_run(spark, sf)
    out = None
    for m, f in enumerate(r.forests):
        t = node_rows(spark, f.first(1), r.features).where("node = 0").select(
            F.lit(m).alias("model"), "feature", "threshold", F.round("gain", 6).alias("gain"), F.round("cover", 6).alias("cover"))
        out = t if out is None else out.unionByName(t)
    return out


def _shap(spark, sf):
    from apptflow.operators.attribution import shap_values
    r = _model_run(spark, sf)
    return shap_values(r.model, r.train, r.features, "patient_id", rounds=r.rounds)[0]


def _perm_importance(spark, sf):
    from apptflow.operators.attribution import permutation_importance
    r = _model_run(spark, sf)
    return permutation_importance(r.model, r.scored.select("patient_id", "label", "x"), r.features, "patient_id", r.rounds)


def _model_trial(spark, sf):
    from apptflow.plans.trial import patient_probabilities, run_trial
    r = _model_run(spark, sf)
    table = model_table(_features(spark, sf), keep=("patient_id",))
    probs = patient_probabilities(r.model, table, r.features, r.rounds)
    return run_trial(_a(spark, sf), probs)


def _feature_matrix(spark, sf):
    """The numbers that the learner gets, a column for each feature; missing ones
    are null."""
    from apptflow.operators.model import assemble
    t = model_table(_features(spark, sf), keep=("patient_id",)).where(F.col("dna_flag").isNotNull())
    names = [c for c in t.columns if c not in ("patient_id", "dna_flag")]
    x = assemble(t, names, keep=["patient_id"])
    return x.select("patient_id", "label", *[F.col("x")[i].alias(c) for i, c in enumerate(names)])


def _csv_round_trip(spark, sf):
    """The orders view written to the shared folder as a file of the source's
    shape (its names, another column order) and read back."""
    from apptflow.schemas import SOURCE_NAMES
    from apptflow.session import shared_folder
    from apptflow.sources.appointments import read_appointments
    back = {v: k for k, v in SOURCE_NAMES.items()}
    a = _a(spark, sf)
    path = shared_folder(spark, "appointments")
    a.select(*[F.col(c).alias(back.get(c, c)) for c in sorted(a.columns, reverse=True)]).write.option("header", True).csv(path)
    return read_appointments(spark, path).select(*a.columns)


def _marked(spark, sf):
    """The orders view, and it as a file of the source's shape with missing ages
    (every 7th) and distances (every 11th) written as ``NA``."""
    from apptflow.schemas import SOURCE_NAMES
    from apptflow.session import shared_folder
    back, k = {v: k for k, v in SOURCE_NAMES.items()}, F.col("appt_id")
    a = _a(spark, sf).withColumn("age", F.when(k % 7 != 0, F.col("age"))).withColumn("travel_dist", F.when(k % 11 != 0, F.col("travel_dist")))
    path = shared_folder(spark, "appointments")
    a.select(*[F.col(c).alias(back.get(c, c)) for c in a.columns]).write.option("header", True).option("nullValue", "NA").csv(path)
    return a, path


def _na_round_trip(spark, sf):
    from apptflow.sources.appointments import read_appointments
    a, path = _marked(spark, sf)
    return read_appointments(spark, path).select(*a.columns)


def _inferred(spark, sf):
    """Types of the same file's columns, and of two more: whole numbers with one
    decimal value at the greatest id, and dates with one text value there."""
    from apptflow.session import shared_folder
    from apptflow.sources.typed_text import inferred_types, read_text
    a, path = _marked(spark, sf)
    text, last = read_text(spark, path), a.agg(F.max("appt_id")).scalar()
    late = _a(spark, sf).select(F.when(F.col("appt_id") == last, "0.5").otherwise(F.col("appt_id").cast("string")).alias("late_decimal"),
                                F.when(F.col("appt_id") == last, "unknown").otherwise(F.col("appointment_dt").cast("string")).alias("late_text"),
                                F.when(F.col("appt_id") % 2 == 0, "TRUE").alias("flag"), F.lit("NA").alias("none"))
    more = shared_folder(spark, "appointments")
    late.write.option("header", True).option("nullValue", "").csv(more)
    return inferred_types(text).unionByName(inferred_types(read_text(spark, more)))


def _clustered(spark, sf):
    return TR.clustered_outcome(_trial_arms(spark, sf), seed=2024)


def _metrics_round_trip(spark, sf):
    """Two runs' metrics written one after the other and read back."""
    from apptflow.session import shared_folder
    from apptflow.sources.results import read_run_metrics, write_run_metrics
    path, feats = shared_folder(spark, "runs"), _features(spark, sf)
    for r in (1, 2):
        write_run_metrics(MT.stamp(MT.confusion_metrics(_markov_pred(spark, sf, r, feats)), r, "2024-05-14"), path)
    return read_run_metrics(spark, path)


def _wide_view(spark, sf):
    """Appointments with a column for every model feature, the four pruned ones
    included, mapped from the order's keys and dates."""
    k = F.col("appt_id")
    return _a(spark, sf).select(
        "*", F.date_sub("appointment_dt", F.pmod(k, F.lit(60)).cast("int")).alias("letter_received_dt"),
        *[F.pmod(F.floor(k / d), F.lit(m)).cast("int").alias(c) for c, (d, m) in WIDE_COLUMNS.items()])


# Mapped columns: (divisor, modulus) of the order key.
WIDE_COLUMNS = {"hospital": (1, 4), "depriv_decile": (3, 10), "appointment_type": (2, 3), "referral_priority": (5, 3),
                "attendance_time": (7, 24), "suspected_cancer": (11, 2), "ref_source": (4, 5), "female_spec": (13, 2),
                "paed_spec": (17, 2), "physio_spec": (19, 2), "raei_leigh_tl": (23, 2), "tno_appt": (29, 2),
                "follow_up_appt": (31, 2)}


def _wide_model_table(spark, sf):
    from apptflow.functions.columns import lead_days
    a = _wide_view(spark, sf).withColumn("time_to_be_seen_days", lead_days("appointment_dt", "letter_received_dt"))
    return model_table(patient_features(a, min_count=MIN_COUNT, days=DAYS), prune=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from apptflow.functions.columns import lead_days
    from apptflow.operators.attribution import shap_plot_data, shap_summary
    found = {
        "s1_appointments": lambda spark, sf: _a(spark, sf, "orders"),
        "s1_appointments_events": lambda spark, sf: _a(spark, sf, "events"),
        "a1_overall_rates": lambda spark, sf: R.event_rate(_a(spark, sf)),
        "a2_clinic_groups": lambda spark, sf: R.clinic_groups(_a(spark, sf), min_count=MIN_COUNT),
        "a3_clinic_rates": lambda spark, sf: R.clinic_rates(_a(spark, sf), min_count=MIN_COUNT),
        "a4_same_day": lambda spark, sf: R.same_day(_a(spark, sf)),
        "a4_same_day_events": lambda spark, sf: R.same_day(_a(spark, sf, "events")),
        "a6_recent_count": lambda spark, sf: R.recent_count(_a(spark, sf), days=90),
        "a6_recent_count_events": lambda spark, sf: R.recent_count(_a(spark, sf, "events"), days=DAYS),
        "a7_max_date": lambda spark, sf: R.max_date(_a(spark, sf)),
        "p6_supported_clinic_rows": lambda spark, sf: R.supported_clinic_rows(
            _a(spark, sf), min_count=MIN_COUNT),
        "p7_distinct_histories": lambda spark, sf: S.history_sequences(
            _a(spark, sf)).select("sequence").distinct(),
        "p10_null_profile": lambda spark, sf: null_profile(_a(spark, sf)),
        "w1_appointment_rank": lambda spark, sf: S.rank_appointments(_a(spark, sf)),
        "w1_appointment_rank_events": lambda spark, sf: S.rank_appointments(_a(spark, sf, "events")),
        "w2_newest_rows": lambda spark, sf: S.newest_rows(_a(spark, sf), 6),
        "w2_newest_rows_events": lambda spark, sf: S.newest_rows(_a(spark, sf, "events"), 6),
        "m2_sequence_counts_events": lambda spark, sf: S.sequence_counts(
            S.full_sequences(_a(spark, sf, "events"))),
        "m7_no_history_marginal_events": lambda spark, sf: S.no_history_marginal(
            S.full_sequences(_a(spark, sf, "events")), "sequence"),
        "m8_markov_probability_events": lambda spark, sf: S.markov_probability(
            _a(spark, sf, "events")),
        "w3_history_rows": lambda spark, sf: S.rows_before_last_date(_a(spark, sf)),
        "w3_history_rows_events": lambda spark, sf: S.rows_before_last_date(_a(spark, sf, "events")),
        "w5_latest_rows": lambda spark, sf: latest_rows(_a(spark, sf)),
        "w5_latest_rows_events": lambda spark, sf: latest_rows(_a(spark, sf, "events")),
        "m1_full_sequences": _q_full("orders"),
        "m1_full_sequences_events": _q_full("events"),
        "m2_sequence_counts": lambda spark, sf: S.sequence_counts(S.full_sequences(_a(spark, sf))),
        "m3_history_sequences": _q_hist("orders"),
        "m3_history_sequences_events": _q_hist("events"),
        "m4_sequence_probability": _q_seq_probs("orders"),
        "m4_sequence_probability_events": _q_seq_probs("events"),
        "m7_no_history_marginal": lambda spark, sf: S.no_history_marginal(
            S.full_sequences(_a(spark, sf)), "sequence"),
        "m8_markov_probability": lambda spark, sf: S.markov_probability(_a(spark, sf)),
        "m8_markov_probability_cancel": lambda spark, sf: S.markov_probability(
            _a(spark, sf), "cancel_flag"),
        "g1_patient_features": _q_features("orders"),
        "g1_patient_features_events": _q_features("events"),
        "g3_model_table": lambda spark, sf: model_table(
            patient_features(_a(spark, sf), min_count=MIN_COUNT, days=90), prune=False),
        "g4_model_features": lambda spark, sf: model_table(
            patient_features(_a(spark, sf), min_count=MIN_COUNT, days=90)),
        "r1_pivot_events": lambda spark, sf: S.pivot_events(_a(spark, sf)),
        "u1_union_views": lambda spark, sf: _a(spark, sf, "orders").unionByName(
            _a(spark, sf, "events"), allowMissingColumns=True),
        "d1_stratified_split": lambda spark, sf: _split(spark, sf).drop("dna_markov"),
        "d3_down_sample": lambda spark, sf: _train_down(spark, sf).drop("dna_markov"),
        "d4_folds": lambda spark, sf: SM.assign_folds(
            _train_down(spark, sf).drop("dna_markov"), "patient_id", "dna_flag", 5, 1),
        "a10_cross_tab": lambda spark, sf: MT.cross_tab(_markov_pred(spark, sf)),
        "t7_markov_confusion": lambda spark, sf: MT.confusion_metrics(
            _markov_pred(spark, sf), with_counts=True),
        "t8_mean_metrics": _mean_runs,
        "x1_bands": lambda spark, sf: _trial_base(spark, sf).select("appt_id", "band"),
        "x2_arms": lambda spark, sf: _trial_arms(spark, sf).select("appt_id", "band", "arm"),
        "x3_reminders": lambda spark, sf: TR.reminder_schedule(_trial_arms(spark, sf)),
        # SQL has no normal distribution: the p-value has a query of its own
        "x4_trial_outcome": lambda spark, sf: TR.trial_outcome(_trial_arms(spark, sf)).drop("p_value"),
        "x4_trial_p_value": lambda spark, sf: TR.trial_outcome(_trial_arms(spark, sf)).select("band", "z", "p_value"),
        "s1_csv_roundtrip": _csv_round_trip,
        "s1_na_roundtrip": _na_round_trip,
        "s1_inferred_types": _inferred,
        "x4_clustered": _clustered,
        "s2_s3_metrics_roundtrip": _metrics_round_trip,
        "f8_lead_days": lambda spark, sf: _wide_view(spark, sf).select(
            "appt_id", lead_days("appointment_dt", "letter_received_dt").alias("lead_days")),
        "g3_wide_model_table": _wide_model_table,
        "g4_wide_model_features": lambda spark, sf: _wide_model_table(spark, sf).drop(*PRUNED_FEATURES),
        "r2_unite": lambda spark, sf: S.unite_columns(S.pivot_events(_a(spark, sf)), [str(i) for i in range(1, 7)])
            .select("patient_id", "sequence"),
        "t4_staged_auc": _staged_auc,
        "p9_feature_matrix": _feature_matrix,
        # model (rows-only: SQL has no form for boosting; its first splits have)
        "p9_training_matrix": lambda spark, sf: _model_run(spark, sf).train.select("patient_id", "fold", "label", "x"),
        "t2_newton_trees": _trees,
        "t2_root_splits": _root_splits,
        "d5_run_metrics": _run_metrics,
        "d5_mean_metrics": lambda spark, sf: MT.mean_metrics(_run_metrics(spark, sf)),
        "t1_cv_auc": lambda spark, sf: _model_run(spark, sf).curve,
        "t5_model_scores": lambda spark, sf: _model_run(spark, sf).scored.select(
            "patient_id", "probability", "pred", "obs"),
        "t7_model_metrics": lambda spark, sf: _model_run(spark, sf).metrics,
        "t10_shap_values": _shap,
        "t9_shap_summary": lambda spark, sf: shap_summary(_shap(spark, sf), 25),
        "t10_shap_plot_data": lambda spark, sf: shap_plot_data(_shap(spark, sf), 25),
        "t9_permutation_importance": _perm_importance,
        "x4_trial_outcome_model": lambda spark, sf: _model_trial(spark, sf)[2],
        "w4_flag_share_by_clinic": lambda spark, sf: R.share_within(
            _a(spark, sf).groupBy("clinic", "dna_flag").agg(F.count(F.lit(1)).alias("count")),
            "count", ["clinic"], "prop"),
        "o2_top_clinic_rate": lambda spark, sf: R.clinic_rates(_a(spark, sf), min_count=MIN_COUNT)
            .orderBy(F.desc("clinic_prop"), F.asc("clinic")).limit(1),
        "r3_metrics_long": lambda spark, sf: MT.confusion_metrics(_markov_pred(spark, sf)).unpivot(
            [], [F.col(f"`{m}`").alias(m) for m in METRIC_NAMES], "metric", "value"),
        "p10_null_profile_model": lambda spark, sf: null_profile(model_table(_features(spark, sf))),
    }
    found.update(_LLM.queries() if _LLM else {})
    found.update({"pipeline": _PIPELINE.run} if _PIPELINE else {})
    return found


# --------------------------------------------------------------------------
# DuckDB oracle (same tables, plain SQL)
# --------------------------------------------------------------------------

_VIEW_SQL = {"orders": ORDERS_VIEW_SQL, "events": EVENTS_VIEW_SQL}
_VIEW_SQL["wide"] = f"""SELECT *, CAST(appointment_dt - CAST(appt_id % 60 AS INTEGER) AS DATE) AS letter_received_dt,
  CAST(appt_id % 60 AS DOUBLE) AS time_to_be_seen_days,
  {", ".join(f"CAST((appt_id // {d}) % {m} AS INTEGER) AS {c}" for c, (d, m) in WIDE_COLUMNS.items())}
FROM ({ORDERS_VIEW_SQL}) v"""


def _ch(c):
    return f"CASE WHEN {c} = 1 THEN '1' WHEN {c} = 0 THEN '0' END"


def _seq_ctes(view: str, events=("dna_flag",), names=("e",), order: int = 6) -> str:
    """CTEs a, r, pm, h, fullseq, histseq, cnt_<name>, prob for a view."""
    full = ", ".join(f"coalesce(string_agg({_ch(e)}, '' ORDER BY rn), '') AS full_{n}"
                     for e, n in zip(events, names))
    hist = ", ".join(f"coalesce(string_agg({_ch(e)}, '' ORDER BY hr), '') AS history_{n}"
                     for e, n in zip(events, names))
    cnts = ",\n".join(f"cnt_{n} AS (SELECT full_{n} AS s, count(*) AS c FROM fullseq GROUP BY 1)"
                      for n in names)
    probs, joins = [], []
    for n in names:
        h = f"hs.history_{n}"
        joins.append(
            f"LEFT JOIN cnt_{n} {n}1 ON {n}1.s = '1' || {h} "
            f"LEFT JOIN cnt_{n} {n}0 ON {n}0.s = '0' || {h} "
            f"LEFT JOIN cnt_{n} {n}b1 ON {n}b1.s = left('1' || {h}, length({h})) "
            f"LEFT JOIN cnt_{n} {n}b0 ON {n}b0.s = left('0' || {h}, length({h}))")
        probs.append(
            f"CASE WHEN {n}1.c IS NOT NULL AND {n}0.c IS NOT NULL "
            f"THEN CAST({n}1.c AS DOUBLE) / ({n}0.c + {n}1.c) "
            f"WHEN {n}b1.c IS NOT NULL AND {n}b0.c IS NOT NULL "
            f"THEN CAST({n}b1.c AS DOUBLE) / ({n}b0.c + {n}b1.c) END AS p_{n}")
    return f"""
a AS ({_VIEW_SQL[view]}),
r AS (SELECT *, row_number() OVER (PARTITION BY patient_id
        ORDER BY appointment_dt DESC NULLS LAST, appt_id) AS rn FROM a),
pm AS (SELECT patient_id, max(appointment_dt) AS mx,
         bool_or(appointment_dt IS NULL) AS hn FROM a GROUP BY patient_id),
h AS (SELECT r.*, row_number() OVER (PARTITION BY r.patient_id
        ORDER BY r.appointment_dt DESC, r.appt_id) AS hr
      FROM r JOIN pm ON r.patient_id IS NOT DISTINCT FROM pm.patient_id
      WHERE NOT pm.hn AND r.appointment_dt < pm.mx),
fullseq AS (SELECT patient_id, {full} FROM r WHERE rn <= {order} GROUP BY patient_id),
histseq AS (SELECT patient_id, {hist} FROM h WHERE hr <= {order - 1} GROUP BY patient_id),
{cnts},
prob AS (SELECT hs.patient_id, {", ".join(f"hs.history_{n}" for n in names)}, {", ".join(probs)}
         FROM histseq hs {" ".join(joins)})
"""


def _features_sql(view: str, min_count: int = MIN_COUNT, days: int = 90) -> str:
    return f"""
WITH {_seq_ctes(view, ("dna_flag", "cancel_flag"), ("dna", "cancel"))},
rates AS (SELECT CAST(count(*) FILTER (WHERE dna_flag = 1) AS DOUBLE) / count(*) AS rate,
                 CAST(count(*) FILTER (WHERE cancel_flag = 1) AS DOUBLE) / count(*) AS cancel_rate,
                 max(appointment_dt) AS max_dt FROM a),
stats AS (SELECT clinic, count(*) AS n, count(*) FILTER (WHERE dna_flag = 1) AS ones
          FROM a GROUP BY clinic),
crates AS (SELECT clinic, CAST(ones AS DOUBLE) / n AS clinic_prop FROM stats
           WHERE (n >= {min_count} OR clinic IS NOT DISTINCT FROM 'Other') AND ones > 0),
recent AS (SELECT patient_id, count(*) AS three_mo_count FROM a, rates
           WHERE a.appointment_dt > rates.max_dt - {days} GROUP BY patient_id),
sd AS (SELECT patient_id, appointment_dt, count(*) AS n FROM a GROUP BY ALL),
latest AS (SELECT * EXCLUDE (rn) FROM r WHERE rn = 1 AND appointment_dt IS NOT NULL)
SELECT l.*, coalesce(p.p_dna, rates.rate) AS dna_markov,
       coalesce(p.p_cancel, rates.cancel_rate) AS cancel_markov,
       CASE WHEN sd.n > 1 THEN 1 ELSE 0 END AS multi_day,
       coalesce(cr.clinic_prop, rates.rate) AS clinic_prop,
       coalesce(rc.three_mo_count, 0) AS three_mo_count
FROM latest l CROSS JOIN rates
LEFT JOIN prob p ON p.patient_id IS NOT DISTINCT FROM l.patient_id
LEFT JOIN crates cr ON cr.clinic IS NOT DISTINCT FROM l.clinic
LEFT JOIN recent rc ON rc.patient_id IS NOT DISTINCT FROM l.patient_id
LEFT JOIN sd ON sd.patient_id IS NOT DISTINCT FROM l.patient_id
          AND sd.appointment_dt = l.appointment_dt
"""


_ORDERS_FEATURE_COLS = ["appt_id", "patient_id", "clinic", "appointment_dt", "dna_flag",
                        "cancel_flag", "travel_dist", "age", "appt_month", "day_of_week",
                        "new_appt", "dna_markov", "cancel_markov", "multi_day", "clinic_prop",
                        "three_mo_count"]
_DROP = {"patient_id", "clinic", "letter_received_dt", "appointment_dt", "cancel_flag", "appt_id"}


_WIDE_FEATURE_COLS = [*_ORDERS_FEATURE_COLS, "time_to_be_seen_days", *WIDE_COLUMNS]


def _model_pairs(prune: bool, cols=None):
    for c in cols or _ORDERS_FEATURE_COLS:
        if c in _DROP:
            continue
        name = DISPLAY_NAMES.get(c, c)
        if prune and name in PRUNED_FEATURES:
            continue
        yield c, name


def _model_cols(prune: bool):
    return [n for _, n in _model_pairs(prune)]


def _model_sql(prune: bool, view: str = "orders", cols=None) -> str:
    sel = [f'{c} AS "{n}"' for c, n in _model_pairs(prune, cols)]
    return f"SELECT {', '.join(sel)} FROM ({_features_sql(view)}) f"


def _matrix_sql() -> str:
    sel = [f'CAST({c} AS DOUBLE) AS "{n}"' for c, n in _model_pairs(True) if c != "dna_flag"]
    return f"""SELECT patient_id, CAST(dna_flag AS DOUBLE) AS label, {', '.join(sel)}
FROM ({_feat()}) f WHERE dna_flag IS NOT NULL"""


def _root_split_sql(seed=1, folds=5, bins=256) -> str:
    """First splits with margins 0 (gradient 1/2 - y, hessian 1/4), every cut of every
    feature and both sides for missing values; features of more than ``bins``
    values are cut at even ranks of all training rows."""
    names = [(c, n) for c, n in _model_pairs(True) if c != "dna_flag"]
    long = " UNION ALL ".join(f"SELECT patient_id, {i} AS f, '{n}' AS feature, CAST({c} AS DOUBLE) AS v FROM feat" for i, (c, n) in enumerate(names))
    gain = "power({g}, 2) / ({h} + 1)"
    total = gain.format(g="GT", h="HT")
    both = " UNION ALL ".join(
        f"""SELECT m, f, feature, cut, GT, HT, {i} AS side, {gain.format(g=g, h=h)} + {gain.format(g=f"(GT - ({g}))", h=f"(HT - ({h}))")} - {total} AS gain
        FROM sums WHERE {h} >= 1 AND HT - ({h}) >= 1""" for i, (g, h) in enumerate([("gl + gm", "hl + hm"), ("gl", "hl")]))
    return f"""WITH feat AS MATERIALIZED ({_feat()}), base AS MATERIALIZED (SELECT patient_id, dna_flag FROM ({_down_sql(seed)}) d),
dealt AS (SELECT *, ({_rank_expr('patient_id', f'{seed}|fold', 'dna_flag')} - 1) % {folds} AS fold,
  {_rank_expr('patient_id', f'{seed}|watch', 'dna_flag')} > round_even(0.9 * count(*) OVER (PARTITION BY dna_flag), 0) AS watch FROM base),
vals AS MATERIALIZED (SELECT l.f, l.feature, l.v, d.dna_flag AS y, d.fold, d.watch FROM ({long}) l JOIN dealt d USING (patient_id)),
counted AS (SELECT f, v, count(*) AS n FROM vals WHERE v IS NOT NULL GROUP BY f, v),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY f ORDER BY v) AS upto, sum(n) OVER (PARTITION BY f) AS total,
  count(*) OVER (PARTITION BY f) AS k, row_number() OVER (PARTITION BY f ORDER BY v) AS i FROM counted),
cuts AS (SELECT f, v AS cut FROM ranked WHERE k <= {bins} AND i < k
  UNION SELECT f, min(v) FROM ranked, range(1, {bins}) r(j) WHERE k > {bins} AND upto >= total * j / {bins}.0 GROUP BY f, j
  UNION SELECT DISTINCT f, CAST('infinity' AS DOUBLE) FROM counted),
rows_of AS (SELECT m, f, feature, v, 0.5 - y AS g FROM vals, range({folds + 1}) r(m)
  WHERE CASE WHEN m < {folds} THEN fold <> m ELSE NOT watch END),
totals AS (SELECT m, f, feature, sum(g) AS GT, count(*) / 4.0 AS HT, coalesce(sum(g) FILTER (WHERE v IS NULL), 0) AS gm,
  count(*) FILTER (WHERE v IS NULL) / 4.0 AS hm FROM rows_of GROUP BY m, f, feature),
sums AS (SELECT t.*, cut, coalesce(sum(g), 0) AS gl, count(g) / 4.0 AS hl FROM totals t JOIN cuts c ON c.f = t.f
  LEFT JOIN rows_of r ON r.m = t.m AND r.f = t.f AND r.v <= c.cut GROUP BY ALL),
splits AS ({both})
SELECT m AS model, coalesce(arg_min(feature, (-gain, f, cut, side)), NULL) AS feature,
  coalesce(min((-gain, f, cut, side)), NULL)[3] AS threshold, round(max(gain), 6) AS gain, round(max(HT), 6) AS cover
FROM splits GROUP BY m HAVING max(gain) > 1e-6"""


def _auc_sql() -> str:
    """Rank-sum AUC (ties 1/2) and trapezoids under the precision-recall curve."""
    return f"""WITH g AS (SELECT dna_markov AS s, count(*) FILTER (WHERE dna_flag = 1) AS pos,
    count(*) FILTER (WHERE dna_flag <> 1) AS neg FROM ({_feat()}) f WHERE dna_flag IS NOT NULL GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g),
d AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS prec,
    CASE WHEN tp - pos + fp - neg > 0 THEN CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) END AS prec0 FROM c)
SELECT 1 AS round, sum(pos * (below + 0.5 * neg)) / CAST(max(p) * max(n) AS DOUBLE) AS auc,
    round(sum(CAST(pos AS DOUBLE) / p * (prec + coalesce(prec0, prec)) / 2), 12) AS aucpr FROM d"""


def _marked_sql():
    return f"""SELECT * REPLACE (CASE WHEN appt_id % 7 <> 0 THEN age END AS age, CASE WHEN appt_id % 11 <> 0 THEN travel_dist END AS travel_dist)
FROM ({ORDERS_VIEW_SQL}) v"""


def _type_sql(name, x):
    from apptflow.sources.typed_text import DATE, DATE_TIME, DOUBLE, INTEGER, LOGICAL
    logical = ", ".join(f"'{v}'" for v in LOGICAL)
    return f"""SELECT '{name}' AS "column", CASE WHEN coalesce(bool_and(x IN ({logical})), true) THEN 'logical'
  WHEN bool_and(regexp_matches(x, '{INTEGER}')) THEN 'integer' WHEN bool_and(regexp_matches(x, '{DOUBLE}')) THEN 'double'
  WHEN bool_and(regexp_matches(x, '{DATE}') AND try_cast(x AS DATE) IS NOT NULL) THEN 'date'
  WHEN bool_and(regexp_matches(x, '{DATE_TIME}') AND try_cast(x AS TIMESTAMP) IS NOT NULL) THEN 'date-time' ELSE 'text' END AS type
FROM (SELECT CAST({x} AS VARCHAR) AS x FROM a)"""


def _inferred_sql():
    from apptflow.schemas import SOURCE_NAMES
    back = {v: k for k, v in SOURCE_NAMES.items()}
    own = ["appt_id", "patient_id", "clinic", "appointment_dt", "dna_flag", "cancel_flag", "travel_dist", "age", "appt_month",
           "day_of_week", "new_appt"]
    last = "appt_id = (SELECT max(appt_id) FROM a)"
    more = {"late_decimal": f"CASE WHEN {last} THEN '0.5' ELSE CAST(appt_id AS VARCHAR) END",
            "late_text": f"CASE WHEN {last} THEN 'unknown' ELSE CAST(appointment_dt AS VARCHAR) END",
            "flag": "CASE WHEN appt_id % 2 = 0 THEN 'TRUE' END", "none": "NULL"}
    return f"WITH a AS ({_marked_sql()}) " + " UNION ALL ".join(
        [_type_sql(back.get(c, c), c) for c in own] + [_type_sql(c, x) for c, x in more.items()])


def _clustered_sql(seed=2024, replicates=1024):
    sums = ", ".join(f"""count(*) FILTER (WHERE arm = '{a}') AS m_{a}, coalesce(sum(n) FILTER (WHERE arm = '{a}'), 0) AS n_{a},
      coalesce(sum(y) FILTER (WHERE arm = '{a}'), 0) AS y_{a}, coalesce(sum(y * y) FILTER (WHERE arm = '{a}'), 0) AS yy_{a},
      coalesce(sum(y * n) FILTER (WHERE arm = '{a}'), 0) AS yn_{a}, coalesce(sum(n * n) FILTER (WHERE arm = '{a}'), 0) AS nn_{a}"""
                     for a in ("intervention", "control"))

    def variance(a):
        p = f"(CAST(y_{a} AS DOUBLE) / n_{a})"
        ss = f"greatest(CAST(yy_{a} AS DOUBLE) - 2.0::DOUBLE * {p} * CAST(yn_{a} AS DOUBLE) + {p} * {p} * CAST(nn_{a} AS DOUBLE), 0.0::DOUBLE)"
        return f"(m_{a}::DOUBLE * {ss}) / ((m_{a}::DOUBLE - 1) * n_{a}::DOUBLE * n_{a}::DOUBLE)"
    return f"""WITH per AS MATERIALIZED (SELECT band, patient_id, arm, count(*) AS n, count(*) FILTER (WHERE dna_flag = 1) AS y
  FROM ({_arms_sql()}) t GROUP BY ALL),
one AS (SELECT band, {sums} FROM per GROUP BY band),
rated AS (SELECT *, CAST(y_intervention AS DOUBLE) / n_intervention AS p1, CAST(y_control AS DOUBLE) / n_control AS p0,
  sqrt({variance('intervention')} + {variance('control')}) AS se FROM one),
bits AS (SELECT band, n, y, md5(CAST(patient_id AS VARCHAR) || '|{seed}|' || k) AS h, k FROM per, range(0, {-(-replicates // 128)}) w(k)),
arms AS (SELECT band, k * 128 + j AS r, n, y,
  ((instr('0123456789abcdef', substr(h, CAST(j // 4 + 1 AS INTEGER), 1)) - 1) >> CAST(3 - j % 4 AS INTEGER)) & 1 AS iv FROM bits, range(0, 128) v(j)),
reps AS (SELECT band, r, sum(n) FILTER (WHERE iv = 1) AS n1, sum(y) FILTER (WHERE iv = 1) AS y1,
  sum(n) FILTER (WHERE iv = 0) AS n0, sum(y) FILTER (WHERE iv = 0) AS y0 FROM arms WHERE r < {replicates} GROUP BY band, r),
share AS (SELECT reps.band, count(*) FILTER (WHERE abs(CAST(y0 AS DOUBLE) / n0 - CAST(y1 AS DOUBLE) / n1) >= abs(p0 - p1) - 1e-12) AS k,
  count(*) AS n FROM reps JOIN rated USING (band) WHERE n0 > 0 AND n1 > 0 GROUP BY 1)
SELECT band, m_intervention AS patients_intervention, m_control AS patients_control, CAST(n_intervention AS BIGINT) AS n_intervention,
  CAST(y_intervention AS BIGINT) AS miss_intervention, CAST(n_control AS BIGINT) AS n_control, CAST(y_control AS BIGINT) AS miss_control,
  p1 AS rate_intervention, p0 AS rate_control, p0 - p1 AS abs_reduction, se AS se_clustered, (p0 - p1) / se AS z_clustered,
  CAST(k AS DOUBLE) / n AS p_rerandomised
FROM rated JOIN share USING (band)"""


def _rank_sql(view):
    return f"""WITH a AS ({_VIEW_SQL[view]})
SELECT *, CAST(row_number() OVER (PARTITION BY patient_id
       ORDER BY appointment_dt DESC NULLS LAST, appt_id) AS INTEGER) AS rn FROM a"""


def _hist_rows_sql(view):
    return f"""WITH a AS ({_VIEW_SQL[view]}),
pm AS (SELECT patient_id, max(appointment_dt) AS mx, bool_or(appointment_dt IS NULL) AS hn
       FROM a GROUP BY patient_id)
SELECT a.* FROM a JOIN pm ON a.patient_id IS NOT DISTINCT FROM pm.patient_id
WHERE NOT pm.hn AND a.appointment_dt < pm.mx"""


def _latest_sql(view):
    return f"""SELECT * EXCLUDE (rn) FROM ({_rank_sql(view)}) x
WHERE rn = 1 AND appointment_dt IS NOT NULL"""


def _same_day_sql(view):
    return f"""WITH a AS ({_VIEW_SQL[view]})
SELECT patient_id, appointment_dt, count(*) AS n,
       CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS multi_day FROM a GROUP BY ALL"""


def _recent_sql(view, days):
    return f"""WITH a AS ({_VIEW_SQL[view]})
SELECT patient_id, count(*) AS three_mo_count FROM a
WHERE appointment_dt > (SELECT max(appointment_dt) FROM a) - {days} GROUP BY patient_id"""


def _feat():
    return _features_sql("orders", MIN_COUNT, 90)


def _rank_expr(key, seed, part):
    return (f"row_number() OVER (PARTITION BY {part} ORDER BY "
            f"md5(CAST({key} AS VARCHAR) || '|{seed}'), {key})")


def _split_sql(seed=1):
    return f"""SELECT patient_id, dna_flag, dna_markov,
  CASE WHEN {_rank_expr('patient_id', seed, 'dna_flag')} <=
       round_even(0.75 * count(*) OVER (PARTITION BY dna_flag), 0)
  THEN 'train' ELSE 'test' END AS split
FROM ({_feat()}) f WHERE dna_flag IS NOT NULL"""


def _down_sql(seed=1):
    return f"""SELECT patient_id, dna_flag, dna_markov FROM (
  SELECT *, {_rank_expr('patient_id', f'{seed}|down', 'dna_flag')} AS rk,
         min(n) OVER () AS mn FROM (
    SELECT *, count(*) OVER (PARTITION BY dna_flag) AS n
    FROM ({_split_sql(seed)}) s WHERE split = 'train') t) u
WHERE rk <= mn"""


def _pred_sql(seed=1):
    return f"""SELECT CASE WHEN dna_markov >= 0.5 THEN 1 ELSE 0 END AS pred, dna_flag AS obs
FROM ({_split_sql(seed)}) s WHERE split = 'test'"""


_METRICS_SQL = """
SELECT {keep}
  sens AS "Sensitivity", spec AS "Specificity",
  (sens * prev) / (sens * prev + (1.0 - spec) * (1.0 - prev)) AS "Pos.Pred.Value",
  (spec * (1.0 - prev)) / ((1.0 - sens) * prev + spec * (1.0 - prev)) AS "Neg.Pred.Value",
  prec AS "Precision", sens AS "Recall", (2.0 * prec * sens) / (prec + sens) AS "F1",
  prev AS "Prevalence", CAST(tp AS DOUBLE) / n AS "Detection.Rate",
  CAST(tp + fp AS DOUBLE) / n AS "Detection.Prevalence", (sens + spec) / 2.0 AS "Balanced.Accuracy"
FROM (SELECT *, CAST(tp AS DOUBLE) / (tp + fn) AS sens, CAST(tn AS DOUBLE) / (tn + fp) AS spec,
             CAST(tp + fn AS DOUBLE) / n AS prev, CAST(tp AS DOUBLE) / (tp + fp) AS prec
      FROM (SELECT *, tp + fp + fn + tn AS n FROM (
        SELECT count(*) FILTER (WHERE pred = 1 AND obs = 1) AS tp,
               count(*) FILTER (WHERE pred = 1 AND obs <> 1) AS fp,
               count(*) FILTER (WHERE pred <> 1 AND obs = 1) AS fn,
               count(*) FILTER (WHERE pred <> 1 AND obs <> 1) AS tn
        FROM ({src}) p) c) d) e"""


def _trial_sql():
    return f"""SELECT a.appt_id, a.patient_id, a.appointment_dt, a.dna_flag,
       f.dna_markov AS probability,
       CASE WHEN f.dna_markov >= 0.5 THEN 'high' ELSE 'low' END AS band
FROM ({ORDERS_VIEW_SQL}) a JOIN ({_feat()}) f
  ON a.patient_id IS NOT DISTINCT FROM f.patient_id"""


def _arms_sql():
    return f"""SELECT t.*, p.arm FROM ({_trial_sql()}) t JOIN (
  SELECT patient_id, band, CASE WHEN {_rank_expr('patient_id', '2024|arm', 'band')} <=
         round_even(0.5 * count(*) OVER (PARTITION BY band), 0) THEN 'intervention' ELSE 'control' END AS arm
  FROM (SELECT DISTINCT patient_id, band FROM ({_trial_sql()}) u) v) p
ON t.patient_id IS NOT DISTINCT FROM p.patient_id AND t.band = p.band"""


def oracle_sql() -> dict[str, str]:
    o = ORDERS_VIEW_SQL
    seq1 = _seq_ctes("orders")
    sql = {
        "s1_appointments": o,
        "s1_appointments_events": EVENTS_VIEW_SQL,
        "a1_overall_rates": f"""WITH a AS ({o})
SELECT CAST(count(*) FILTER (WHERE dna_flag = 1) AS DOUBLE) / count(*) AS rate,
       CAST(count(*) FILTER (WHERE cancel_flag = 1) AS DOUBLE) / count(*) AS cancel_rate FROM a""",
        "a2_clinic_groups": f"""WITH a AS ({o}),
s AS (SELECT clinic, count(*) AS n FROM a GROUP BY clinic)
SELECT clinic, CAST(sum(n) AS BIGINT) AS count FROM (
  SELECT CASE WHEN n < {MIN_COUNT} THEN 'Other' ELSE clinic END AS clinic, n FROM s) t
GROUP BY clinic""",
        "a3_clinic_rates": f"""WITH a AS ({o}),
s AS (SELECT clinic, count(*) AS n, count(*) FILTER (WHERE dna_flag = 1) AS ones
      FROM a GROUP BY clinic)
SELECT clinic, CAST(ones AS DOUBLE) / n AS clinic_prop FROM s
WHERE (n >= {MIN_COUNT} OR clinic IS NOT DISTINCT FROM 'Other') AND ones > 0""",
        "a4_same_day": _same_day_sql("orders"),
        "a4_same_day_events": _same_day_sql("events"),
        "a6_recent_count": _recent_sql("orders", 90),
        "a6_recent_count_events": _recent_sql("events", DAYS),
        "a7_max_date": f"WITH a AS ({o}) SELECT max(appointment_dt) AS max_dt FROM a",
        "p6_supported_clinic_rows": f"""WITH a AS ({o}),
s AS (SELECT clinic, count(*) AS n FROM a GROUP BY clinic),
k AS (SELECT clinic FROM s WHERE n >= {MIN_COUNT} OR clinic IS NOT DISTINCT FROM 'Other')
SELECT * FROM a WHERE EXISTS (SELECT 1 FROM k WHERE k.clinic IS NOT DISTINCT FROM a.clinic)""",
        "p7_distinct_histories": f"""WITH {seq1}
SELECT DISTINCT history_e AS sequence FROM histseq""",
        "p10_null_profile": f"""WITH a AS ({o})
SELECT {", ".join(f"CAST(count(*) - count({c}) AS BIGINT) AS {c}" for c in
                  ["appt_id", "patient_id", "clinic", "appointment_dt", "dna_flag",
                   "cancel_flag", "travel_dist", "age", "appt_month", "day_of_week",
                   "new_appt"])} FROM a""",
        "w1_appointment_rank": _rank_sql("orders"),
        "w1_appointment_rank_events": _rank_sql("events"),
        "w2_newest_rows": f"SELECT * FROM ({_rank_sql('orders')}) x WHERE rn <= 6",
        "w2_newest_rows_events": f"SELECT * FROM ({_rank_sql('events')}) x WHERE rn <= 6",
        "m2_sequence_counts_events": f"""WITH {_seq_ctes('events')}
SELECT s AS sequence, c AS count FROM cnt_e""",
        "m7_no_history_marginal_events": f"""WITH {_seq_ctes('events')}
SELECT CASE WHEN ones > 0 AND zeros > 0 THEN CAST(ones AS DOUBLE) / (zeros + ones) END
       AS no_history_prob FROM (SELECT count(*) FILTER (WHERE full_e = '1') AS ones,
       count(*) FILTER (WHERE full_e = '0') AS zeros FROM fullseq) t""",
        "m8_markov_probability_events": f"""WITH {_seq_ctes('events')}
SELECT patient_id, history_e AS sequence, p_e AS event FROM prob""",
        "w3_history_rows": _hist_rows_sql("orders"),
        "w3_history_rows_events": _hist_rows_sql("events"),
        "w5_latest_rows": _latest_sql("orders"),
        "w5_latest_rows_events": _latest_sql("events"),
        "m1_full_sequences": f"WITH {seq1} SELECT patient_id, full_e AS sequence FROM fullseq",
        "m1_full_sequences_events": f"""WITH {_seq_ctes('events')}
SELECT patient_id, full_e AS sequence FROM fullseq""",
        "m2_sequence_counts": f"WITH {seq1} SELECT s AS sequence, c AS count FROM cnt_e",
        "m3_history_sequences": f"WITH {seq1} SELECT patient_id, history_e AS sequence FROM histseq",
        "m3_history_sequences_events": f"""WITH {_seq_ctes('events')}
SELECT patient_id, history_e AS sequence FROM histseq""",
        "m4_sequence_probability": f"""WITH {seq1}
SELECT DISTINCT history_e AS sequence, p_e AS prob FROM prob""",
        "m4_sequence_probability_events": f"""WITH {_seq_ctes('events')}
SELECT DISTINCT history_e AS sequence, p_e AS prob FROM prob""",
        "m7_no_history_marginal": f"""WITH {seq1}
SELECT CASE WHEN ones > 0 AND zeros > 0 THEN CAST(ones AS DOUBLE) / (zeros + ones) END
       AS no_history_prob FROM (SELECT count(*) FILTER (WHERE full_e = '1') AS ones,
       count(*) FILTER (WHERE full_e = '0') AS zeros FROM fullseq) t""",
        "m8_markov_probability": f"""WITH {seq1}
SELECT patient_id, history_e AS sequence, p_e AS event FROM prob""",
        "m8_markov_probability_cancel": f"""WITH {_seq_ctes('orders', ('cancel_flag',))}
SELECT patient_id, history_e AS sequence, p_e AS event FROM prob""",
        "g1_patient_features": _features_sql("orders", MIN_COUNT, 90),
        "g1_patient_features_events": _features_sql("events", MIN_COUNT, DAYS),
        "g3_model_table": _model_sql(prune=False),
        "g4_model_features": _model_sql(prune=True),
        "r1_pivot_events": f"""SELECT patient_id, {", ".join(
            f'max(CASE WHEN rn = {i} THEN dna_flag END) AS "{i}"' for i in range(1, 7))}
FROM ({_rank_sql('orders')}) x WHERE rn <= 6 GROUP BY patient_id""",
        "u1_union_views": f"""SELECT appt_id, patient_id, clinic, appointment_dt, dna_flag,
       cancel_flag, travel_dist, age, appt_month, day_of_week, new_appt,
       CAST(NULL AS INTEGER) AS attendance_time FROM ({o}) x
UNION ALL
SELECT appt_id, patient_id, clinic, appointment_dt, dna_flag, cancel_flag,
       CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER),
       CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), attendance_time FROM ({EVENTS_VIEW_SQL}) y""",
        "d1_stratified_split": f"SELECT patient_id, dna_flag, split FROM ({_split_sql()}) s",
        "d3_down_sample": f"SELECT patient_id, dna_flag FROM ({_down_sql()}) d",
        "d4_folds": f"""SELECT patient_id, dna_flag, CAST(({_rank_expr('patient_id', '1|fold',
            'dna_flag')} - 1) % 5 AS INTEGER) AS fold FROM ({_down_sql()}) d""",
        "a10_cross_tab": f"SELECT pred, obs, count(*) AS count FROM ({_pred_sql()}) p GROUP BY ALL",
        "t7_markov_confusion": _METRICS_SQL.format(keep="tp, fp, fn, tn,", src=_pred_sql()),
        "t8_mean_metrics": "SELECT " + ", ".join(
            f'round(avg("{m}"), 12) AS "{m}"' for m in METRIC_NAMES) + " FROM (" + " UNION ALL ".join(
            _METRICS_SQL.format(keep="", src=_pred_sql(r)) for r in range(1, RUNS + 1)) + ") u",
        "p10_null_profile_model": "SELECT " + ", ".join(
            f'CAST(count(*) - count("{c}") AS BIGINT) AS "{c}"' for c in _model_cols(True))
            + f" FROM ({_model_sql(prune=True)}) m",
        "w4_flag_share_by_clinic": f"""WITH a AS ({o})
SELECT clinic, dna_flag, count(*) AS count,
       CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY clinic) AS prop
FROM a GROUP BY clinic, dna_flag""",
        "o2_top_clinic_rate": f"""WITH a AS ({o}),
s AS (SELECT clinic, count(*) AS n, count(*) FILTER (WHERE dna_flag = 1) AS ones
      FROM a GROUP BY clinic)
SELECT clinic, CAST(ones AS DOUBLE) / n AS clinic_prop FROM s
WHERE (n >= {MIN_COUNT} OR clinic IS NOT DISTINCT FROM 'Other') AND ones > 0
ORDER BY clinic_prop DESC, clinic LIMIT 1""",
        "r3_metrics_long": "SELECT metric, value FROM (" + _METRICS_SQL.format(
            keep="", src=_pred_sql()) + ") m UNPIVOT (value FOR metric IN (" + ", ".join(
            f'"{m}"' for m in METRIC_NAMES) + "))",
        "x1_bands": f"SELECT appt_id, band FROM ({_trial_sql()}) t",
        "x2_arms": f"SELECT appt_id, band, arm FROM ({_arms_sql()}) t",
        "x3_reminders": f"""SELECT appt_id, appointment_dt, arm, d AS days_before,
       CAST(appointment_dt - d AS DATE) AS reminder_dt
FROM ({_arms_sql()}) t, unnest(CASE WHEN arm = 'intervention' THEN [5, 3] ELSE [5] END) u(d)""",
        "x4_trial_outcome": f"""SELECT * FROM (
SELECT band, n_intervention, miss_intervention, n_control, miss_control,
  CAST(miss_intervention AS DOUBLE) / n_intervention AS rate_intervention,
  CAST(miss_control AS DOUBLE) / n_control AS rate_control,
  CAST(miss_control AS DOUBLE) / n_control - CAST(miss_intervention AS DOUBLE) / n_intervention
    AS abs_reduction,
  (CAST(miss_control AS DOUBLE) / n_control - CAST(miss_intervention AS DOUBLE) / n_intervention)
  / sqrt(pp * (1.0 - pp) * (1.0 / n_intervention + 1.0 / n_control)) AS z
FROM (SELECT *, CAST(miss_intervention + miss_control AS DOUBLE)
                / (n_intervention + n_control) AS pp FROM (
  SELECT band, count(*) FILTER (WHERE arm = 'intervention') AS n_intervention,
         count(*) FILTER (WHERE arm = 'intervention' AND dna_flag = 1) AS miss_intervention,
         count(*) FILTER (WHERE arm = 'control') AS n_control,
         count(*) FILTER (WHERE arm = 'control' AND dna_flag = 1) AS miss_control
  FROM ({_arms_sql()}) t GROUP BY band) g) h) o""",
    }
    sql.update({
        "s1_csv_roundtrip": f"SELECT * REPLACE (CAST(patient_id AS VARCHAR) AS patient_id) FROM ({o}) v",
        "s2_s3_metrics_roundtrip": " UNION ALL ".join(
            f"SELECT *, DATE '2024-05-14' AS date, {r} AS run FROM ({_METRICS_SQL.format(keep='', src=_pred_sql(r))}) m{r}"
            for r in (1, 2)),
        "f8_lead_days": f"""SELECT appt_id, CAST(date_diff('day', letter_received_dt, appointment_dt) AS DOUBLE)
  AS lead_days FROM ({_VIEW_SQL['wide']}) v""",
        "g3_wide_model_table": _model_sql(False, "wide", _WIDE_FEATURE_COLS),
        "g4_wide_model_features": _model_sql(True, "wide", _WIDE_FEATURE_COLS),
        "r2_unite": f"""SELECT patient_id, coalesce(string_agg(CAST(dna_flag AS VARCHAR), '' ORDER BY rn), '') AS sequence
FROM ({_rank_sql('orders')}) r WHERE rn <= 6 GROUP BY patient_id""",
        "t4_staged_auc": _auc_sql(),
        "p9_feature_matrix": _matrix_sql(),
        "t2_root_splits": _root_split_sql(),
        "s1_na_roundtrip": f"SELECT * REPLACE (CAST(patient_id AS VARCHAR) AS patient_id) FROM ({_marked_sql()}) m",
        "s1_inferred_types": _inferred_sql(),
        "x4_clustered": _clustered_sql(),
    })
    if _LLM:
        sql.update(_LLM.oracle_sql())
    if _PIPELINE and _PIPELINE.ORACLE_SQL:
        sql["pipeline"] = _PIPELINE.ORACLE_SQL
    return sql
