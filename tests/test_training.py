from pyspark.sql import functions as F

from apptflow.operators.features import model_table, patient_features
from apptflow.operators.boosting import BoostParams
from apptflow.plans.training import run_many
from apptflow.schemas import METRIC_NAMES
from apptflow.sources import appointments_from_orders, read_run_metrics

SF = "/root/testdata/sf0.001"


def test_run_many_writes_reads_and_averages(spark, tmp_path):
    f = patient_features(appointments_from_orders(spark, SF), min_count=50)
    table = model_table(f, keep=("patient_id",))
    out = str(tmp_path / "runs")
    results, allm, mean = run_many(table, runs=2, p=BoostParams(rounds=4, folds=2, depth=3),
                                   out_path=out, date="2024-05-14")
    back = read_run_metrics(spark, out)
    assert sorted(r.run for r in back.select("run").collect()) == [1, 2]
    m = mean.first()
    exp = back.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in METRIC_NAMES]).first()
    for c in METRIC_NAMES:
        assert (m[c] is None and exp[c] is None) or abs(m[c] - exp[c]) < 1e-12
    for r in results:
        assert 1 <= r.rounds <= r.cv_rounds <= 4
        n_test = r.scored.count()
        assert n_test > 0 and r.metrics.count() == 1
        # train and test are disjoint
        tr = {x.patient_id for x in r.train.select("patient_id").collect()}
        te = {x.patient_id for x in r.scored.select("patient_id").collect()}
        assert not tr & te
    # same run number -> same split and metrics (repeatable)
    again, _, _ = run_many(table, runs=1, p=BoostParams(rounds=4, folds=2, depth=3),
                           date="2024-05-14")
    assert results[0].model.rounds == results[0].rounds_grown == again[0].rounds_grown
    assert again[0].metrics.drop("date").collect() == results[0].metrics.drop("date").collect()


def test_a_stopped_run_many_keeps_finished_runs(spark, tmp_path, monkeypatch):
    import apptflow.plans.training as TP
    table = model_table(patient_features(appointments_from_orders(spark, SF), min_count=50), keep=("patient_id",))
    batch, out = TP.run_together, str(tmp_path / "runs")

    def stops(table, runs, *a, **k):
        if 3 in runs:
            raise RuntimeError("stopped")
        return batch(table, runs, *a, **k)
    monkeypatch.setattr(TP, "run_together", stops)
    try:
        run_many(table, runs=5, p=BoostParams(rounds=2, folds=2, depth=2), out_path=out, date="2024-05-14", together=2)
    except RuntimeError:
        pass
    assert sorted(r.run for r in read_run_metrics(spark, out).collect()) == [1, 2]


def test_runs_in_lockstep_equal_runs_on_their_own(spark):
    import numpy as np

    from apptflow.plans.training import run_once
    table = model_table(patient_features(appointments_from_orders(spark, SF), min_count=50), keep=("patient_id",))
    p = BoostParams(rounds=4, folds=2, depth=3, every=3)
    both, _, _ = run_many(table, runs=2, p=p, date="2024-05-14")
    one = run_once(table, 2, p, date="2024-05-14")
    two = both[1]
    assert (one.cv_rounds, one.rounds) == (two.cv_rounds, two.rounds)
    for a, b in zip(one.forests, two.forests):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.weight, b.weight)
    assert one.metrics.collect() == two.metrics.collect()
    assert sorted(one.scored.select("patient_id", "probability").collect()) == sorted(two.scored.select("patient_id", "probability").collect())


def test_full_flow_small(spark, tmp_path):
    from apptflow.plans.flow import full_flow
    res = full_flow(appointments_from_orders(spark, SF), str(tmp_path / "flow"), runs=1,
                    params=BoostParams(rounds=3, folds=2, depth=2), min_count=50)
    assert res["features"].count() == 150
    assert res["runs"].count() == 1 and res["mean_metrics"].count() == 1
    assert sum(r["count"] for r in res["last_confusion"].collect()) == res["results"][0].scored.count()
    s = res["shap_summary"].collect()
    assert 0 < len(s) <= 25


def test_samples_are_read_by_column_and_deleted(spark, tmp_path, monkeypatch):
    """Hash orders read the key and the label alone from the written samples, whose files are
    gone when the runs are fitted."""
    import os

    import apptflow.plans.training as TP
    from apptflow.plans.training import run_together, training_sets
    from apptflow.session import checkpoint_dir, cut_lineage
    table = cut_lineage(model_table(patient_features(appointments_from_orders(spark, SF), min_count=50), keep=("patient_id",)))
    train, test = training_sets(table, [1, 2], "patient_id", "dna_flag", 0.75, 2, folder=str(tmp_path / "s"))
    assert set(train.columns) == {*table.columns, "run", "fold", "watch"} and set(test.columns) == {*table.columns, "run"}
    plan = train.select("patient_id", "run", "fold")._jdf.queryExecution().executedPlan().toString()
    assert "Age" not in plan and "FileScan parquet" in plan
    assert train.count() > 0 and not {(r.run, r.patient_id) for r in train.collect()} & {(r.run, r.patient_id) for r in test.collect()}
    made, shared = [], TP.shared_folder
    monkeypatch.setattr(TP, "shared_folder", lambda spark, what: made.append(shared(spark, what)) or made[-1])
    r = run_together(table, [1], BoostParams(rounds=2, folds=2, depth=2))[0]
    assert r.train.count() > 0 and r.scored.count() > 0 and r.metrics.count() == 1
    assert len(made) == 2 and checkpoint_dir(spark) and not any(os.path.exists(f.removeprefix("file:")) for f in made)
