"""The whole reference flow in one call (entry A + entry C).

appointments -> feature table (one row per patient) -> model table and its
null profile -> ``runs`` x (split, down-sample, CV, fit, score, metrics),
written one folder per run -> mean metrics -> the last run's confusion table
and metrics -> tree-SHAP summary of the last model on its training matrix.

Command line::

    python -m apptflow.plans.flow --input appts.csv --out /shared/results \\
        [--format csv|parquet] [--runs 25] [--rounds 150] [--folds 5]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from ..operators.attribution import (gain_importance, permutation_importance,
                                    shap_plot_data, shap_summary, shap_values)
from ..operators.features import model_table, null_profile, patient_features
from ..operators.metrics import cross_tab
from ..operators.model import BoostParams
from .training import run_many


def full_flow(appts: DataFrame, out_path: str | None = None, runs: int = 25,
              params: BoostParams | None = None, min_count: int = 500, days: int = 90,
              top_n: int = 25, date=None) -> dict:
    feats = patient_features(appts, min_count=min_count, days=days)
    table = model_table(feats, keep=("patient_id",))
    results, per_run, mean = run_many(table, runs, params, out_path=out_path, date=date)
    last = results[-1]
    vals, base = shap_values(last.model, last.train, last.features, "patient_id",
                             rounds=last.rounds)
    return {
        "features": feats,
        "model_table": table,
        "null_profile": null_profile(table.drop("patient_id")),
        "runs": per_run,
        "mean_metrics": mean,
        "last_confusion": cross_tab(last.scored, "pred", "obs"),
        "last_metrics": last.metrics,
        "shap_summary": shap_summary(vals, top_n),
        "shap_plot_data": shap_plot_data(vals, top_n),
        "shap_base_value": base,
        "gain_importance": gain_importance(last.model, last.features, last.rounds),
        "permutation_importance": permutation_importance(
            last.model, last.scored.select("patient_id", "label", "x"),
            last.features, "patient_id", last.rounds),
        "results": results,
    }


def main(argv=None):
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--input", required=True)
    ap.add_argument("--format", default="csv")
    ap.add_argument("--out", required=True)
    ap.add_argument("--runs", type=int, default=25)
    ap.add_argument("--rounds", type=int, default=150)
    ap.add_argument("--folds", type=int, default=5)
    ap.add_argument("--min-count", type=int, default=500)
    a = ap.parse_args(argv)
    from ..session import get_spark
    from ..sources.appointments import read_appointments
    spark = get_spark()
    res = full_flow(read_appointments(spark, a.input, a.format), a.out, a.runs,
                    BoostParams(rounds=a.rounds, folds=a.folds), a.min_count)
    res["null_profile"].show(vertical=True)
    res["mean_metrics"].show(vertical=True)
    res["last_confusion"].show()
    res["shap_summary"].show(truncate=False)


if __name__ == "__main__":
    main()
