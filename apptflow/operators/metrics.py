"""Confusion matrix and run metrics.

Positive class = 1.  Pos.Pred.Value and Neg.Pred.Value use the
prevalence form (sens*prev / (sens*prev + (1-spec)*(1-prev))), which is what
the published run files hold to the last bit; Precision is TP / (TP + FP).
All divisions are ``try_divide`` so an empty cell gives null, not an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import METRIC_NAMES


def cross_tab(df: DataFrame, pred: str = "pred", obs: str = "obs") -> DataFrame:
    """A10: counts of every (pred, obs) pair."""
    return df.groupBy(pred, obs).agg(F.count(F.lit(1)).alias("count"))


def confusion_counts(df: DataFrame, pred: str = "pred", obs: str = "obs",
                     positive=1, by=()) -> DataFrame:
    """TP, FP, FN, TN in one aggregate (one row, or one a group of ``by``)."""
    p, o = F.col(pred) == positive, F.col(obs) == positive
    return df.groupBy(*by).agg(F.count(F.when(p & o, 1)).alias("tp"),
                  F.count(F.when(p & ~o, 1)).alias("fp"),
                  F.count(F.when(~p & o, 1)).alias("fn"),
                  F.count(F.when(~p & ~o, 1)).alias("tn"))


def metrics_from_counts(counts: DataFrame, keep=()) -> DataFrame:
    """The 11 published metrics from tp, fp, fn, tn columns."""
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    sens, spec, prev = d(tp, tp + fn), d(tn, tn + fp), d(tp + fn, n)
    ppv = F.try_divide(sens * prev, sens * prev + (F.lit(1.0) - spec) * (F.lit(1.0) - prev))
    npv = F.try_divide(spec * (F.lit(1.0) - prev),
                       (F.lit(1.0) - sens) * prev + spec * (F.lit(1.0) - prev))
    prec, rec = d(tp, tp + fp), d(tp, tp + fn)
    f1 = F.try_divide(F.lit(2.0) * prec * rec, prec + rec)
    vals = {
        "Sensitivity": sens, "Specificity": spec, "Pos.Pred.Value": ppv,
        "Neg.Pred.Value": npv, "Precision": prec, "Recall": rec, "F1": f1,
        "Prevalence": prev, "Detection.Rate": d(tp, n),
        "Detection.Prevalence": d(tp + fp, n),
        "Balanced.Accuracy": (sens + spec) / F.lit(2.0),
    }
    return counts.select(*[F.col(c) for c in keep],
                         *[vals[m].alias(m) for m in METRIC_NAMES])


def confusion_metrics(df: DataFrame, pred: str = "pred", obs: str = "obs",
                      positive=1, with_counts: bool = False, by=()) -> DataFrame:
    """T7 end to end: one row of 11 metrics (plus the four counts), or one a
    group of ``by``."""
    c = confusion_counts(df, pred, obs, positive, by)
    return metrics_from_counts(c, keep=[*by, *(("tp", "fp", "fn", "tn") if with_counts else ())])


def mean_metrics(runs: DataFrame) -> DataFrame:
    """Column means over runs (date column ignored)."""
    return runs.agg(*[F.avg(F.col(f"`{m}`")).alias(m) for m in METRIC_NAMES])


def stamp(metrics: DataFrame, run: int | None = None, date=None) -> DataFrame:
    """Add the run date (a passed literal keeps results repeatable)."""
    d = F.current_date() if date is None else F.lit(date).cast("date")
    out = metrics.withColumn("date", d)
    return out.withColumn("run", F.lit(run)) if run is not None else out
