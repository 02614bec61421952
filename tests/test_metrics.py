import glob
import os

import pytest
from pyspark.sql import functions as F

from apptflow.operators import metrics as MT
from apptflow.schemas import METRIC_NAMES
from apptflow.sources.results import read_run_metrics, write_run_metrics

# Golden confusion counts recovered from the published run files (FIXTURES.md §4)
GOLDEN = [
    (1, 1655, 8530, 650, 17215), (2, 1644, 8505, 661, 17240), (3, 1625, 8586, 680, 17159),
    (4, 1661, 8652, 644, 17093), (5, 1621, 8283, 684, 17462), (6, 1656, 8503, 649, 17242),
    (7, 1688, 8928, 617, 16817), (8, 1680, 8348, 625, 17397), (9, 1631, 8482, 674, 17263),
    (10, 1628, 8471, 677, 17274), (11, 1613, 8351, 692, 17394), (12, 1684, 8902, 621, 16843),
    (13, 1690, 8684, 615, 17061), (14, 1658, 8620, 647, 17125), (15, 1647, 8502, 658, 17243),
    (16, 1617, 8103, 688, 17642), (17, 1628, 8845, 677, 16900), (18, 1709, 8881, 596, 16864),
    (19, 1619, 8539, 686, 17206), (20, 1666, 8574, 639, 17171), (21, 1643, 8419, 662, 17326),
    (22, 1639, 8249, 666, 17496), (23, 1675, 8796, 630, 16949), (24, 1697, 8642, 608, 17103),
    (25, 1652, 8244, 653, 17501),
]
# folder holding the published per-run metric files (<run>.csv); skipped when unset
PUBLISHED = os.environ.get("PUBLISHED_METRICS_DIR", "")


def golden_metrics(spark):
    c = spark.createDataFrame(GOLDEN, "run int, tp long, fp long, fn long, tn long")
    return MT.metrics_from_counts(c, keep=("run",))


def test_run1_values(spark):
    r = golden_metrics(spark).where("run = 1").first().asDict()
    assert r["Sensitivity"] == 0.7180043383947939
    assert r["Specificity"] == 0.6686735288405515
    assert r["Precision"] == 0.16249386352479137
    assert r["Pos.Pred.Value"] == 0.16249386352479134
    assert r["Neg.Pred.Value"] == 0.9636160089560593
    assert r["F1"] == 0.26501200960768617
    assert r["Detection.Prevalence"] == 0.36310160427807486


@pytest.mark.skipif(not PUBLISHED or not os.path.isdir(PUBLISHED),
                    reason="set PUBLISHED_METRICS_DIR to the published run files")
def test_equals_published_files(spark):
    pub = read_run_metrics(spark, sorted(glob.glob(f"{PUBLISHED}/*.csv")))
    mine = golden_metrics(spark)
    j = pub.join(mine.select("run", *[F.col(f"`{m}`").alias(f"m_{m}") for m in METRIC_NAMES]),
                 "run")
    rows = j.collect()
    assert len(rows) == 25
    for r in rows:
        for m in METRIC_NAMES:
            assert abs(r[m] - r[f"m_{m}"]) <= 2e-16, (r.run, m)


def test_means_match_baseline(spark):
    means = MT.mean_metrics(golden_metrics(spark)).first()
    assert means["Sensitivity"] == pytest.approx(0.717154, abs=1e-6)
    assert means["Specificity"] == pytest.approx(0.668069, abs=1e-6)
    assert means["F1"] == pytest.approx(0.264446, abs=1e-6)
    assert means["Balanced.Accuracy"] == pytest.approx(0.692612, abs=1e-6)


def test_confusion_from_rows(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "pred int, obs int")
    r = MT.confusion_metrics(df, with_counts=True).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 2, 1, 4)
    assert r["Sensitivity"] == 0.75 and r["Precision"] == 0.6
    tab = {(x.pred, x.obs): x["count"] for x in MT.cross_tab(df).collect()}
    assert tab == {(1, 1): 3, (1, 0): 2, (0, 1): 1, (0, 0): 4}


def test_empty_cells_give_null(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "pred int, obs int")
    r = MT.confusion_metrics(df).first()
    assert r["Sensitivity"] is None and r["Specificity"] == 1.0


def test_write_and_read_back(spark, tmp_path):
    m = MT.stamp(golden_metrics(spark).drop("run").limit(1), run=1, date="2024-05-14") \
        .unionByName(MT.stamp(golden_metrics(spark).where("run = 2").drop("run"), run=2,
                              date="2024-05-14"))
    out = str(tmp_path / "runs")
    write_run_metrics(m, out)
    back = read_run_metrics(spark, out)
    assert back.count() == 2 and set(back.columns) >= {"run", "date", *METRIC_NAMES}
