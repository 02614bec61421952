"""Feature attribution for the boosted trees.

Exact tree SHAP values (path-dependent expectation, as in the reference's
summary plot) in log-odds units.

* Covers are the sums of hessians that the fit keeps at every node; no pass over
  the training rows.  Trees and covers are bounded by trees x 2^depth and travel to the
  tasks inside the function closure.
* A leaf of value v whose path uses the features U is a product game: given a
  feature set S it is worth ``v * prod_j (o_j if j in S else z_j)``, o_j whether the row
  follows all the path's splits on j, z_j the share of cover that does.  Path weights by
  subset size are extended by one feature after the other and unwound by each in
  turn, so a leaf costs the square of its path, not the cube.
* A row enters a leaf's game only by which of the path's features it follows: at most
  2^depth cases, worked out once a leaf.  A task looks up what a value follows in all
  leaves at once, by the value's place among the feature's thresholds, and then each leaf's
  case: a lookup a row, leaf and path feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest
from .quantiles import matrix

CASES = 1 << 20              # leaves' cases looked up together


def leaf_table(forest: Forest, rounds: int | None = None) -> tuple[list, float]:
    """Per leaf: (value, features, cover shares, lower bounds, upper bounds, whether
    missing values follow); plus the base value (expected log-odds).  A row follows
    feature j's splits if its value is above the lower and not above the upper bound."""
    table, base = [], 0.0
    f = forest.first(rounds)
    for t in range(f.rounds):
        open_ = [(0, {})]
        while open_:
            node, path = open_.pop()
            j = int(f.feature[t, node])
            if j < 0:
                feats = sorted(path)
                z, lo, hi, null = (np.array([path[k][i] for k in feats]) for i in range(4)) if feats else (np.zeros(0),) * 4
                v = float(f.weight[t, node])
                base += v * float(np.prod(z))
                table.append((v, feats, z, lo, hi, null.astype(bool)))
                continue
            thr, cover, here = f.threshold[t, node], f.cover[t, node], path.get(j, (1.0, -np.inf, np.inf, True))
            for left in (False, True):
                child = 2 * node + (1 if left else 2)
                share = f.cover[t, child] / cover if cover else 0.0
                lo, hi = (here[1], min(here[2], thr)) if left else (max(here[1], thr), here[2])
                open_.append((child, {**path, j: (here[0] * share, lo, hi, here[3] and bool(f.missing_left[t, node]) == left)}))
    return table, base


class _Cases:
    """Leaves' contributions by case, and how values make up cases: bit j of a leaf's
    case says that the row follows the path's j-th feature."""

    def __init__(self, table: list, d: int):
        self.follows, self.worth = [], []            # by feature
        value = {}                                    # by path length: (leaves, cases, path features)
        size = np.array([len(leaf[1]) for leaf in table], np.int64)
        for m in set(size.tolist()) - {0}:
            leaves = [leaf for leaf in table if len(leaf[1]) == m]
            v, z = np.array([leaf[0] for leaf in leaves]), np.array([leaf[2] for leaf in leaves])
            case = np.arange(1 << m)[:, None, None] >> np.arange(m) & 1
            o = np.broadcast_to(case, (1 << m, len(leaves), m)).astype(float)
            w = _extended(z, o)
            of = np.stack([v * (o[:, :, j] - z[:, j]) * _unwound(w, z[:, j], o[:, :, j]) for j in range(m)], axis=2)
            value.update(zip(np.flatnonzero(size == m).tolist(), of.transpose(1, 0, 2)))
        for f in range(d):
            use = [(i, leaf[1].index(f)) for i, leaf in enumerate(table) if f in leaf[1]]
            at, j = np.array(use, np.int64).reshape(-1, 2).T
            lo, hi, null = (np.array([table[i][k][p] for i, p in use]) for k in (3, 4, 5))
            bounds = np.unique(np.concatenate([lo, hi]))
            place = np.arange(len(bounds) + 1)[:, None]                # bounds below the value
            o = (place > np.searchsorted(bounds, lo)) & (place <= np.searchsorted(bounds, hi))
            bits = np.zeros((len(bounds) + 2, len(table)), np.uint8)
            bits[:, at] = np.concatenate([o, null.astype(bool)[None, :]]) << j
            self.follows.append((bounds, bits))
            begin = np.cumsum(1 << size[at]) - (1 << size[at])
            self.worth.append((at, begin, np.concatenate([np.zeros(0), *[value[i][:, p] for i, p in use]])))
        self.leaves = len(table)

    def of(self, x: np.ndarray) -> np.ndarray:
        """SHAP values (n x d) for a batch of rows (missing values are NaN)."""
        phi = np.zeros(x.shape)
        place = [np.where(np.isnan(c), len(bounds) + 1, np.searchsorted(bounds, c)) for c, (bounds, _) in zip(x.T, self.follows)]
        step = max(1, CASES // max(self.leaves, 1))
        for a in range(0, len(x), step):
            case = np.zeros((len(x[a:a + step]), self.leaves), np.uint8)
            for p, (_, bits) in zip(place, self.follows):
                case |= bits[p[a:a + step]]
            for f, (at, begin, worth) in enumerate(self.worth):
                if len(at):
                    phi[a:a + step, f] = worth.take(case.take(at, axis=1) + begin).sum(axis=1)
        return phi


def shap_matrix(x: np.ndarray, table: list) -> np.ndarray:
    """SHAP values (n x d) for a batch of rows (missing values are NaN)."""
    return _Cases(table, x.shape[1]).of(x)


def _extended(z: np.ndarray, o: np.ndarray) -> list:
    """Path weights by the number of followed features, after all features."""
    m = z.shape[1]
    w = [np.ones(o.shape[:2])]
    for k in range(m):                    # k features so far, k + 1 after
        new = [np.zeros(o.shape[:2]) for _ in range(k + 2)]
        for i, p in enumerate(w):
            new[i] += z[:, k] * p * ((k + 1 - i) / (k + 2))
            new[i + 1] += o[:, :, k] * p * ((i + 1) / (k + 2))
        w = new
    return w


def _unwound(w: list, z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """The sum of the path weights without a feature of share z, followed or not."""
    m = len(w) - 1
    total = np.zeros_like(o)
    nxt = w[m]
    safe = np.where(z > 0, z, 1.0)
    for i in range(m - 1, -1, -1):
        one = nxt * ((m + 1) / (i + 1))                      # followed: o = 1
        zero = w[i] * ((m + 1) / (m - i)) / safe
        total += np.where(o > 0, one, np.where(z > 0, zero, 0.0))
        nxt = w[i] - one * z * ((m - i) / (m + 1))
    return total


def shap_values(forest: Forest, df: DataFrame, names: list[str], key: str, rounds: int | None = None,
                features: str = "x") -> tuple[DataFrame, float]:
    """Long table (key, feature, value, attribution) + base value; a missing
    value is null."""
    table, base = leaf_table(forest, rounds)
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, feature string, value double, attribution double"
    d = len(names)

    def run(batches):
        cases = None
        for b in batches:
            cases = cases or _Cases(table, d)
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                x = matrix(part.column(1), d)
                n = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(n), d))), pa.array(np.tile(np.array(names, dtype=object), n), pa.string()),
                    pa.array(x.ravel(), from_pandas=True), pa.array(cases.of(x).ravel())], [key, "feature", "value", "attribution"])

    # a row is little to read and much to work out: rows are dealt to all tasks, however few files hold them
    rows = df.select(F.col(key), F.col(features).alias("_x")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(run, schema), base


def shap_summary(values: DataFrame, top_n: int = 25) -> DataFrame:
    """Features by mean |attribution| (top ``top_n``), partial aggregate."""
    return (values.groupBy("feature").agg(
        F.avg(F.abs("attribution")).alias("mean_abs_attribution"),
        F.avg("attribution").alias("mean_attribution"),
        F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("mean_abs_attribution"), F.asc("feature")).limit(top_n))


def shap_plot_data(values: DataFrame, top_n: int = 25) -> DataFrame:
    """Points of the summary plot for the top features: attribution and
    the feature value scaled to [0, 1] within its feature (the colour).  ``values`` is
    read three times: it is written first."""
    from ..session import cut_lineage
    values = cut_lineage(values)
    top = shap_summary(values, top_n).select("feature", "mean_abs_attribution")
    rng = values.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    pts = values.join(top, "feature").join(rng, "feature")   # both: one row per feature
    scaled = F.when(F.col("_hi") > F.col("_lo"),
                    F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return pts.select(*[c for c in values.columns], "mean_abs_attribution",
                      scaled.alias("value_scaled"))


def gain_importance(forest: Forest, names: list[str], rounds: int | None = None) -> list[tuple[str, float]]:
    """Share of all splits' gain by feature (small list)."""
    f = forest.first(rounds)
    used = f.feature >= 0
    by = np.bincount(f.feature[used], weights=f.gain[used], minlength=len(names))
    return [(n, float(v / by.sum()) if by.sum() else 0.0) for n, v in zip(names, by)]


def permutation_importance(forest: Forest, df: DataFrame, names: list[str], key: str,
                           rounds: int | None = None, seed=0) -> DataFrame:
    """T9 (alternative view): drop in ROC AUC when one feature's values are
    permuted across rows (a random rotation of a random order), one row per feature.

    Rows are ranked once by a global md5 hash (bucketed, so no single task
    orders the table) and written; feature j's donors are the rows ``shift_j``
    ranks further on, so one self-join by rank serves all features: each row
    and its donor become one row a feature, with that slot replaced, and one
    AUC pass gives every feature's figure.
    """
    from ..session import cut_lineage
    from .model import margin, staged_auc
    from .sampling import hash_rank

    d = len(names)
    base = df.select(key, "label", F.col("x").alias("_x"))
    ranked = cut_lineage(hash_rank(base, key, [], f"{seed}|perm", out="_r", size_col="_n"))
    # one wanted donor rank a row and feature; feature -1 is the row itself
    want = ranked.select("label", "_x", F.explode(F.array(*[F.lit(j) for j in range(-1, d)])).alias("_j"), "_r", "_n")
    shift = F.pmod(F.xxhash64(F.lit(str(seed)), F.col("_j")), F.greatest(F.col("_n") - 1, F.lit(1))) + 1
    want = want.withColumn("_d", F.when(F.col("_j") < 0, F.col("_r")).otherwise(
        F.pmod(F.col("_r") - 1 + shift, F.col("_n")) + 1))
    donor = ranked.select(F.col("_r").alias("_d"), F.col("_x").alias("_from"))
    x = want.join(donor, "_d").select(
        F.col("_j"), "label", F.transform("_x", lambda v, i: F.when(
            i == F.col("_j"), F.get("_from", i)).otherwise(v)).alias("x"))
    auc = cut_lineage(staged_auc(margin(forest, x, d, rounds), col="_margin", by=["_j"], pr=False, length=ranked.count()).select("_j", "auc"))
    whole = auc.where("_j = -1").select("auc").scalar()
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("_j"))
    return auc.where("_j >= 0").select(name.alias("feature"), F.col("auc").alias("permuted_auc"),
                                       (whole - F.col("auc")).alias("auc_drop"))
