"""Exact, repeatable sampling by hash rank.

Rows of every stratum are taken in the order of ``md5(key || '|' || seed)`` (ties
by key; keys are unique in a stratum).  md5 text is identical in Spark and SQL
engines, so every sample is reproducible and checkable in SQL.

Samples of a given size (``below_cut``) need one row's place, not every row's rank:
rows are counted by (stratum, first 3 hex digits), map-side first; the bucket that
holds the wanted rank is the only one whose rows are ordered, a 4,096th of the
stratum; and every row is then compared with that row's hash, without a shuffle.
There is one cut a stratum; the table of cuts is written, so its rows are counted
before it is broadcast.

``hash_rank`` numbers all rows 1..n, for folds and permutations.  Scale: a window partitioned by the stratum alone would sort the majority
class (or any hot stratum) in one task.  Instead the leading 4 hex digits of
the hash split every stratum into 65,536 buckets of near-equal size.  A
count per (stratum, bucket) is pre-aggregated map-side, turned into running
offsets (at most 65,536 rows per stratum), joined back on (stratum, bucket) —
the key the row-level window already partitions by, so only the offsets
move — and added to a row number inside each (stratum, bucket).
Same ranks, no task holds more than ~1/65,536 of a stratum.

The input is read twice (bucket counts, then ranks); callers materialise
an expensive input first (the training plan checkpoints its table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe
from ..session import cut_lineage

BUCKET_HEX = 4  # 16^4 = 65,536 buckets per stratum
CUT_HEX = 3     # 16^3 = 4,096 buckets per stratum where only one is ordered
MOST_CUTS = 100_000   # rows of a table of cuts that is broadcast


def hash_key(key: str, seed) -> Column:
    """``seed``: a value, or a column for a seed by row."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), seed.cast("string")))


def hash_rank(df: DataFrame, key: str, strata: list[str], seed=0, out: str = "rank",
              size_col: str | None = "_n") -> DataFrame:
    """Adds ``out`` (1-based rank within stratum) and ``size_col`` (stratum size)."""
    x = df.withColumn("_h", hash_key(key, seed)).withColumn(
        "_b", F.substring("_h", 1, BUCKET_HEX))
    counts = x.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = (Window.partitionBy(*strata).orderBy("_b")
              .rowsBetween(Window.unboundedPreceding, -1))
    offs = counts.select(*strata, "_b",
                         F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                         F.sum("_c").over(Window.partitionBy(*strata)).alias("_n"))
    wr = Window.partitionBy(*strata, "_b").orderBy("_h", key)
    ranked = x.withColumn("_r", F.row_number().over(wr))
    # ``ranked`` is already hash-partitioned on (strata, _b) by its window, so
    # this join moves only the small offsets table; AQE broadcasts it when
    # its measured size is under the threshold.
    j = join_null_safe(ranked, offs, [*strata, "_b"])
    res = j.withColumn(out, (F.col("_off") + F.col("_r")).cast("long"))
    keep = [*df.columns, out] + ([size_col] if size_col else [])
    if size_col and size_col != "_n":
        res = res.withColumnRenamed("_n", size_col)
    return res.select(*keep)


def _with(seed, what: str):
    """The seed of a second use of the same rows."""
    return F.concat_ws("|", seed.cast("string"), F.lit(what)) if isinstance(seed, Column) else f"{seed}|{what}"


def below_cut(df: DataFrame, key: str, strata: list[str], seed, take, out: str = "_in") -> DataFrame:
    """Adds ``out``: whether the row is among the first ``take`` of its stratum in
    hash order.  ``take`` is a function of the table (strata, _n: size)."""
    x = df.withColumn("_h", hash_key(key, seed))
    b = F.substring("_h", 1, CUT_HEX)
    counts = x.groupBy(*strata, b.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*strata)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sized = counts.select(*strata, "_b", "_c", F.sum("_c").over(upto).alias("_to"), F.sum("_c").over(whole).alias("_n"))
    # one row a stratum: the bucket of the wanted rank (none: nothing is taken)
    held = take(sized).where((F.col("_take") <= F.col("_to")) & (F.col("_take") > F.col("_to") - F.col("_c")))
    held = cut_lineage(held.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_b").alias("_bucket"),
                                   (F.col("_take") - F.col("_to") + F.col("_c")).cast("long").alias("_at")))
    few = held.count() <= MOST_CUTS
    same = F.lit(True)
    for i, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{i}"))

    def small(t):
        return F.broadcast(t) if few else t

    inside = x.join(small(held), same & (b == F.col("_bucket"))).select(*[f"_s{i}" for i in range(len(strata))], "_at", "_h",
                                                                       F.col(key).alias("_k"))
    place = F.row_number().over(Window.partitionBy(*[f"_s{i}" for i in range(len(strata))]).orderBy("_h", "_k"))
    cut = cut_lineage(inside.withColumn("_r", place).where(F.col("_r") == F.col("_at")).select(
        *[f"_s{i}" for i in range(len(strata))], F.struct("_h", "_k").alias("_cut")))
    return x.join(small(cut), same, "left").select(
        *df.columns, F.coalesce(F.struct(F.col("_h"), F.col(key).alias("_k")) <= F.col("_cut"), F.lit(False)).alias(out))


def _share(frac: float):
    """The first bround(frac * n) of every stratum."""
    return lambda t: t.withColumn("_take", F.bround(F.lit(frac) * F.col("_n"), 0))


def stratified_split(df: DataFrame, key: str, label: str, frac: float = 0.75, seed=0,
                     out: str = "split", by=()) -> DataFrame:
    """D1 + D2: exact ``bround(frac * n)`` rows of every class go to 'train',
    the rest to 'test'.  Null labels are dropped first (they are no class).
    ``by`` adds grouping columns (e.g. the run, with its number as the seed)."""
    r = below_cut(df.where(F.col(label).isNotNull()), key, [*by, label], seed, _share(frac))
    return r.withColumn(out, F.when(F.col("_in"), F.lit("train")).otherwise(F.lit("test"))).drop("_in")


def down_sample(df: DataFrame, key: str, label: str, seed=0, by=()) -> DataFrame:
    """D3: every class (of a group of ``by``) cut to the size of the smallest class,
    without replacement; the smallest class is kept whole."""
    def smallest(t):
        # classes a group of ``by``: a few rows
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        return t.withColumn("_take", F.min("_n").over(w))
    r = below_cut(df, key, [*by, label], _with(seed, "down"), smallest)
    return r.where("_in").drop("_in")


def assign_folds(df: DataFrame, key: str, label: str, k: int = 5, seed=0,
                 out: str = "fold", by=()) -> DataFrame:
    """Stratified folds 0..k-1 (rank within class modulo k)."""
    r = hash_rank(df, key, [*by, label], _with(seed, "fold"), size_col=None)
    return r.withColumn(out, F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("rank")


def half_split(df: DataFrame, key: str, strata: list[str], seed=0, out: str = "arm",
               first: str = "intervention", second: str = "control") -> DataFrame:
    """Random 50:50 split inside every stratum (bround(n/2) in ``first``)."""
    r = below_cut(df, key, strata, _with(seed, "arm"), _share(0.5))
    return r.withColumn(out, F.when(F.col("_in"), F.lit(first)).otherwise(F.lit(second))).drop("_in")
