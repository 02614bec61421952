from pyspark.sql import functions as F

from apptflow.operators import sampling as SM


def labelled(spark, n1=10, n0=6, extra_null=True):
    rows = [(i, 1) for i in range(n1)] + [(100 + i, 0) for i in range(n0)]
    if extra_null:
        rows.append((999, None))
    return spark.createDataFrame(rows, "id long, y int")


def test_split_sizes_half_even(spark):
    s = SM.stratified_split(labelled(spark), "id", "y", 0.75, seed=3)
    c = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    # 7.5 -> 8 and 4.5 -> 4 (half-even); the null label is dropped
    assert c == {(1, "train"): 8, (1, "test"): 2, (0, "train"): 4, (0, "test"): 2}


def test_split_deterministic_and_partition_free(spark):
    df = labelled(spark, 300, 120, False)
    a = sorted(map(tuple, SM.stratified_split(df, "id", "y", 0.75, 7).collect()))
    b = sorted(map(tuple, SM.stratified_split(df.repartition(5), "id", "y", 0.75, 7).collect()))
    c = sorted(map(tuple, SM.stratified_split(df, "id", "y", 0.75, 8).collect()))
    assert a == b and a != c


def test_rank_is_permutation(spark):
    df = labelled(spark, 500, 300, False)
    r = SM.hash_rank(df, "id", ["y"], 1)
    for y, n in ((1, 500), (0, 300)):
        ranks = sorted(x.rank for x in r.where(F.col("y") == y).collect())
        assert ranks == list(range(1, n + 1))


def test_down_sample_equal_classes(spark):
    d = SM.down_sample(labelled(spark, 40, 9, False), "id", "y", 1)
    c = {r.y: r["count"] for r in d.groupBy("y").count().collect()}
    assert c == {1: 9, 0: 9}


def test_folds_balanced(spark):
    f = SM.assign_folds(labelled(spark, 50, 25, False), "id", "y", 5, 1)
    c = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    assert all(c[(1, k)] == 10 and c[(0, k)] == 5 for k in range(5))


def test_half_split(spark):
    df = spark.createDataFrame([(i, "high" if i % 3 else "low") for i in range(31)],
                               "id long, band string")
    h = SM.half_split(df, "id", ["band"], 0)
    c = {(r.band, r.arm): r["count"] for r in h.groupBy("band", "arm").count().collect()}
    assert c == {("high", "intervention"): 10, ("high", "control"): 10,
                 ("low", "intervention"): 6, ("low", "control"): 5}


def test_split_sizes_property(spark):
    from decimal import ROUND_HALF_EVEN, Decimal

    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=8, deadline=None)
    @given(st.integers(1, 60), st.integers(1, 60), st.sampled_from([0.5, 0.75, 0.8, 0.3]),
           st.integers(0, 10**6))
    def check(n1, n0, frac, seed):
        rows = [(i, 1) for i in range(n1)] + [(10**4 + i, 0) for i in range(n0)]
        df = spark.createDataFrame(rows, "id long, y int")
        s = SM.stratified_split(df, "id", "y", frac, seed).collect()
        for y, n in ((1, n1), (0, n0)):
            want = int(Decimal(repr(frac * n)).quantize(Decimal(1), ROUND_HALF_EVEN))
            assert sum(1 for r in s if r.y == y and r.split == "train") == want
        assert len({r.id for r in s}) == n1 + n0
        d = SM.down_sample(df, "id", "y", seed).groupBy("y").count().collect()
        assert {r["count"] for r in d} == {min(n1, n0)}
    check()
