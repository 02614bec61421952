import datetime as dt

from pyspark.sql import functions as F

from apptflow.functions.columns import (drop_last_char, iso_weekday, join_null_safe,
                                        lead_days, prefix_event, ratio)


def test_string_helpers(spark):
    df = spark.createDataFrame([("010",), ("",), ("1",), (None,)], "s string")
    got = [(r.p, r.d) for r in df.select(prefix_event(1, "s").alias("p"),
                                          drop_last_char(prefix_event(0, "s")).alias("d"))
           .collect()]
    assert got == [("1010", "001"), ("1", ""), ("11", "0"), (None, None)]


def test_date_helpers(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2023, 12, 30)), (dt.date(2024, 1, 7), None)], "d date, l date")
    got = [(r.w, r.s) for r in df.select(iso_weekday("d").alias("w"), lead_days("d", "l").alias("s")).collect()]
    assert got == [(1, 2.0), (7, None)]


def test_ratio_and_null_safe_join(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, w int")
    j = {(r.k, r.v, r.w) for r in join_null_safe(a, b, ["k"]).collect()}
    assert j == {("x", 1, 10), (None, 2, 20)}
    assert spark.range(1).select(ratio(F.lit(1), F.lit(4)).alias("r")).first().r == 0.25
