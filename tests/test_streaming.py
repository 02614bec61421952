"""The per-row trial operators apply unchanged to a streaming DataFrame."""

import datetime as dt

from pyspark.sql import functions as F

from apptflow.operators import trial as TR


def test_bands_and_reminders_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, dt.date(2024, 3, 10), 0.9 if i % 2 else 0.1) for i in range(6)]
    spark.createDataFrame(rows, "appt_id long, appointment_dt date, probability double") \
        .write.parquet(src)
    stream = spark.readStream.schema("appt_id long, appointment_dt date, probability double") \
        .parquet(src)
    banded = TR.assign_bands(stream, "probability", 0.5).withColumn(
        "arm", F.when(F.col("band") == "high", "intervention").otherwise("control"))
    q = (TR.reminder_schedule(banded).writeStream.format("memory").queryName("reminders")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    out = spark.sql("SELECT * FROM reminders").collect()
    assert len(out) == 3 * 2 + 3
    assert {(r.days_before, r.reminder_dt) for r in out if r.arm == "intervention"} == {
        (5, dt.date(2024, 3, 5)), (3, dt.date(2024, 3, 7))}
