"""Appointment tables.

The reference reads one appointment file (S1).  Its input is not public, so
the engine also maps the driver's tables onto the appointment schema:

* ``orders`` view: one appointment per order, the customer is the patient and
  the customer's nation is the clinic (sparse histories, ~10 per patient);
* ``events`` view: one appointment per event, dense histories with many
  same-day rows (exercises every tie rule).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import flag, iso_weekday, lead_days
from ..schemas import APPOINTMENT_SCHEMA, REQUIRED_COLUMNS, SOURCE_NAMES
from .tables import read_table
from .typed_text import parsed, read_text


def read_appointments(spark: SparkSession, path: str, fmt: str = "csv",
                      schema=APPOINTMENT_SCHEMA) -> DataFrame:
    """An appointment file or folder, columns by header name.

    A column is known by its canonical or its source name, in any order; other
    columns are left out.  Empty cells and ``NA`` are null in every column, white
    space around a value doesn't count.  A file without one of the required columns
    raises ValueError; another value that doesn't fit its declared type fails the
    query that reads it.
    Optional feature columns that are absent are null, except those that follow
    from dates: lead days, month and weekday.  Without an appointment id the
    place in the file is the tiebreak (files in order of name)."""
    if fmt == "csv":
        head = spark.read.option("header", True).csv(path).columns
    else:
        head = spark.read.format(fmt).load(path).columns
    canonical = {f.name for f in schema.fields}
    of = {c: SOURCE_NAMES.get(c, c) for c in head}
    double = sorted({c for c in canonical if sum(v == c for v in of.values()) > 1})
    missing = [c for c in REQUIRED_COLUMNS if c not in of.values()]
    if double or missing:
        raise ValueError(f"appointment file: columns missing {missing}, given twice {double}")
    if fmt == "csv":
        df = read_text(spark, path, head)
    else:
        df = spark.read.format(fmt).load(path)
    if "appt_id" not in of.values():
        df = df.select("*", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"))
        df = _with_place(df)
    have = {of.get(c, c): c for c in df.columns}
    value = parsed if fmt == "csv" else (lambda c, t: F.col(f"`{c}`").cast(t))
    cols = {f.name: (F.col("appt_id").cast(f.dataType) if have[f.name] == "appt_id" and "appt_id" not in of.values()
                     else value(have[f.name], f.dataType)) if f.name in have
            else F.lit(None).cast(f.dataType) for f in schema.fields}
    if "time_to_be_seen_days" not in have:
        cols["time_to_be_seen_days"] = lead_days(cols["appointment_dt"], cols["letter_received_dt"])
    if "appt_month" not in have:
        cols["appt_month"] = F.month(cols["appointment_dt"])
    if "day_of_week" not in have:
        cols["day_of_week"] = iso_weekday(cols["appointment_dt"])
    return df.select(*[x.alias(c) for c, x in cols.items()])


def _with_place(df: DataFrame) -> DataFrame:
    """``appt_id`` from the place in the files: the split's number (by file name
    and position, a row for each split), then the row's place in the split."""
    at = df.withColumn("_at", F.monotonically_increasing_id())
    splits = at.groupBy("_file", "_block").agg(F.min("_at").alias("_first"))
    order = splits.withColumn("_split", F.row_number().over(Window.orderBy("_file", "_block")).cast("long"))
    j = at.join(order, ["_file", "_block"])
    place = F.shiftleft("_split", 40) + F.col("_at") - F.col("_first")
    return j.withColumn("appt_id", place).drop("_file", "_block", "_at", "_first", "_split")


def appointments_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation as appointments.

    ``nation`` has a fixed 25 rows, so it is broadcast; the customer join is
    left to the planner (AQE turns it into a broadcast join only when the
    measured size is under the threshold).
    """
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    d = F.to_date("o_orderdate")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").alias("appt_id"),
            F.col("o_custkey").alias("patient_id"),
            F.col("n_name").alias("clinic"),
            d.alias("appointment_dt"),
            flag(F.col("o_orderstatus") == "F").alias("dna_flag"),
            flag(F.col("o_orderstatus") == "P").alias("cancel_flag"),
            F.col("o_totalprice").alias("travel_dist"),
            F.col("c_acctbal").alias("age"),
            F.month(d).alias("appt_month"),
            iso_weekday(d).alias("day_of_week"),
            flag(F.col("o_orderpriority") == "1-URGENT").alias("new_appt"),
        )
    )


def appointments_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as appointments: dense histories, many rows per day."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("appt_id"),
        F.col("user_id").alias("patient_id"),
        F.col("event_type").alias("clinic"),
        F.to_date("ts").alias("appointment_dt"),
        flag(F.col("value") > 50).alias("dna_flag"),
        flag(F.col("event_type") == "error").alias("cancel_flag"),
        F.hour("ts").alias("attendance_time"),
    )


# SQL of the two views, for the DuckDB oracle (same rows as above).
ORDERS_VIEW_SQL = """
SELECT o.o_orderkey AS appt_id, o.o_custkey AS patient_id, n.n_name AS clinic,
       CAST(o.o_orderdate AS DATE) AS appointment_dt,
       CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS dna_flag,
       CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END AS cancel_flag,
       o.o_totalprice AS travel_dist, c.c_acctbal AS age,
       CAST(month(o.o_orderdate) AS INTEGER) AS appt_month,
       CAST(isodow(o.o_orderdate) AS INTEGER) AS day_of_week,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS new_appt
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
              JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

EVENTS_VIEW_SQL = """
SELECT event_id AS appt_id, user_id AS patient_id, event_type AS clinic,
       CAST(ts AS DATE) AS appointment_dt,
       CASE WHEN value > 50 THEN 1 ELSE 0 END AS dna_flag,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS cancel_flag,
       CAST(hour(ts) AS INTEGER) AS attendance_time
FROM events
"""
