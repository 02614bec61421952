"""Small hand tables (FIXTURES.md §3, §5)."""

import datetime as dt

from pyspark.sql import types as T

D = dt.date

APPT = T.StructType([
    T.StructField("appt_id", T.LongType()),
    T.StructField("patient_id", T.StringType()),
    T.StructField("clinic", T.StringType()),
    T.StructField("appointment_dt", T.DateType()),
    T.StructField("dna_flag", T.IntegerType()),
    T.StructField("cancel_flag", T.IntegerType()),
])

# 12-patient Markov edge fixture, rows in file order: (patient, date, flag)
MARKOV_ROWS = [
    ("A", D(2024, 1, 1), 0), ("A", D(2024, 2, 1), 1), ("A", D(2024, 3, 1), 0),
    ("B", D(2024, 1, 1), 0), ("B", D(2024, 2, 1), 1), ("B", D(2024, 3, 1), 1),
    ("C", D(2024, 1, 5), 0),
    ("D", D(2024, 1, 6), 1),
    ("E", D(2024, 1, 1), 0), ("E", D(2024, 2, 1), 1),
    ("F", D(2024, 1, 1), 0), ("F", D(2024, 2, 1), 0),
    ("G", D(2024, 3, 10), 0), ("G", D(2024, 3, 10), 1),
    ("H", D(2024, 1, 1), 1), ("H", D(2024, 2, 2), 0), ("H", D(2024, 2, 2), 1),
    *[("I", D(2023, m, 1), 0) for m in range(1, 8)],
    ("J", D(2024, 1, 1), 1), ("J", D(2024, 2, 1), None), ("J", D(2024, 3, 1), 0),
    ("K", D(2024, 1, 1), 0), ("K", None, 1),
    ("L", D(2024, 1, 1), None), ("L", D(2024, 2, 1), 1),
]

# patient -> (full, history, probability)
MARKOV_EXPECTED = {
    "A": ("010", "10", 1 / 2), "B": ("110", "10", 1 / 2), "C": ("0", None, None),
    "D": ("1", None, None), "E": ("10", "0", 1 / 2), "F": ("00", "0", 1 / 2),
    "G": ("01", None, None), "H": ("011", "1", 2 / 3), "I": ("000000", "00000", None),
    "J": ("01", "1", 2 / 3), "K": ("01", None, None), "L": ("1", "", 2 / 3),
}

SEQ_COUNTS = {"010": 1, "110": 1, "0": 1, "1": 2, "10": 1, "00": 1, "01": 3,
              "011": 1, "000000": 1}


def markov_df(spark):
    rows = [(i, p, "X", d, f, f) for i, (p, d, f) in enumerate(MARKOV_ROWS)]
    return spark.createDataFrame(rows, APPT)
