"""Declared schemas, display names and feature lists."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical appointment columns used by every operator (snake_case).
PATIENT = "patient_id"
CLINIC = "clinic"
DATE = "appointment_dt"
TIEBREAK = "appt_id"
DNA = "dna_flag"
CANCEL = "cancel_flag"

# Source schema for the appointment file (S1).  The reference infers types;
# we declare them so a scan never runs an inference pass over the data.
APPOINTMENT_SCHEMA = T.StructType([
    T.StructField("appt_id", T.LongType(), False),
    T.StructField("patient_id", T.StringType(), True),
    T.StructField("clinic", T.StringType(), True),
    T.StructField("appointment_dt", T.DateType(), True),
    T.StructField("letter_received_dt", T.DateType(), True),
    T.StructField("dna_flag", T.IntegerType(), True),
    T.StructField("cancel_flag", T.IntegerType(), True),
    T.StructField("time_to_be_seen_days", T.DoubleType(), True),
    T.StructField("travel_dist", T.DoubleType(), True),
    T.StructField("hospital", T.IntegerType(), True),
    T.StructField("age", T.DoubleType(), True),
    T.StructField("depriv_decile", T.IntegerType(), True),
    T.StructField("day_of_week", T.IntegerType(), True),
    T.StructField("appointment_type", T.IntegerType(), True),
    T.StructField("referral_priority", T.IntegerType(), True),
    T.StructField("attendance_time", T.IntegerType(), True),
    T.StructField("appt_month", T.IntegerType(), True),
    T.StructField("suspected_cancer", T.IntegerType(), True),
    T.StructField("ref_source", T.IntegerType(), True),
    T.StructField("female_spec", T.IntegerType(), True),
    T.StructField("paed_spec", T.IntegerType(), True),
    T.StructField("new_appt", T.IntegerType(), True),
    T.StructField("physio_spec", T.IntegerType(), True),
    T.StructField("raei_leigh_tl", T.IntegerType(), True),
    T.StructField("tno_appt", T.IntegerType(), True),
    T.StructField("follow_up_appt", T.IntegerType(), True),
])

# Column names of the source file that differ from the canonical
# ones (they must match for its files to be read).
SOURCE_NAMES = {
    "anonID": "patient_id",
    "anonClinic": "clinic",
    "date_letter_received_dt": "letter_received_dt",
    "dnaFlag": "dna_flag",
    "cancelFlag": "cancel_flag",
    "travelDist": "travel_dist",
    "month": "appt_month",
    "refSource": "ref_source",
    "femaleSpec": "female_spec",
    "paedSpec": "paed_spec",
    "newAppt": "new_appt",
    "physioSpec": "physio_spec",
    "raeiLeighTl": "raei_leigh_tl",
    "T&Oappt": "tno_appt",
    "followUpAppt": "follow_up_appt",
}

# Without these no feature can be made.
REQUIRED_COLUMNS = [PATIENT, CLINIC, DATE, DNA, CANCEL]

# Display names of the model features, in the reference's
# order (must match for the model table and the attribution report).
DISPLAY_NAMES = {
    "dna_markov": "DNA probability by sequence",
    "cancel_markov": "Cancellation probability by sequence",
    "time_to_be_seen_days": "Days between booking and appointment",
    "travel_dist": "Home to clinic distance (km)",
    "hospital": "Hospital",
    "age": "Age",
    "depriv_decile": "Deprivation decile",
    "day_of_week": "Attendance weekday",
    "appointment_type": "Appointment type",
    "referral_priority": "Referral priority",
    "attendance_time": "Attendance hour of day",
    "appt_month": "Month",
    "suspected_cancer": "Suspected cancer diagnosis",
    "clinic_prop": "DNA probability by clinic",
    "ref_source": "Source of referral",
    "three_mo_count": "Three month appt count",
    "female_spec": "Female specialty",
    "paed_spec": "Paediatric specialty",
    "new_appt": "New appt",
    "physio_spec": "Physiotherapy",
    "raei_leigh_tl": "RAEI, Leigh or Thomas Linacre",
    "tno_appt": "Trauma & Orthopaedics appt",
    "follow_up_appt": "Follow-up appt",
    "multi_day": "Multiple appts on same day",
}

# Features removed after trialling (display names).
PRUNED_FEATURES = ["Appointment type", "Month", "Referral priority", "Hospital"]

# Columns removed before modelling (ids, dates, the second outcome).
ID_COLUMNS = [PATIENT, CLINIC, "letter_received_dt", DATE, CANCEL, TIEBREAK]

# Per-run metric names and order of the published result files.
METRIC_NAMES = [
    "Sensitivity", "Specificity", "Pos.Pred.Value", "Neg.Pred.Value",
    "Precision", "Recall", "F1", "Prevalence", "Detection.Rate",
    "Detection.Prevalence", "Balanced.Accuracy",
]

METRICS_SCHEMA = T.StructType(
    [T.StructField(n, T.DoubleType(), True) for n in METRIC_NAMES]
    + [T.StructField("date", T.DateType(), True)]
)
