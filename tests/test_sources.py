import datetime as dt
import random

import pytest

from apptflow.schemas import APPOINTMENT_SCHEMA
from apptflow.sources import appointments_from_events, appointments_from_orders, read_appointments
from apptflow.operators.features import patient_features

SF = "/root/testdata/sf0.001"


def test_csv_scan_declared_schema(spark, tmp_path):
    p = tmp_path / "appts.csv"
    cols = [f.name for f in APPOINTMENT_SCHEMA.fields]
    lines = [",".join(cols)]
    vals = {"appt_id": "1", "patient_id": "p1", "clinic": "Ortho", "appointment_dt": "2024-01-05",
            "dna_flag": "1", "cancel_flag": "0", "age": "54.5"}
    lines.append(",".join(vals.get(c, "") for c in cols))
    vals.update(appt_id="2", appointment_dt="2024-02-05 14:30:00", dna_flag="0")
    lines.append(",".join(vals.get(c, "") for c in cols))
    p.write_text("\n".join(lines) + "\n")
    df = read_appointments(spark, str(p))
    assert df.columns == cols and dict(df.dtypes) == {f.name: f.dataType.simpleString() for f in APPOINTMENT_SCHEMA}
    rows = df.orderBy("appt_id").collect()
    assert rows[0].appointment_dt == dt.date(2024, 1, 5) and rows[0].age == 54.5
    assert rows[0].hospital is None and rows[1].appointment_dt == dt.date(2024, 2, 5)
    f = patient_features(df, min_count=1).collect()
    assert len(f) == 1 and f[0].appt_id == 2


SOURCE_HEADER = ["anonID", "anonClinic", "date_letter_received_dt", "appointment_dt", "cancelFlag", "dnaFlag",
                 "travelDist", "hospital", "age", "depriv_decile", "day_of_week", "appointment_type",
                 "referral_priority", "attendance_time", "month", "suspected_cancer", "refSource", "femaleSpec",
                 "paedSpec", "newAppt", "physioSpec", "raeiLeighTl", "T&Oappt", "followUpAppt", "time_to_be_seen_days"]


def _source_file(path, rows, header):
    """rows: dictionaries by source name."""
    path.write_text("\n".join([",".join(header)] + [",".join(str(r.get(c, "")) for c in header) for r in rows]) + "\n")
    return str(path)


def test_source_shape_any_column_order(spark, tmp_path):
    rows = [{"anonID": f"p{i % 3}", "anonClinic": f"c{i % 2}", "appointment_dt": f"2024-01-{i + 1:02d}", "dnaFlag": i % 2,
             "date_letter_received_dt": "2023-12-25", "cancelFlag": 0, "travelDist": i + .5, "T&Oappt": 1, "month": 1,
             "time_to_be_seen_days": 7 + i} for i in range(9)]
    rng = random.Random(1)
    for k in range(3):
        head = SOURCE_HEADER[:]
        rng.shuffle(head)
        df = read_appointments(spark, _source_file(tmp_path / f"a{k}.csv", rows, head))
        assert df.columns == [f.name for f in APPOINTMENT_SCHEMA]
        got = df.orderBy("appt_id").collect()
        assert [r.patient_id for r in got] == [r["anonID"] for r in rows]          # file order is the tiebreak
        assert [r.travel_dist for r in got] == [r["travelDist"] for r in rows]
        assert [r.dna_flag for r in got] == [r["dnaFlag"] for r in rows]
        assert all(r.tno_appt == 1 and r.hospital is None and r.clinic[0] == "c" for r in got)


def test_file_order_over_many_splits(spark, tmp_path):
    head = ["appointment_dt", "dnaFlag", "anonClinic", "cancelFlag", "anonID", "unknown_extra"]
    for f in range(3):
        _source_file(tmp_path / f"f{f}.csv", [{"anonID": f * 2000 + i, "anonClinic": "c", "appointment_dt": "2024-01-05",
                                               "dnaFlag": 0, "cancelFlag": 0, "unknown_extra": "x"} for i in range(2000)], head)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_appointments(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 6
        got = df.select("appt_id", "patient_id", "time_to_be_seen_days", "appt_month", "day_of_week").orderBy("appt_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [int(r.patient_id) for r in got] == list(range(6000))
    assert len({r.appt_id for r in got}) == 6000
    assert got[0][2:] == (None, 1, 5)


def test_lead_days_are_derived(spark, tmp_path):
    head = ["anonID", "anonClinic", "date_letter_received_dt", "appointment_dt", "dnaFlag", "cancelFlag"]
    df = read_appointments(spark, _source_file(tmp_path / "a.csv", [
        {"anonID": 1, "anonClinic": "c", "date_letter_received_dt": "2024-01-01", "appointment_dt": "2024-02-05", "dnaFlag": 0, "cancelFlag": 0},
        {"anonID": 2, "anonClinic": "c", "appointment_dt": "2024-02-05", "dnaFlag": 0, "cancelFlag": 0}], head))
    assert {r.patient_id: r.time_to_be_seen_days for r in df.collect()} == {"1": 35.0, "2": None}


def test_bad_files_are_refused(spark, tmp_path):
    ok = {"anonID": 1, "anonClinic": "c", "appointment_dt": "2024-02-05", "dnaFlag": 0, "cancelFlag": 0}
    head = list(ok)
    with pytest.raises(ValueError, match="dna_flag"):
        read_appointments(spark, _source_file(tmp_path / "missing.csv", [ok], [c for c in head if c != "dnaFlag"]))
    with pytest.raises(ValueError, match="twice"):
        read_appointments(spark, _source_file(tmp_path / "twice.csv", [ok], [*head, "dna_flag"]))
    with pytest.raises(Exception):
        read_appointments(spark, _source_file(tmp_path / "bad.csv", [{**ok, "dnaFlag": "often"}], head)).collect()
    d = tmp_path / "mixed"
    d.mkdir()
    _source_file(d / "a.csv", [ok], head)
    _source_file(d / "b.csv", [ok], head[::-1])
    with pytest.raises(Exception):
        read_appointments(spark, str(d)).collect()


def test_run_metrics_header_is_checked(spark, tmp_path):
    from apptflow.schemas import METRIC_NAMES
    from apptflow.sources import read_run_metrics
    names = [*METRIC_NAMES, "date"]
    (tmp_path / "1.csv").write_text(",".join(names) + "\n" + ",".join(["0.5"] * 11) + ",2024-05-14\n")
    assert read_run_metrics(spark, str(tmp_path)).first().run == 1
    (tmp_path / "1.csv").write_text(",".join(names[::-1]) + "\n2024-05-14," + ",".join(["0.5"] * 11) + "\n")
    with pytest.raises(Exception):
        read_run_metrics(spark, str(tmp_path)).collect()


def test_driver_views(spark):
    o = appointments_from_orders(spark, SF)
    e = appointments_from_events(spark, SF)
    assert o.count() == 1500 and e.count() == 1000
    assert o.select("patient_id").distinct().count() == 150


def test_missing_markers_are_null_and_garbage_fails(spark, tmp_path):
    head = "anonID,anonClinic,appointment_dt,dnaFlag,cancelFlag,age,travelDist"
    p = tmp_path / "a.csv"
    p.write_text(head + """\np1,A,2024-01-02,1,0,NA, 3.5 \np2,NA,2024-01-03,NA,,40,"NA"\nNA,B,NA,0,1, ,1e2\n""")
    got = {(r.patient_id, r.clinic, str(r.appointment_dt), r.dna_flag, r.cancel_flag, r.age, r.travel_dist)
           for r in read_appointments(spark, str(p)).collect()}
    assert got == {("p1", "A", "2024-01-02", 1, 0, None, 3.5), ("p2", None, "2024-01-03", None, None, 40.0, None),
                   (None, "B", "None", 0, 1, None, 100.0)}
    for bad in ("p1,A,2024-01-02,1,0,old,1", "p1,A,2024-13-02,1,0,1,1", "p1,A,2024-01-02,maybe,0,1,1", "p1,A,2024-01-02,1,0,1,n/a"):
        q = tmp_path / f"bad{abs(hash(bad))}.csv"
        q.write_text(head + "\np1,A,2024-01-02,1,0,1,1\n" + bad + "\n")
        with pytest.raises(Exception, match="holds a value that is no"):
            read_appointments(spark, str(q)).collect()


def test_run_metrics_with_missing_values(spark, tmp_path):
    from apptflow.schemas import METRIC_NAMES
    from apptflow.sources import read_run_metrics
    p = tmp_path / "1.csv"
    p.write_text(",".join([*METRIC_NAMES, "date"]) + "\n" + ",".join(["NA", "", *["0.5"] * (len(METRIC_NAMES) - 2), "2024-05-14"]) + "\n")
    r = read_run_metrics(spark, str(p)).first()
    assert r[METRIC_NAMES[0]] is None and r[METRIC_NAMES[1]] is None and r[METRIC_NAMES[2]] == 0.5
    p.write_text(",".join([*METRIC_NAMES, "date"]) + "\n" + ",".join(["high", *["0.5"] * (len(METRIC_NAMES) - 1), "2024-05-14"]) + "\n")
    with pytest.raises(Exception):
        read_run_metrics(spark, str(p)).collect()


def test_types_from_all_values(spark, tmp_path):
    from apptflow.sources.typed_text import inferred_types, read_text, read_typed
    cols = {"logical": ["T", "NA", "false"], "integer": ["1", "-20", ""], "double": ["1", "2.5", "1e3"], "date": ["2024-01-02", "NA", "2024-02-29"],
            "date-time": ["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02 03:04"], "text": ["1", "x", "2"], "none": ["NA", "", "NA"],
            "zeros": ["007", "008", "1"], "no date": ["2024-02-30", "2024-01-01", "NA"], "mixed": ["TRUE", "1", "NA"], "numbers and dates": ["1", "2024-01-01", ""]}
    want = {c: c for c in ("logical", "integer", "double", "date", "date-time", "text")}
    want |= {"none": "logical", "zeros": "text", "no date": "text", "mixed": "text", "numbers and dates": "text"}
    p = tmp_path / "t.csv"
    p.write_text("\n".join([",".join(cols), *[",".join(r) for r in zip(*cols.values())]]) + "\n")
    assert {r["column"]: r["type"] for r in inferred_types(read_text(spark, str(p))).collect()} == want
    rows = read_typed(spark, str(p)).collect()
    assert [r["integer"] for r in rows] == [1, -20, None] and [r["logical"] for r in rows] == [True, None, False]
    assert [r["double"] for r in rows] == [1.0, 2.5, 1000.0] and rows[0]["zeros"] == "007"
    # one late value among many files changes the type
    many = tmp_path / "many"
    many.mkdir()
    for i in range(8):
        (many / f"{i}.csv").write_text("a,b\n" + "\n".join(f"{j},{j}" for j in range(200)) + ("\nlate,1.5\n" if i == 7 else "\n"))
    assert {r["column"]: r["type"] for r in inferred_types(read_text(spark, str(many))).collect()} == {"a": "text", "b": "double"}
