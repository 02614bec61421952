"""Event sequences and the Markov next-event estimator.

Sequence semantics (per patient, rows ordered newest first by date, ties in
file order = ascending ``tiebreak``, null dates last):

* full sequence (M1): flags of the newest ``order`` rows, newest leftmost,
  null flags skipped after the cut;
* history (M3): drop every row on the patient's newest date, then the same
  with ``order - 1`` rows.  A patient with any null date, or with all rows on
  one date, has no history (null);
* probability (M4–M6) of history ``s``: ``c(1s) / (c(0s) + c(1s))`` when both
  full sequences were counted, else the same with the oldest event removed
  from both keys, else null.  ``c`` counts patients by full sequence.

Scale: the rows that can influence a patient's sequences are the first
``order`` rows of each (patient, day) and, of those, the rows on the newest
``order + 1`` distinct day-ranks (null dates ranked first).  Both cuts are
rank filters, which Spark plans as a partial ``WindowGroupLimit`` *before* the
shuffle, so a patient (or patient-day) holding a third of all rows still ships
at most ``order * (order + 1)`` rows per map task.  Everything per patient is
then one bounded ``collect_list`` (<= 42 structs).  The count table over full
sequences has at most 2^0 + ... + 2^order keys (127 for 0/1 flags), so it
enters the per-patient projection as one map-valued scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..functions.columns import drop_last_char, flag, join_null_safe, prefix_event
from ..schemas import CANCEL, DATE, DNA, PATIENT, TIEBREAK

DEFAULT_EVENTS = {DNA: "dna", CANCEL: "cancel"}


def event_char(c: str) -> Column:
    """0/1 flag as the sequence character; any other value counts as missing."""
    x = F.col(c)
    return F.when(x == 1, F.lit("1")).when(x == 0, F.lit("0"))


def rank_appointments(df: DataFrame, patient: str = PATIENT, date: str = DATE,
                      tiebreak: str = TIEBREAK, out: str = "rn", parts: int | None = None) -> DataFrame:
    """Rank of every appointment within its patient, newest first
    (null dates last, ties by ascending ``tiebreak``).

    Rows are range-partitioned and sorted on (patient, day, tiebreak), numbered
    inside their slice as they stream by, and written once with the slice
    number.  Only patients that a slice boundary cuts need an offset; there are
    at most two (patient, slice) rows a boundary, so that table is bounded by
    the number of slices however hot a patient is.
    """
    day_key = F.coalesce(-F.unix_date(F.col(date)), F.lit(2**31 - 1))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = (df.withColumn("_dk", day_key).repartitionByRange(parts, patient, "_dk", tiebreak)
         .sortWithinPartitions(patient, "_dk", tiebreak).withColumn("_pid", F.spark_partition_id()))
    y = cut_lineage(_numbered(x, patient))
    offs = slice_offsets(y, patient)
    j = y.join(F.broadcast(offs), y[patient].eqNullSafe(offs["_p"]) & (y["_pid"] == offs["_q"]), "left")
    return j.select(*[y[c] for c in df.columns],
                    (F.coalesce("_off", F.lit(0)) + F.col("_rk")).cast("int").alias(out))


def slice_offsets(numbered: DataFrame, patient: str = PATIENT) -> DataFrame:
    """(_p, _q, _off): rows of a patient in the slices before ``_q``, for patients
    in more than one slice; two rows a boundary at most.  Such a patient is the
    first or the last of its slice, so no other is grouped (a null one comes first)."""
    ends = numbered.groupBy(F.col("_pid").alias("_s")).agg(F.min(patient).alias("_lo"), F.max(patient).alias("_hi"))
    p = F.col(patient)
    at_end = numbered.join(F.broadcast(ends), (F.col("_pid") == F.col("_s")) & (
        p.isNull() | (p == F.col("_lo")) | (p == F.col("_hi"))))          # a row a slice is broadcast
    n = at_end.groupBy(p.alias("_p"), F.col("_pid").alias("_q")).agg(F.max("_rk").alias("_n"))
    w = Window.partitionBy("_p").orderBy("_q")
    return (n.withColumn("_off", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
            .where(F.col("_off").isNotNull()).select("_p", "_q", "_off"))


def _numbered(df: DataFrame, patient: str) -> DataFrame:
    """Adds ``_rk``: place among its patient's rows in the (sorted) partition."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    at = df.columns.index(patient)

    def run(batches):
        last, seen = None, 0                 # the patient at the end of the batch before, its rows so far
        for b in batches:
            if not b.num_rows:
                continue
            code = pc.fill_null(pc.dictionary_encode(b.column(at)).indices, -1).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            size = np.diff(np.append(begin, b.num_rows))
            rk = np.arange(b.num_rows) - np.repeat(begin, size) + 1
            first = b.column(at)[0].as_py()
            if seen and first == last:
                rk[:size[0]] += seen
            last, seen = b.column(at)[b.num_rows - 1].as_py(), int(rk[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rk)], [*b.schema.names, "_rk"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_rk", T.LongType())]))


def newest_rows(df: DataFrame, n: int, patient: str = PATIENT, date: str = DATE,
                tiebreak: str = TIEBREAK, out: str = "rn") -> DataFrame:
    """The newest ``n`` rows of every patient (partial WindowGroupLimit)."""
    w = Window.partitionBy(patient).orderBy(F.col(date).desc_nulls_last(),
                                            F.col(tiebreak).asc())
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def rows_before_last_date(df: DataFrame, patient: str = PATIENT,
                          date: str = DATE) -> DataFrame:
    """Drop every row on the patient's newest date.

    R semantics: a patient with any null date keeps no rows (``max`` is NA).
    The per-patient maximum is a map-side pre-aggregated table joined back
    (AQE splits a skewed patient partition; the right side is one row per key).
    """
    mx = df.groupBy(patient).agg(
        F.max(date).alias("_mx"),
        F.max(F.col(date).isNull()).alias("_has_null"))
    j = join_null_safe(df, mx, [patient])
    return j.where(~F.col("_has_null") & (F.col(date) < F.col("_mx"))).drop("_mx", "_has_null")


def sequence_candidates(df: DataFrame, patient: str = PATIENT, date: str = DATE,
                        tiebreak: str = TIEBREAK, cols=(), order: int = 6) -> DataFrame:
    """Bounded set of rows per patient that determines all sequence outputs."""
    if not 1 <= order <= 12:     # the count table has 2**(order + 1) keys
        raise ValueError("order must be from 1 to 12")
    base = df.select(patient, date, tiebreak, *cols)
    w_day = Window.partitionBy(patient, date).orderBy(F.col(tiebreak).asc())
    # >= 2 per day so "more than one row on the newest day" stays exact
    per_day = (base.withColumn("_rd", F.row_number().over(w_day))
               .where(F.col("_rd") <= max(order, 2)).drop("_rd"))
    w_pat = Window.partitionBy(patient).orderBy(F.col(date).desc_nulls_first())
    return (per_day.withColumn("_dr", F.dense_rank().over(w_pat))
            .where(F.col("_dr") <= order + 1).drop("_dr"))


def _join_events(arr: Column, name: str) -> Column:
    return F.array_join(F.transform(arr, lambda x: x[name]), "")


def patient_sequences(df: DataFrame, events: dict[str, str] | None = None,
                      patient: str = PATIENT, date: str = DATE,
                      tiebreak: str = TIEBREAK, order: int = 6,
                      carry=()) -> DataFrame:
    """M1 + M3 (+ G2, A4 for the latest row) in one pass; one row per patient.

    Columns: ``patient``, ``max_dt``, ``has_null_dt``, ``full_<e>`` and
    ``history_<e>`` for each event, ``multi_day`` (rows on the newest date > 1)
    and ``latest`` (struct of the first row on the newest date, null when
    the patient has only null dates) carrying ``tiebreak``, ``date``, the event
    columns and ``carry``.
    """
    events = events or DEFAULT_EVENTS
    ev_cols = list(events)
    carry = [c for c in carry if c not in (patient, date, tiebreak, *ev_cols)]
    cand = sequence_candidates(df, patient, date, tiebreak, cols=[*ev_cols, *carry],
                               order=order)
    item = F.struct(
        F.col(date).isNull().alias("_n"),
        (-F.unix_date(F.col(date))).alias("_d"),
        F.col(tiebreak).alias("_t"),
        F.col(date).alias("_dt"),
        *[event_char(c).alias(f"_e_{a}") for c, a in events.items()],
        F.struct(F.col(tiebreak), F.col(date), *[F.col(c) for c in ev_cols],
                 *[F.col(c) for c in carry]).alias("_row"),
    )
    g = cand.groupBy(patient).agg(
        F.max(date).alias("max_dt"),
        F.max(F.col(date).isNull()).alias("has_null_dt"),
        F.array_sort(F.collect_list(item)).alias("_rows"))
    rows = F.col("_rows")
    hist = F.filter(rows, lambda x: x["_dt"] < F.col("max_dt"))
    has_hist = ~F.col("has_null_dt") & (F.size(hist) > 0)
    out = [F.col(patient), F.col("max_dt"), F.col("has_null_dt")]
    for _, a in events.items():
        out.append(_join_events(F.slice(rows, 1, order), f"_e_{a}").alias(f"full_{a}"))
        out.append(F.when(has_hist, _join_events(F.slice(hist, 1, order - 1), f"_e_{a}"))
                   .alias(f"history_{a}"))
    on_last = F.size(F.filter(rows, lambda x: x["_dt"] == F.col("max_dt")))
    out.append(flag(on_last > 1).alias("multi_day"))
    first = F.element_at(rows, 1)
    out.append(F.when(first["_dt"].isNotNull(), first["_row"]).alias("latest"))
    return g.select(*out)


def full_sequences(df: DataFrame, event: str = DNA, **kw) -> DataFrame:
    """M1: (patient, sequence) — newest ``order`` flags, newest leftmost."""
    p = kw.get("patient", PATIENT)
    s = patient_sequences(df, {event: "e"}, **kw)
    return s.select(p, F.col("full_e").alias("sequence"))


def history_sequences(df: DataFrame, event: str = DNA, **kw) -> DataFrame:
    """M3: (patient, sequence) for patients with a history (as the reference's
    per-patient table: patients without history have no row)."""
    p = kw.get("patient", PATIENT)
    s = patient_sequences(df, {event: "e"}, **kw)
    return s.where(F.col("history_e").isNotNull()).select(p, F.col("history_e").alias("sequence"))


def sequence_counts(seqs: DataFrame, full_col: str = "sequence") -> DataFrame:
    """M2 / A5: number of patients per full sequence."""
    return seqs.groupBy(F.col(full_col).alias("sequence")).agg(F.count(F.lit(1)).alias("count"))


def count_map(counts: DataFrame, out: str = "_m") -> DataFrame:
    """One-row DataFrame holding the (bounded) sequence-count table as a map."""
    return counts.agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("sequence"), F.col("count")))).alias(out))


def probability_expr(history: Column | str, counts_map: Column | str) -> Column:
    """M4–M6 as a column expression over a history and the count map."""
    h = F.col(history) if isinstance(history, str) else history
    m = F.col(counts_map) if isinstance(counts_map, str) else counts_map
    k1, k0 = prefix_event(1, h), prefix_event(0, h)
    c1, c0 = F.try_element_at(m, k1), F.try_element_at(m, k0)
    b1 = F.try_element_at(m, drop_last_char(k1))
    b0 = F.try_element_at(m, drop_last_char(k0))
    # try_divide: Spark may evaluate CASE branches eagerly under ANSI mode
    direct = F.try_divide(c1.cast("double"), (c0 + c1).cast("double"))
    backed = F.try_divide(b1.cast("double"), (b0 + b1).cast("double"))
    return (F.when(c1.isNotNull() & c0.isNotNull(), direct)
            .when(b1.isNotNull() & b0.isNotNull(), backed))


def sequence_probabilities(seqs: DataFrame, full_col: str = "full",
                           history_col: str = "history") -> DataFrame:
    """M4–M6: (sequence, prob) for every distinct history (prob null when
    neither the direct nor the backed-off pair was counted)."""
    m = count_map(sequence_counts(seqs, full_col)).scalar()
    hs = (seqs.where(F.col(history_col).isNotNull())
          .select(F.col(history_col).alias("sequence")).distinct())
    return hs.select("sequence", probability_expr("sequence", m).alias("prob"))


def probability_map(seqs: DataFrame, full_col: str, history_col: str, out: str = "_m") -> DataFrame:
    """One-row DataFrame holding the probability of every distinct history (bounded as
    the counts are) as a map: a patient's row needs one lookup, not one a count."""
    return sequence_probabilities(seqs, full_col, history_col).agg(
        F.map_from_entries(F.collect_list(F.struct("sequence", "prob"))).alias(out))


def no_history_marginal(seqs: DataFrame, full_col: str = "full") -> DataFrame:
    """M7: c('1') / (c('0') + c('1')) over full sequences (one row)."""
    ones = F.count(F.when(F.col(full_col) == "1", 1))
    zeros = F.count(F.when(F.col(full_col) == "0", 1))
    return seqs.agg(F.when((ones > 0) & (zeros > 0),
                           F.try_divide(ones.cast("double"), (zeros + ones).cast("double")))
                    .alias("no_history_prob"))


def markov_probability(df: DataFrame, event: str = DNA, patient: str = PATIENT,
                       date: str = DATE, tiebreak: str = TIEBREAK,
                       order: int = 6) -> DataFrame:
    """The reference's per-event table: (patient, sequence, event) for
    patients with a history; ``event`` is null when not estimable."""
    s = patient_sequences(df, {event: "e"}, patient=patient, date=date,
                          tiebreak=tiebreak, order=order)
    m = count_map(sequence_counts(s, "full_e")).scalar()
    return (s.where(F.col("history_e").isNotNull())
            .select(patient, F.col("history_e").alias("sequence"),
                    probability_expr("history_e", m).alias("event")))


def pivot_events(df: DataFrame, event: str = DNA, n: int = 6, patient: str = PATIENT,
                 date: str = DATE, tiebreak: str = TIEBREAK) -> DataFrame:
    """Newest ``n`` flags per patient as columns ``1`` … ``n``."""
    top = newest_rows(df.select(patient, date, tiebreak, event), n, patient, date, tiebreak)
    return (top.groupBy(patient).pivot("rn", list(range(1, n + 1)))
            .agg(F.first(event)))


def unite_columns(df: DataFrame, cols: list[str], out: str = "sequence") -> DataFrame:
    """R2: join columns into one string, nulls removed (all null -> '')."""
    arr = F.array(*[F.col(f"`{c}`").cast("string") for c in cols])
    return df.withColumn(out, F.array_join(arr, ""))
