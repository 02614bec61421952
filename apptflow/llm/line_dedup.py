"""Line dedup by winnowing over line hashes.

A line (text between newlines) is hashed by its words, A-Z lowered; lines
without words are passed over.  A *window* is a line and as many following ones
as it takes to reach ``min_words`` words; a window is *repeated* if the same
lines in the same order occur earlier, by (document id, line).  Later repeats
are deleted: every line that a repeated window covers.  Overlapping repeated
windows join up.  With ``extend``, the shortest runs of ``min_words`` words that
*end* at each line are windows too, and a repeated run goes whole: a line of it
that has ``min_words`` words up to itself is the last of such a run, and any line
before is in the window of the run's first line.

Fingerprints are selected by winnowing: in each window, the smallest hash of
its grams (a line and as many following ones as reach ``gram_words`` words).
Equal windows have equal grams and so select the same fingerprint: a run of
``min_words`` words or more is guaranteed to be found by joining fingerprints.
Windows whose fingerprint occurs once are let go before windows are compared.

Nothing is paired: fingerprints are counted and windows joined with their first
occurrence, so a passage that a third of all documents share costs one row for
each occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, tidy
from .words import SPACE_WORDS, chunk_rows, mix, signed, text_buffers, words

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BASE = _U(0x5851F42D4C957F2D)
_BLANK = " \t\n\x0b\x0c\r"


def lines_of(buf: np.ndarray, off: np.ndarray):
    """Lines with words, of texts: (hash, words, text index)."""
    h, s, _, _ = words(buf, off, SPACE_WORDS)
    z = np.zeros(0, np.int64)
    if not len(h):
        return np.zeros(0, np.uint64), z, z
    begin = np.unique(np.concatenate([off[:-1], np.flatnonzero(buf == 10) + 1]))
    line = np.searchsorted(begin, s, side="right") - 1
    at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    n = np.diff(np.append(at, len(h)))
    place = (np.arange(len(h)) - np.repeat(at, n)).astype(np.uint64)
    lh = mix(np.add.reduceat(mix(h + place * _STEP), at) + n.astype(np.uint64))
    return lh, n, np.searchsorted(off, begin[line[at]], side="right") - 1


def _run_ends(total: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """Last line of the shortest run from each line with ``least`` words; -1 where
    the text ends before."""
    e = np.searchsorted(total, total[:-1] + least, side="left") - 1
    return np.where(e <= last, e, -1)


def _run_hashes(h: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the lines a..e, the same wherever the run stands."""
    n = len(h)
    power = np.ones(n + 1, np.uint64)
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    back = np.ones(n + 1, np.uint64)
    back[1:] = _U(pow(int(_BASE), -1, 1 << 64))
    back = np.multiply.accumulate(back)
    acc = np.concatenate([[_U(0)], np.add.accumulate(h * power[:-1])])
    return mix((acc[e + 1] - acc[a]) * back[a] + (e - a + 1).astype(np.uint64))


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a:b+1]) for each pair, by a sparse table."""
    out = np.empty(len(a), np.uint64)
    size = b - a + 1
    level, width = x, 1
    while True:
        here = (size >= width) & (size < 2 * width)
        if here.any():
            i, j = a[here], b[here] - width + 1
            out[here] = np.minimum(level[i], level[j])
        if not (size >= 2 * width).any():
            return out
        level = np.minimum(level[:-width], level[width:])
        width *= 2


def _run_starts(total: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """First line of the shortest run up to each line with ``least`` words; -1 where
    the text starts behind."""
    a = np.searchsorted(total, total[1:] - least, side="right") - 1
    return np.where(a >= first, a, -1)


def windows_of(h: np.ndarray, n: np.ndarray, text: np.ndarray, min_words: int, gram_words: int, extend: bool = False):
    """(first line, last line, fingerprint, hash) of every window."""
    z = np.zeros(0, np.int64)
    if not len(h):
        return z, z, z.view(np.uint64), z.view(np.uint64)
    total = np.concatenate([[0], np.cumsum(n)])
    last = np.searchsorted(text, text, side="right") - 1
    e, g = _run_ends(total, last, min_words), _run_ends(total, last, gram_words)
    a = np.flatnonzero(e >= 0)
    if extend:
        b = _run_starts(total, np.searchsorted(text, text), min_words)
        z = np.flatnonzero(b >= 0)
        z = z[e[b[z]] != z]          # the others are windows of their first line
        a, e = np.concatenate([a, b[z]]), np.concatenate([e[a], z])
    else:
        e = e[a]
    gram = np.full(len(h), _U(2**64 - 1))
    ok = np.flatnonzero(g >= 0)
    gram[ok] = _run_hashes(h, ok, g[ok])
    # grams inside window a..e start at a..m; a gram that leaves its text ends nowhere
    ends = np.maximum.accumulate(np.where(g >= 0, g, np.arange(len(h))))
    m = np.searchsorted(ends, e, side="right") - 1
    return a, e, _range_min(gram, a, m), _run_hashes(h, a, e)


def line_windows(docs: DataFrame, id_col: str, text_col: str, min_words: int, gram_words: int,
                 extend: bool = False) -> DataFrame:
    """(id, key, a, n, fp, wh): windows of every document; ``a`` counts lines with
    words from 0, ``key`` is a hash of the text."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"),
                      F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            buf, off = text_buffers(b.column(2))
            for lo, hi in chunk_rows(off):
                h, n, text = lines_of(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                a, e, fp, wh = windows_of(h, n, text, min_words, gram_words, extend)
                if not len(a):
                    continue
                row = text[a]
                first = np.searchsorted(text, row)
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array((a - first).astype(np.int32)),
                     pa.array((e - a + 1).astype(np.int32)), pa.array(signed(fp)), pa.array(signed(wh))],
                    ["id", "key", "a", "n", "fp", "wh"])

    return src.mapInArrow(tidy(run), T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("key", T.LongType()),
        T.StructField("a", T.IntegerType()), T.StructField("n", T.IntegerType()),
        T.StructField("fp", T.LongType()), T.StructField("wh", T.LongType())]))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int = 50, gram_words: int = 25,
                   extend: bool = False) -> DataFrame:
    """(id, key, runs): line ranges [from, to] that repeat earlier lines."""
    w = cut(line_windows(docs, id_col, text_col, min_words, gram_words, extend))
    often = w.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("fp")
    found = w.join(often, "fp", "left_semi").select("id", "key", "a", "n", "wh")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "a")
    # written, so both sides of the join are dealt anew and a window that a third of all
    # documents share is split among tasks as a skewed key
    first = cut(found.groupBy("wh").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
                .where("c > 1").select("wh", "first"))
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    start = F.when(own, F.greatest("a", F.col("first.a") + F.col("n"))).otherwise(F.col("a"))
    return (found.join(first, "wh")
            .where(~(own & (F.col("a") == F.col("first.a"))))
            .select("id", "key", start.alias("lo"), (F.col("a") + F.col("n") - 1).alias("hi")).where("lo <= hi")
            .groupBy("id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")))


def _without(text: str, runs) -> tuple[str, int]:
    """The text without the lines (counted among those with words) of the runs;
    lines without words between two deleted lines go with them."""
    lines = text.split("\n")
    real = [i for i, x in enumerate(lines) if x.strip(_BLANK)]
    gone = np.zeros(len(real) + 1, np.int64)
    for r in runs:
        gone[r["lo"]] += 1
        gone[r["hi"] + 1] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    drop = np.zeros(len(lines), bool)
    at = np.asarray(real)[gone]
    drop[at] = True
    idx = np.flatnonzero(gone)
    for x, y in zip(idx[:-1], idx[1:]):
        if y == x + 1:
            drop[real[x]:real[y]] = True
    return "\n".join(x for x, d in zip(lines, drop) if not d), int(gone.sum())


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50,
               gram_words: int = 25, extend: bool = False) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text_col``, plus
    ``lines_removed`` (long; a column of that name is replaced).  With ``extend``
whole repeated runs of ``min_words`` words or more go, else as far as windows
from a starting line cover them.

    Null texts stay null and empty texts empty (0 lines removed); a document of
    which every line repeats earlier ones ends with the empty text.  Documents
    are ordered by id, null ids last; rows with equal id and equal text are one
    document (they are not repeats of each other and are treated alike), rows
    with equal id and other text are ordered by a hash of the text.  A line that
    repeats within its own document is deleted after its first run.  Extra
    columns are kept as they are; an empty table gives an empty result."""
    if not 0 < gram_words <= min_words:
        raise ValueError("gram_words must be between 1 and min_words")
    runs = repeated_lines(docs, id_col, text_col, min_words, gram_words, extend)
    rest = [c for c in docs.columns if c not in (text_col, "lines_removed")]
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(id_col).alias("id"),
                       F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    right = runs.select(F.col("id").alias("rid"), F.col("key").alias("rkey"), "runs")
    both = left.join(right, (F.col("key") == F.col("rkey")) & F.col("id").eqNullSafe(F.col("rid")), "left") \
        .select("rest", "text", "runs")

    @F.pandas_udf("text string, n long")
    def clean(text, runs):
        import pandas as pd
        got = [(t, 0) if t is None or r is None else _without(t, r) for t, r in zip(text, runs)]
        return pd.DataFrame({"text": pd.Series([x[0] for x in got], dtype=object), "n": [x[1] for x in got]})

    # only the texts that change go through Python
    out = both.withColumn("new", clean(F.when(F.col("runs").isNotNull(), F.col("text")), "runs"))
    return out.select(
        *[F.coalesce("new.text", "text").alias(c) if c == text_col else F.col("rest")[c].alias(c)
          for c in docs.columns if c != "lines_removed"],
        F.coalesce("new.n", F.lit(0).cast("long")).alias("lines_removed"))
