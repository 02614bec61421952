"""Quality classifier: regularised quadratic discriminant.

Each text becomes a vector of transformed document statistics.  Class means and
covariances are sums over the labelled rows, made in each task and added by
Spark; the covariances are shrunk towards the pooled one and towards a sphere.
A score is the posterior of label 1: the difference of two Mahalanobis
log-densities, from Cholesky factors that are computed once and kept with the
model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, tidy
from .words import SPACE_WORDS, chunk_rows, mix, run_hash, text_buffers, words

# Character classes by byte; bytes of multi-byte characters are letters.
_CLASSES = ("upper", "digit", "mark", "bar", "symbol", "space", "newline")
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[ord(c) for c in "!?"]] = 3
_CLASS[[ord(c) for c in "|<>{}[]\\^~`"]] = 4
_CLASS[[ord(c) for c in "#$%&*@+=_/"]] = 5
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 6
_CLASS[0x0A] = 7

NAMES = ("log_words", "log_word_length", "upper", "digit", "mark", "bar", "symbol", "space", "newline",
         "letter_case", "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "short_words",
         "log_line_words")


def _per_text(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of x over [off[i], off[i+1])."""
    out = np.zeros(len(off) - 1)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(x, off[full], dtype=np.int64)
    return out


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct entries, count of the most frequent one) by text; entries are
    told apart by 44 bits of their hash."""
    n = len(first) - 1
    if not len(h):
        return np.zeros(n), np.zeros(n)
    bits = np.uint64(44)
    key = (np.repeat(np.arange(n, dtype=np.uint64), np.diff(first)) << bits) | (h >> (np.uint64(64) - bits))
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    row = (key[at] >> bits).astype(np.int64)
    most = np.zeros(n)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    most[row[begin]] = np.maximum.reduceat(np.diff(np.append(at, len(h))), begin)
    return np.bincount(row, minlength=n).astype(float), most


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Transformed statistics (texts x len(NAMES)); an empty text has those of
    no words, which are finite."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    h, s, e, first = words(buf, off, SPACE_WORDS)
    w = np.diff(first).astype(float)
    cls = _CLASS[buf]
    share = [_per_text((cls == k).view(np.uint8), off) for k in range(1, len(_CLASSES) + 1)]
    length = _per_text(e - s, first)
    distinct, top = _distinct(h, first)
    pair = run_hash(h, 2)
    text = np.repeat(np.arange(n), np.diff(first))
    own = text[1:] == text[:-1]
    pairs, pair_first = pair[own], np.searchsorted(text[1:][own], np.arange(n + 1))
    distinct_pairs, _ = _distinct(pairs, pair_first)
    # lines: a hash of the words between newlines
    begin = np.unique(np.concatenate([off[:-1], np.flatnonzero(buf == 10) + 1]))
    line = np.searchsorted(begin, s, side="right") - 1
    at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(s) else np.zeros(0, np.int64)
    place = (np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))).astype(np.uint64)
    lh = np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), at) if len(at) else np.zeros(0, np.uint64)
    line_first = np.searchsorted(at, first)
    distinct_lines, _ = _distinct(lh, line_first)
    lines = np.diff(line_first).astype(float)
    short = _per_text(((e - s) <= 3).astype(np.int64), first)

    def rate(x, of):
        """Smoothed log odds of x out of ``of``."""
        return np.log((x + 0.5) / (of - x + 0.5 + 1e-9))

    heads = share[0]
    letters = np.maximum(size - sum(share[1:]), 0)
    return np.stack([
        np.log1p(w), np.log1p(length / np.maximum(w, 1)),
        *[np.log((x + 0.5) / (size + 1)) for x in share],
        rate(np.minimum(heads, letters), letters),
        np.log((distinct + 0.5) / (np.power(w, 0.8) + 0.5)), rate(np.minimum(distinct_pairs, np.maximum(w - 1, 0)), np.maximum(w - 1, 0)),
        rate(distinct_lines, lines), np.log((top + 0.5) / (w + 1)), rate(short, w),
        np.log1p(w / np.maximum(lines, 1)),
    ], axis=1)


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of the class covariances (cached, with
    their log determinants) and log priors, for labels 0 and 1."""

    mean: np.ndarray       # 2 x d
    factor: np.ndarray     # 2 x d x d, lower
    log_det: np.ndarray    # 2, half the log determinant of the covariance
    log_prior: np.ndarray  # 2

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-density of label 1 less that of label 0, with priors."""
        out = []
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            out.append(self.log_prior[k] - 0.5 * (z * z).sum(axis=0) - self.log_det[k])
        return out[1] - out[0]


def fit_discriminant(n: np.ndarray, total: np.ndarray, square: np.ndarray, towards_pooled: float,
                     towards_sphere: float) -> Discriminant:
    """From class counts, sums and sums of outer products.  Each covariance is
    mixed with the pooled one, then with the pooled variances."""
    if (n < 2).any():
        raise ValueError(f"both labels need two labelled rows or more; there are {n.tolist()}")
    mean = total / n[:, None]
    cov = square / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (n[:, None, None] * cov).sum(axis=0) / n.sum()
    sphere = np.diag(np.maximum(np.diag(pooled), 1e-6))
    cov = (1 - towards_pooled) * cov + towards_pooled * pooled
    cov = (1 - towards_sphere) * cov + towards_sphere * sphere
    factor = np.linalg.cholesky(cov)
    return Discriminant(mean, factor, np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(axis=1), np.log(n / n.sum()))


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of every row's whole text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            buf, off = text_buffers(b.column(1))
            for lo, hi in chunk_rows(off):
                x = statistics(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)),
                                              pa.array(x.ravel()))], ["id", "x"])

    return src.mapInArrow(tidy(run), T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                                             T.StructField("x", T.ArrayType(T.DoubleType()))]))


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy().reshape(len(col), len(NAMES))


def learn(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, towards_pooled: float = 0.05,
          towards_sphere: float = 0.01) -> Discriminant:
    """The discriminant of all labelled rows (labels other than 0 and 1, null
    ones and ids that don't occur are passed over).  Tasks send sums of d + d*d
    numbers a label; only their total comes to the driver."""
    d = len(NAMES)
    rows = stats.join(labels.where(F.col(label_col).isin(0, 1))
                      .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")), "id").select("x", "y")

    def sums(batches):
        acc = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x, y = _matrix(b.column(0)), b.column(1).to_numpy()
            for k in (0, 1):
                z = x[y == k]
                acc[k, 0] += len(z)
                acc[k, 1:d + 1] += z.sum(axis=0)
                acc[k, d + 1:] += (z.T @ z).ravel()
        k, j = np.nonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(j), pa.array(acc[k, j])], ["y", "j", "v"])

    got = rows.mapInArrow(tidy(sums), "y long, j long, v double").groupBy("y", "j").agg(F.sum("v").alias("v")).toArrow()
    acc = np.zeros((2, 1 + d + d * d))
    acc[got.column(0).to_numpy(), got.column(1).to_numpy()] = got.column(2).to_numpy()
    return fit_discriminant(acc[:, 0], acc[:, 1:d + 1], acc[:, d + 1:].reshape(2, d, d), towards_pooled, towards_sphere)


def score(stats: DataFrame, model: Discriminant, softness: float = 1.0) -> DataFrame:
    """(id, score): the posterior of label 1; ``softness`` divides the log odds."""
    def run(batches):
        for b in batches:
            odds = model.log_odds(_matrix(b.column(1))) / softness if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -700, 700))))],
                                             ["id", "score"])

    return stats.mapInArrow(tidy(run), T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = 0.7, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, score, predicted).

    Learned from the labelled rows whose crc32(id as text) mod ``folds`` is not
    ``held_out_fold``.  Null and empty texts are scored like a text of no words.
    A null id is never held out and never labelled; repeated rows come out (and,
    where labelled, count) once each.  Columns other than the id and the text are
    not looked at.  Without labelled rows of both kinds it raises ValueError,
    unless ``docs`` is empty: then the result is empty."""
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == held_out_fold, F.lit(False))
    stats = cut(document_statistics(docs, id_col, text_col))
    if stats.isEmpty():
        model = Discriminant(np.zeros((2, len(NAMES))), np.stack([np.eye(len(NAMES))] * 2), np.zeros(2), np.zeros(2))
    else:
        model = learn(stats.where(~held), labels, id_col, label_col)
    s = score(stats, model)
    return s.select(F.col("id").alias(id_col), held.alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "quality", threshold: float = 0.7, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """``docs`` without the rows that :func:`classify` predicts as 0: the same
    columns, rows and rules, scored in the scan so that no text is shuffled."""
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == held_out_fold, F.lit(False))
    if docs.isEmpty():
        return docs
    known = labels.where(F.col(label_col).isin(0, 1))
    model = learn(document_statistics(docs, id_col, text_col).where(~held), known, id_col, label_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            buf, off = text_buffers(b.column(at).cast(pa.string()))
            odds = [model.log_odds(statistics(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])) for lo, hi in chunk_rows(off)]
            if odds:
                keep = 1 / (1 + np.exp(-np.clip(np.concatenate(odds), -700, 700))) >= threshold
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)
