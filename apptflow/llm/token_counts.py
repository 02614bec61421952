"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but token ids of one width, documents one after the
other, each ended by the end-of-document id.  Files are read in blocks by byte
range; a task finds the separators of its block with one vectorised comparison.
A document may start in any earlier block: blocks are stitched by a prefix scan
over their summaries (position of the last separator so far, separators so
far), a window over one small row a block, file by file.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import cut, drop_folder, new_folder, read_range, stream_file, tidy

_ENCODINGS: dict[str, object] = {}     # this worker's encodings, by path

#: The pattern that splits text before the merges of the rank files (the value
#: published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def rank_encoding(path: str, pattern: str = PATTERN):
    """The encoding of a file of byte-level ranks."""
    if path not in _ENCODINGS:
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def write_token_files(docs: DataFrame, folder: str, vocab_path: str, end_id: int, dtype: str = "<u2",
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one flat token file a partition of ``docs`` and return what was
    written: (id, file, doc_no).  Nothing about the documents is kept in the
    files.  A task that runs again replaces its file by the same bytes."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encoding(vocab_path)
        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        n = 0
        with stream_file(folder, name) as out:
            for b in batches:
                for t in b.column(1):
                    out.write(np.array([*enc.encode_ordinary(t.as_py() or ""), end_id], dtype).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([name] * b.num_rows, pa.string()), pa.array(np.arange(n, n + b.num_rows))],
                    ["id", "file", "doc_no"])
                n += b.num_rows

    return src.mapInArrow(tidy(run), T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("file", T.StringType()),
        T.StructField("doc_no", T.LongType())]))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the files of a folder, hidden ones apart."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getLen()) for s in (fs.listStatus(path) if fs.exists(path) else []) if s.isFile()]
    return spark.createDataFrame([x for x in found if x[0][0] not in "._"], "file string, bytes long")


def scan_separators(files: DataFrame, folder: str, end_id: int, dtype: str = "<u2", block_bytes: int = 4 << 20) -> DataFrame:
    """(file, doc_no, start, n_tokens) of every document of the files (file,
    bytes); positions are in tokens.

    Tokens after a file's last separator are one more document; an empty file
    has none.  A file that ends inside a token raises ValueError."""
    width = np.dtype(dtype).itemsize
    step = block_bytes // width * width
    blocks = (files.where("bytes > 0")
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step).cast("long"))))
              .repartition("file", "block"))

    def run(batches):
        for b in batches:
            for f, size, k in zip(*(b.column(i).to_pylist() for i in range(3))):
                data = read_range(folder, f, k * step, min(step, size - k * step))
                if len(data) % width:
                    raise ValueError(f"{f} ends inside a token of {width} bytes")
                tokens = np.frombuffer(data, dtype)
                ends = np.flatnonzero(tokens == end_id) + k * (step // width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f]), pa.array([k]), pa.array([size // width]), pa.array([size <= (k + 1) * step]),
                     pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file", "block", "total", "is_last", "ends"])

    found = blocks.select("file", "bytes", "block").mapInArrow(
        tidy(run), "file string, block long, total long, is_last boolean, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "*", F.coalesce(F.max(F.when(F.size("ends") > 0, F.element_at("ends", -1))).over(before), F.lit(-1).cast("long")).alias("carry"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0).cast("long")).alias("docs_before"))
    # the end of the file ends what follows its last separator
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1)).otherwise(F.col("carry"))
    closed = F.when(F.col("is_last") & (last < F.col("total") - 1), F.concat("ends", F.array("total"))).otherwise(F.col("ends"))
    docs = stitched.withColumn("ends", closed).select(
        "file", "docs_before", "carry", "ends", F.posexplode("ends").alias("j", "end"))
    previous = F.when(F.col("j") == 0, F.col("carry")).otherwise(F.expr("element_at(ends, greatest(j, 1))"))
    return docs.select("file", (F.col("docs_before") + F.col("j")).alias("doc_no"), (previous + 1).alias("start"),
                       (F.col("end") - previous - 1).alias("n_tokens"))


def token_counts(docs: DataFrame, vocab_path: str, end_id: int = 50256, dtype: str = "<u2", id_col: str = "doc_id",
                 text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: (id_col, file, doc_no, start, n_tokens).

    The texts are written as flat token files to the shared folder and counted
    by scanning those; the files are deleted afterwards.  Null and empty texts
    have 0 tokens.  Repeated rows and null ids are rows like others; other
    columns are not read; an empty table gives an empty result."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    try:
        written = cut(write_token_files(docs, folder, vocab_path, end_id, dtype, id_col, text_col))
        counts = scan_separators(list_files(spark, folder), folder, end_id, dtype, block_bytes)
        return cut(written.hint("merge").join(counts, ["file", "doc_no"]).select(F.col("id").alias(id_col), "file", "doc_no", "start", "n_tokens"))
    finally:
        drop_folder(spark, folder)
