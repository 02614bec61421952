"""Run-metric sink and source (S2, S3) in the published file layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import METRIC_NAMES, METRICS_SCHEMA


def write_run_metrics(metrics: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per run (``run=<n>``), header row.  Runs already in the
    folder stay, a run that is written again replaces itself."""
    cols = [F.col(f"`{c}`") for c in METRIC_NAMES] + [F.col("date"), F.col("run")]
    (metrics.select(*cols).write.mode("overwrite").partitionBy("run")
     .option("partitionOverwriteMode", "dynamic").option("header", True).format(fmt).save(path))


def read_run_metrics(spark: SparkSession, path: str, fmt: str = "csv",
                     with_run: bool = True) -> DataFrame:
    """S3: read every run back into one long table.

    Works for both our partitioned layout and flat files with the published
    header (``Sensitivity,...,date``).  ``run`` comes from the folder name, or
    from the file name (``<n>.csv``) for flat files.
    """
    reader = spark.read.option("header", True)
    if fmt == "csv":
        # columns by header name: a file with others or in another order is
        # refused instead of read into the wrong ones; NA and empty cells are null,
        # other text that is no number fails
        df = (reader.option("enforceSchema", False).option("nullValue", "NA").option("mode", "FAILFAST")
              .schema(METRICS_SCHEMA).csv(path))
    else:
        df = reader.format(fmt).load(path)
    if with_run and "run" not in df.columns:
        df = df.withColumn(
            "run", F.regexp_extract(F.input_file_name(), r"([0-9]+)\.csv$", 1).cast("int"))
    return df
