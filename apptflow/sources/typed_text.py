"""Text files with missing markers, and types guessed from all of their values.

A column's type is the least of a lattice that holds all its values: logical,
integer below double, date below date-time, and text above all.  Missing values
(empty or ``NA``) are the bottom: they fit every type, and a column of nothing else
is logical.  Whether all values of a column fit a type is one aggregate, so one
pass folds all columns and tasks' results merge; the last row counts as much as the
first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the reference's reader takes as missing and as logical.
MISSING = ["", "NA"]
LOGICAL = ["T", "F", "TRUE", "FALSE", "true", "false"]

INTEGER = r"^[+-]?(0|[1-9][0-9]{0,17})$"          # leading zeros are kept, as text
DOUBLE = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?Z?)?$"

#: Types from the least on, with their SQL names.
TYPES = {"logical": "boolean", "integer": "bigint", "double": "double", "date": "date", "date-time": "timestamp", "text": "string"}


def read_text(spark: SparkSession, path: str, head: list[str] | None = None) -> DataFrame:
    """All columns of a file or folder with a header, as text.  Files whose header
    differs from the first one's are refused."""
    if head is None:
        head = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("mode", "FAILFAST").csv(path))


def present(column: str) -> Column:
    """The value without white space around it; null if missing."""
    x = F.trim(F.col(f"`{column}`"))
    return F.when(~x.isin(MISSING), x)


def parsed(column: str, kind: T.DataType) -> Column:
    """The value as ``kind``; one that doesn't fit fails the query."""
    x = present(column)
    if isinstance(kind, T.StringType):
        return x
    v = x.try_cast(kind)
    why = F.concat(F.lit(f"column {column} holds a value that is no {kind.simpleString()}: "), x)
    return F.when(x.isNull() | v.isNotNull(), v).otherwise(F.raise_error(why).cast(kind))


def _fits(x: Column) -> dict[str, Column]:
    """Whether a value fits each type; null if it is missing."""
    def casts(pattern, kind):
        return F.when(x.isNotNull(), F.when(x.rlike(pattern), x.try_cast(kind)).isNotNull())
    return {"logical": x.isin(LOGICAL), "integer": x.rlike(INTEGER), "double": x.rlike(DOUBLE),
            "date": casts(DATE, "date"), "date-time": casts(DATE_TIME, "timestamp")}


def inferred_types(text: DataFrame) -> DataFrame:
    """(column, type): the least type of each column's values, from one aggregate
    over all rows."""
    aggs = [F.coalesce(F.bool_and(fit), F.lit(True)).alias(f"{i}|{t}")
            for i, c in enumerate(text.columns) for t, fit in _fits(present(c)).items()]
    one = text.agg(*aggs)
    rows = []
    for i, c in enumerate(text.columns):
        least = F.lit("text")
        for t in reversed([t for t in TYPES if t != "text"]):
            least = F.when(F.col(f"`{i}|{t}`"), t).otherwise(least)
        rows.append(F.struct(F.lit(c).alias("column"), least.alias("type")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder with its columns as the types that all their values fit."""
    text = read_text(spark, path)
    kinds = {r["column"]: r["type"] for r in inferred_types(text).collect()}       # a row a column
    as_logical = lambda x: F.when(x.isin("T", "TRUE", "true"), True).when(x.isNotNull(), False)
    return text.select(*[(as_logical(present(c)) if kinds[c] == "logical" else present(c).cast(TYPES[kinds[c]])).alias(c)
                         for c in text.columns])
