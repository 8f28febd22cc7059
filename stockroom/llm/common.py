"""Small helpers shared by the operators: batches of bounded size, the word rule, Arrow rows in and out."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: words are runs of characters other than blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = "[\\x20\\x09-\\x0D]+"

#: Rows in an Arrow batch handed to Python: bounds a task's memory when texts are long.
BATCH_ROWS = 256


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches hold at most ``rows`` rows and 8 MB, so a Python worker's memory does not grow with the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies here, as in tests that run from a
    checkout; on a cluster it is installed or given by ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    bounded_batches(df.sparkSession)
    importable(df.sparkSession)
    return df.mapInArrow(fn, schema)


def quoted(column: str) -> str:
    """A column name that may hold dots, as a reference."""
    return "`" + column.replace("`", "``") + "`"


def words_of(text: Column) -> Column:
    """Words of a text as an array (null or blank text: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of each text in a batch (null: empty)."""
    col = batch.column(name).cast(pa.large_binary())
    for v in col:
        yield v.as_py() or b""
