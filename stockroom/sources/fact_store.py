"""The fact table ``raw_inventory_v`` as a stored table, in folders by dataset and month.

A load is written once, replaces its own dataset's months and no others, and lies sorted by item within a month. Readers
say which dataset and which days they want; the active dataset is a scalar subquery that prunes other
datasets' folders when the query runs, and a range of days prunes other months when it is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators.scope import Scope, active_dataset, filter_raw

#: Files that a month of a dataset is dealt over when it is written; large loads ask for more.
FILES = 1


def month_of(day) -> F.Column:
    """The month folder of a day (yyyymm as a number), NULL for rows without a day."""
    return (F.year(day) * 100 + F.month(day)).cast("int")


def write_fact(raw: DataFrame, path: str, files: int = FILES) -> None:
    """Store the rows of a load. A month of a dataset comes from ``files`` tasks, so a month that holds a large share
    of the rows is no single task's work."""
    rows = raw.withColumn("month", month_of(F.col("date")))
    part = F.pmod(F.xxhash64("item_id"), F.lit(files))
    rows = rows.repartition("dataset_id", "month", part).sortWithinPartitions("dataset_id", "month", "item_id", "date")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id", "month").parquet(path)


def read_fact(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stored fact; ``schema`` is that of the rows that were written."""
    fields = [f for f in schema.fields if f.name not in ("dataset_id", "month")]
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return spark.read.schema(f"{text}, dataset_id string, month int").parquet(path)


def active_rows(fact: DataFrame, datasets: DataFrame, scope: Scope | None = None) -> DataFrame:
    """A1 + A6 on the stored fact: the active dataset's rows in the scope's days, location and item."""
    scope = scope or Scope()
    rows = fact
    if scope.has_range:
        months = [int(x[:4]) * 100 + int(x[5:7]) for x in (scope.start, scope.end)]
        rows = rows.where(F.col("month").between(*months))
    # a scalar subquery on the folder column is asked first and then prunes the scan
    return filter_raw(rows.where(F.col("dataset_id") == active_dataset(datasets).scalar()), scope, "date").drop("month")
