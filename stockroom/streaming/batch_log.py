"""A table that micro-batches add to and that is folded together from time to time.

Every batch writes its rows once, under ``log/batch_id=<n>`` (dynamic overwrite, so a replayed batch replaces its own
rows). A fold writes all rows of earlier batches up to number n as ``base/upto=<n>`` and then removes what it has
replaced. Batches before the present one are complete and never replayed, and a base counts only once Spark has marked
it as written, so a fold that is cut off changes nothing and is done again later.

``combine`` is what the table means: distinct ids, sums by key, or plain rows. It is applied to what is read, so readers
need not know which rows have been folded. ``by`` are columns whose values become folders, so that a reader who asks for
a few of them opens no others.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchLog:
    def __init__(self, path: str, schema: str, by: tuple[str, ...] = (), combine: Callable[[DataFrame], DataFrame] = lambda df: df, every: int = 20) -> None:
        self.path, self.schema, self.by, self.combine, self.every = path, schema, by, combine, every
        self.log, self.base = os.path.join(path, "log"), os.path.join(path, "base")

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write the rows of one batch."""
        if self.by:
            rows = rows.repartition(*self.by)  # one file a folder
        rows = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *self.by).parquet(self.log)

    def read(self, spark: SparkSession, before: int | None = None, where: str | None = None) -> DataFrame:
        """All rows, or those of the batches before ``before``; ``where`` is a condition on columns of ``by``."""
        upto, parts = self._newest(spark, before), []
        if upto is not None:
            parts.append(self._open(spark, os.path.join(self.base, f"upto={upto}"), where))
        if self._folders(spark, self.log, "batch_id"):
            later = F.lit(True) if upto is None else F.col("batch_id") > upto
            if before is not None:
                later &= F.col("batch_id") < before
            parts.append(self._open(spark, self.log, where, later))
        rows = parts[0] if parts else spark.createDataFrame([], self.schema)
        return self.combine(rows.unionByName(parts[1]) if len(parts) > 1 else rows)

    def last(self, spark: SparkSession, before: int) -> DataFrame | None:
        """The rows of the newest batch before ``before``, without a look at older ones."""
        batches = [n for n in self._folders(spark, self.log, "batch_id") if n < before]
        return self._open(spark, self.log, None, F.col("batch_id") == max(batches)) if batches else None

    def fold(self, spark: SparkSession, batch_id: int) -> bool:
        """Fold the batches before ``batch_id`` but the newest of them, which ``last`` is asked for, if enough have come
        together. Call it while batch ``batch_id`` is processed."""
        upto = self._newest(spark, batch_id)
        batches = [n for n in self._folders(spark, self.log, "batch_id") if n < batch_id][:-1]
        if sum(upto is None or n > upto for n in batches) < self.every:
            return False
        until = batches[-1]
        rows = self.read(spark, before=until + 1)
        if self.by:
            rows = rows.repartition(*self.by)
        rows.write.mode("overwrite").partitionBy(*self.by).parquet(os.path.join(self.base, f"upto={until}"))
        for n in batches:
            self._remove(spark, os.path.join(self.log, f"batch_id={n}"))
        for n in self._folders(spark, self.base, "upto"):
            if n < until:
                self._remove(spark, os.path.join(self.base, f"upto={n}"))
        return True

    def _open(self, spark: SparkSession, path: str, where: str | None, later=None) -> DataFrame:
        df = spark.read.schema(f"{self.schema}, batch_id bigint" if later is not None else self.schema).parquet(path)
        if later is not None:
            df = df.where(later)
        return (df.where(where) if where else df).select(*spark.createDataFrame([], self.schema).columns)

    def _newest(self, spark: SparkSession, before: int | None) -> int | None:
        done = [n for n in self._folders(spark, self.base, "upto") if (before is None or n < before) and self._fs(spark, self.base)[1](f"{self.base}/upto={n}/_SUCCESS")]
        return max(done, default=None)

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        new = jvm.org.apache.hadoop.fs.Path
        fs = new(path).getFileSystem(conf)
        return fs, lambda p: bool(fs.exists(new(p))), new

    def _folders(self, spark: SparkSession, path: str, key: str) -> list[int]:
        fs, exists, new = self._fs(spark, path)
        if not exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(new(path))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{key}=(\d+)", n)))

    def _remove(self, spark: SparkSession, path: str) -> None:
        fs, _, new = self._fs(spark, path)
        fs.delete(new(path), True)
