"""Session helpers: a local session for tests/bench and the shared checkpoint folder.

Library operators never create sessions; they take DataFrames. Only tests, the bench
and command-line helpers call :func:`local_session`.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "stockroom") -> SparkSession:
    """Local-mode session with the settings the operators assume (UTC, AQE, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared filesystem). Only when it is
    unset (tests, local runs) do we create a scratch folder for it.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="stockroom-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)  # a running session refuses spark.checkpoint.dir; this holds for its context
    return current


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem API (works for shared filesystems and
    object stores, not only local paths)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies here, as in tests that run from a
    checkout; on a cluster it is installed or given by ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: Folders made inside of each ``passing``, innermost last.
_PASSING: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh folder under the shared checkpoint directory, that lasts beyond ``passing`` only if it is to be kept."""
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    if _PASSING and not keep:
        _PASSING[-1].append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made inside are removed at the end: nothing that lives on may read them."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df, name: str = "stage", keep: bool = False):
    """Write an intermediate once as a parquet table under the shared ``spark.checkpoint.dir``
    and read it back: cuts the lineage (survives executor loss) and, unlike an RDD
    ``checkpoint()``, computes the data only once."""
    spark = df.sparkSession
    path = scratch_path(spark, name, keep)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
