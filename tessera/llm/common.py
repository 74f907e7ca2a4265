"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is made and set if all tasks run on this machine (a local master); on a
    cluster that would lose data, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by now
        pass


#: Bytes of an Arrow batch that goes to Python and back while tables are written: two tasks' batches are small beside an executor.
BATCH_BYTES = "16m"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind (nothing reads them once the table is there), and goes
    through Python in small batches."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote, when nothing will read it any more."""
    _remove(df.sparkSession, df._tessera_path)


#: Bytes of a scan worth a task of their own.
DEAL_BYTES = 2 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df, its rows dealt out if a plain scan has fewer splits than the cluster has cores (as a table of one row group has), though
    there are ``DEAL_BYTES`` for more of them. Tables beyond some row groups are never shuffled."""
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df  # Spark has dealt it already
    n = min(df.sparkSession.sparkContext.defaultParallelism, plan.optimizedPlan().stats().sizeInBytes() // DEAL_BYTES)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def give_back() -> None:
    """Returns what a worker has freed to the system, at the end of a partition: the worker lives on, beside those of other operators, and
    both Arrow's pool and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_of(col: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def digest(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)
