"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local one of our own if all runs in one process, as in tests; else an error."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docmill-shared-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 16 MB at most, from here on: what a Python worker holds at once follows their size."""
    given = spark.conf.get(BATCH_CONF, None)
    digits = (given or "").rstrip("bB")
    if not digits.isdigit() or int(digits) > BATCH_BYTES or int(digits) <= 0:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system, where the C library can; a worker that lives on keeps it otherwise."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that gives memory back after each."""

    def each(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            release()

    return each


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/docmill/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    file_system.mkdirs(hadoop_path)
    file_system.deleteOnExit(hadoop_path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs the tasks it ran, not the plan behind them.
    """
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*saved: DataFrame) -> None:
    """Delete tables that :func:`save` has written, once nothing reads them any more."""
    for df in saved:
        if path := getattr(df, "_saved_at", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
