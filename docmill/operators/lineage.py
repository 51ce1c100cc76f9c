"""Cut a plan where its result is used again and again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local one of our own if all runs in one process, as in tests; else an error."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docmill-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/docmill/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    file_system.mkdirs(hadoop_path)
    file_system.deleteOnExit(hadoop_path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_path(df.sparkSession, "cut")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
