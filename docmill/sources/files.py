"""Plain files in and out: Markdown, ledgers with damaged rows set aside, and documents as files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPANION = ".rag.md"


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """path, body of whole Markdown files; companions are not sources."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return files.filter(~F.col("path").endswith(COMPANION))


def gather(paths: DataFrame, suffix: str = ".epub") -> tuple[DataFrame, DataFrame]:
    """Paths of a kind in order, each once, and those that are of another."""
    fits = F.lower("path").endswith(suffix)
    return paths.filter(fits).distinct().orderBy("path"), paths.filter(~fits | F.col("path").isNull())


def json_table(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the text of those that don't."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}
    rows = spark.read.text(path).select("value", F.from_json("value", f"{schema}, _damaged string", options).alias("x"))
    damaged = F.col("x._damaged").isNotNull() | F.col("x").isNull()
    return rows.filter(~damaged).select("x.*").drop("_damaged"), rows.filter(damaged).select(F.col("value").alias("text"))


def distinct_names(files: DataFrame, name: str = "name", order: str = "pos") -> DataFrame:
    """Names with " (i)" before the extension for repeats, none of which meets a name given by itself."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    stem, ext = F.regexp_replace(name, r"\.[^.]*\z", ""), F.regexp_extract(name, r"(\.[^.]*)\z", 1)
    given = files.select(F.col(name).alias("own")).distinct()
    tried = files.withColumn("nth", nth).withColumn("made", F.when(F.col("nth") > 0, F.concat(stem, F.lit(" ("), F.col("nth"), F.lit(")"), ext)).otherwise(F.col(name)))
    clash = tried.join(given, tried["made"] == given["own"], "left")
    return clash.withColumn("made", F.when((F.col("nth") > 0) & F.col("own").isNotNull(), F.concat(stem, F.lit(" ("), F.col("nth"), F.lit(" copy)"), ext)).otherwise(F.col("made"))).drop("nth", "own")


def write_documents(documents: DataFrame, path: str, by: str = "source_kind") -> None:
    """Whole documents as Parquet, a folder for each kind; Spark's commit makes them appear at once."""
    documents.write.partitionBy(by).mode("append").parquet(path)


def write_texts(documents: DataFrame, path: str, column: str = "document") -> None:
    """Documents as text files; only good ones should come here."""
    documents.select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_files(documents: DataFrame, folder: str, name: str = "file_name", column: str = "document") -> DataFrame:
    """Each document as a file of its own under its name; returns name and bytes of what was written.

    A file is written under a temporary name and then renamed, so that none is ever seen in part, and a task that runs
    again writes the same. Names must be distinct (:func:`distinct_names`); rows without a name or document are left out.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, path = pafs.FileSystem.from_uri(folder)
        file_system.create_dir(path, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for own, text in zip(names, batch.column(1)):
                data, temporary = text.as_py().encode(), f"{path}/.{uuid.uuid4().hex}.tmp"
                with file_system.open_output_stream(temporary, compression=None) as out:
                    out.write(data)
                file_system.move(temporary, f"{path}/{own}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "n_bytes"])

    rows = documents.filter(F.col(name).isNotNull() & F.col(column).isNotNull()).select(F.col(name).cast("string").alias("name"), F.col(column).alias("text"))
    return rows.mapInArrow(written, "name string, n_bytes long")


def save_version(rows: DataFrame, folder: str) -> str:
    """A table's next version beside those before; readers take the newest, so that a run may read what it replaces."""
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    file_system = top.getFileSystem(conf)
    file_system.mkdirs(top)
    last = max([int(n) for n in _versions(file_system, top)], default=0)
    path = f"{folder}/version={last + 1:09d}"
    rows.write.parquet(path)
    return path


def load_version(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest version, or no rows."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = _versions(top.getFileSystem(spark._jsc.hadoopConfiguration()), top)
    return spark.read.schema(schema).parquet(f"{folder}/version={max(found)}") if found else spark.createDataFrame([], schema)


def _versions(file_system, top) -> list[str]:
    """Numbers of the versions."""
    if not file_system.exists(top):
        return []
    names = [s.getPath().toString() for s in file_system.listStatus(top)]
    return [n.rsplit("=", 1)[1] for n in names if "version=" in n]
