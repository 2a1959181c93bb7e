"""What the operators of this folder share: reading tables, scratch tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


BATCH_BYTES, MOST_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; others, whatever their names, are left in the file. Texts in fewer splits than there are cores are dealt out."""
    importable(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "pages") and rows.rdd.getNumPartitions() < cores else rows


def importable(spark: SparkSession) -> None:
    """Lets Python workers started from now on import this package from where the driver has it; executors on other machines need it installed, or on their PYTHONPATH."""
    environment, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, here])
    # texts are long: batches for Python workers are held in the JVM and in the worker at once
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES, "1b"))
    if size > MOST_BATCH:
        spark.conf.set(BATCH_BYTES, str(MOST_BATCH))


def released(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which the worker gives back what it has freed: it stays beside the executor and waits for its next task."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset (tests), below a temporary one set here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='provena-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/provena-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    again = spark.read.schema(df.schema).parquet(path)
    again.provena_path = path
    return again


def scratch(spark: SparkSession) -> str:
    """A new folder for files of tasks, below the shared one, removed with the session."""
    path = shared_folder(spark)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def dropped(df: DataFrame) -> None:
    """Deletes a written() table that nothing reads any more."""
    spark, path = df.sparkSession, df.provena_path
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """A written() table with a broadcast hint if it is known to have at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Pure ASCII takes the fast path, on which lower() is the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let_go(spark: SparkSession) -> None:
    """Lets the cleaner remove shuffle files of finished jobs now, not when the driver next happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kept_after(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet a condition on computed columns, filtered where these are computed.

    A plain filter is pushed below the steps that make such a column and takes their expressions along; inside a lambda
    these would be computed anew for each element. The row number, which differs from run to run, holds it back."""
    return df.withColumn("_number", F.monotonically_increasing_id()).filter(condition & (F.col("_number") >= 0)).drop("_number")
