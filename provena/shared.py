"""What jobs of this library share: imports of Python workers, tables and files in the shared folder, streams over tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Lets Python workers started from now on import this package from where the driver has it; executors on other machines need it installed, or on their PYTHONPATH."""
    environment, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, here])


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed with the session; where that is unset (local masters), below a temporary one set here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='provena-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/provena-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: cuts lineage and survives a lost executor."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most_rows: int) -> DataFrame:
    """A written() table with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: Rows of a task that groups or sorts them: AQE goes by compressed bytes, of which keys have few.
IN_TASK = 2_000_000


def by_keys(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by keys into as many tasks as so many rows take, IN_TASK each; groups and joins by these keys then stay in their task."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // IN_TASK + 1), *keys)


def text_files(lines: DataFrame, keys: list[str], order: str, line: str) -> str:
    """Lines in ``order`` as one text file for each value of the keys, in folders ``key=value`` of the shared folder, whose path is returned."""
    path = f"{folder(lines.sparkSession)}/files"
    rows = lines.select(*keys, order, line).repartition(*keys).sortWithinPartitions(*keys, order)
    rows.select(*keys, line).write.partitionBy(*keys).option("lineSep", "\n").text(path)
    return path


def streamed(rows: DataFrame, order: str, step: Callable[[DataFrame], DataFrame], batches: int = 4) -> DataFrame:
    """What a streaming step makes of a table that comes in ranges of ``order``, in so many batches, each range at any time.

    The stream runs to its end; its results are a table in the shared folder."""
    spark, root = rows.sparkSession, folder(rows.sparkSession)
    parts = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(parts, order).write.parquet(f"{root}/rows")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-parts // batches)).parquet(f"{root}/rows")
    out = step(source)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")
