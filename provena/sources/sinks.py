"""Sinks: exclusive publication with read-back, replacement by pointer, append-only logs, quarantine, bounded messages."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from provena.errors import EvidenceError
from provena.functions import canonical

MAX_MESSAGE = 1024
RESULT_FIELDS = ("protocol", "action", "outcome", "agent_run_uid", "execution_spec_sha256", "run_id", "resume_decision_sha256", "bundle_sha256", "error_code")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _sums(df: DataFrame) -> list:
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    total = lambda *seed: F.sum(F.xxhash64(*seed, row).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("n"), total().alias("a"), total(F.lit(1)).alias("b")]


def _identity(found: dict) -> dict:
    return {"n": found["n"], "a": str(found["a"] or 0), "b": str(found["b"] or 0)}


def table_identity(df: DataFrame) -> dict:
    """Order-free identity of a table's rows: their number and the sum of their 64-bit hashes, in two seeds."""
    return _identity(df.agg(*_sums(df)).first().asDict())


def publish(df: DataFrame, path: str) -> dict:
    """Writes to a place that must not exist, and returns the identity of what can be read there, which must be that of the rows as they were written."""
    seen = Observation()
    df.observe(seen, *_sums(df)).write.mode("errorifexists").parquet(path)
    there = table_identity(df.sparkSession.read.parquet(path))
    if there != _identity(seen.get):
        raise EvidenceError(f"{path} does not hold what was written to it")
    return there


def replace(df: DataFrame, root: str) -> str:
    """A new version beside the old ones; the pointer is written last, so readers see one or the other."""
    spark = df.sparkSession
    version = f"{root}/v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(version)
    put_text(spark, f"{root}/CURRENT", version, replace=True)
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(get_text(spark, f"{root}/CURRENT"))


def put_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A text file at a place that must not exist; with ``replace`` one rename puts it in the place of the old one, so there is always one of them."""
    fs, where = _fs(spark, path)
    # on a local file system a check and a creation are two steps; a second name for a whole file is given in one
    linked = not replace and fs.getScheme() == "file"
    if not replace and fs.exists(where):
        raise EvidenceError(f"{path} exists")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    to = hadoop.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}") if replace or linked else where
    out = fs.create(to, False)
    out.write(bytearray(text.encode()))
    out.close()
    if replace:
        kind = getattr(hadoop, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(to, where, how)
    elif linked:
        jvm, name = spark.sparkContext._jvm, lambda x: x.toUri().getPath()
        try:
            jvm.java.nio.file.Files.createLink(jvm.java.io.File(name(where)).toPath(), jvm.java.io.File(name(to)).toPath())
        except Py4JJavaError as e:
            raise EvidenceError(f"{path} exists") from e
        finally:
            fs.delete(to, False)


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def put_json(spark: SparkSession, path: str, value, replace: bool = False) -> None:
    """Canonical JSON; refuses what the strict reader would not read."""
    text = canonical.encode(value)
    canonical.strict(text)
    put_text(spark, path, text, replace)


def append(df: DataFrame, path: str, key: list[str]) -> int:
    """Adds the rows whose key is not there yet, one for each key; running it again adds nothing. Returns how many were added."""
    spark = df.sparkSession
    fs, where = _fs(spark, path)
    df = df.dropDuplicates(key)
    fresh = df.join(spark.read.parquet(path).select(*key), key, "left_anti") if fs.exists(where) else df
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def quarantine(live: DataFrame, bad: DataFrame, key: list[str], path: str) -> DataFrame:
    """Moves the bad rows to the quarantine table (idempotent by key); returns the rows that stay."""
    append(live.join(bad.select(*key), key, "left_semi"), path, key)
    return live.join(bad.select(*key), key, "left_anti")


def remove(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.delete(where, False)


def message(result: dict) -> str:
    """A step result of nine strings as one JSON text of at most 1024 bytes."""
    if set(result) != set(RESULT_FIELDS) or not all(isinstance(x, str) for x in result.values()):
        raise EvidenceError("a step result has nine string fields")
    text = json.dumps({k: result[k] for k in RESULT_FIELDS}, ensure_ascii=False, separators=(",", ":"))
    if len(text.encode()) > MAX_MESSAGE:
        raise EvidenceError("message too long")
    return text
