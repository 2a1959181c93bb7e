"""Sources: suites (TOML), strict JSON documents, event logs (JSONL), trees of files, checksum lists, archives."""

from __future__ import annotations

import hashlib
import io
import json
import re
import tarfile
import tomllib
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.errors import BoundaryError, ConfigurationError, EvidenceError
from provena.functions import canonical, paths
from provena.sources.sinks import get_text

MAX_SUITE, MAX_TASKS, MAX_ARGS, MAX_ARG, MAX_ARG_BYTES, MAX_PATHS = 256 * 1024, 64, 128, 4096, 64 * 1024, 64
TASK = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("argv", T.ArrayType(T.StringType())), T.StructField("inputs", T.ArrayType(T.StringType())), T.StructField("outputs", T.ArrayType(T.StringType()))])
#: Keys that each version of a suite may have besides version, name and task.
SUITE_KEYS = {1: set(), 2: {"context"}, 3: {"context", "workspace"}}


def parse_suite(text: str) -> dict:
    """A validated suite; unknown keys, doubles, paths that are not portable and limits passed are errors."""
    if len(text.encode()) > MAX_SUITE:
        raise ConfigurationError("suite too large")
    suite = tomllib.loads(text)
    version = suite.get("version")
    if type(version) is not int or version not in SUITE_KEYS:
        raise ConfigurationError("unknown version")
    if extra := set(suite) - {"version", "name", "task"} - SUITE_KEYS[version]:
        raise ConfigurationError(f"unknown keys {sorted(extra)}")
    tasks = suite.get("task", [])
    if not isinstance(suite.get("name"), str) or not suite["name"] or not 1 <= len(tasks) <= MAX_TASKS:
        raise ConfigurationError("a suite needs a name and 1 to 64 tasks")
    for task in tasks:
        if extra := set(task) - {"id", "argv", "inputs", "outputs"}:
            raise ConfigurationError(f"unknown task keys {sorted(extra)}")
        argv, sides = task.get("argv", []), [task.get("inputs", []), task.get("outputs", [])]
        if not argv or len(argv) > MAX_ARGS or any(len(x.encode()) > MAX_ARG or "\0" in x for x in argv) or sum(len(x.encode()) for x in argv) > MAX_ARG_BYTES:
            raise ConfigurationError(f"arguments of {task.get('id')!r}")
        for side in sides:
            keys = ["/".join(paths.alias(c) or "" for c in x.split("/")) for x in side]
            if len(side) > MAX_PATHS or len(set(keys)) < len(keys):
                raise ConfigurationError(f"paths of {task.get('id')!r}")
            for x in side:
                check_portable(x)
    if len({t["id"] for t in tasks}) < len(tasks):
        raise ConfigurationError("task ids repeat")
    made = [x for t in tasks for x in t.get("outputs", [])]
    if len(set(made)) < len(made):
        raise ConfigurationError("an output has two producers")
    seen: set[str] = set()
    for task in tasks:
        for x in task.get("inputs", []):
            if x in made and x not in seen:
                raise ConfigurationError(f"{x!r} is read before it is made")
        seen.update(task.get("outputs", []))
    named = sorted({x for t in tasks for side in ("inputs", "outputs") for x in t.get(side, [])})
    for x in named:
        parts = x.split("/")
        if any("/".join(parts[:n]) in set(named) for n in range(1, len(parts))):
            raise ConfigurationError(f"{x!r} lies below a declared file")
    return suite


def check_portable(path: str) -> None:
    parts = path.split("/")
    if not path or len(path.encode()) > paths.MAX_PATH or re.search(r"[\x00\\:]", path) or any(p in ("", ".", "..") or paths.alias(p) is None for p in parts):
        raise BoundaryError(f"{path!r} is not a portable relative path")


def suite_tasks(spark: SparkSession, text: str) -> DataFrame:
    """The tasks of a suite text in order; at most 64 rows."""
    return spark.createDataFrame([(i, t["id"], t["argv"], t.get("inputs", []), t.get("outputs", [])) for i, t in enumerate(parse_suite(text)["task"])], TASK)


def files(spark: SparkSession, root: str, most_bytes: int | None = None) -> DataFrame:
    """Files below a folder: path, size, sha256. A file of over ``most_bytes`` is an error, raised when the rows are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    digest = F.sha2("content", 256)
    if most_bytes is not None:
        digest = F.when(F.col("length") <= most_bytes, digest).otherwise(F.raise_error(F.concat("path", F.lit(f" has more than {most_bytes} bytes"))))
    return rows.select("path", F.col("length").alias("size"), digest.alias("sha256"))


def directories(files: DataFrame, path: str = "path") -> DataFrame:
    """The folders that relative paths of files imply, each once: path."""
    return files.select(F.explode(paths.ancestors(F.col(path))).alias("path")).distinct()


def over_limit(rows: DataFrame, most: int) -> bool:
    """Whether there are more rows than the limit; no more than one beyond it are looked at."""
    return rows.limit(most + 1).count() > most


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths only; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as JSON documents: path, body, and the fault that keeps one from being strict canonical JSON."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    return rows.withColumn("fault", canonical.json_fault(F.col("body")))


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log with a newline at the end of each, and the size of their file; carriage returns stay. See ``torn`` for a last line that has none."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.concat("value", F.lit("\n")).alias("line"), F.col("_metadata.file_size").alias("file_size"))


def torn(lines: DataFrame) -> DataFrame:
    """Logs of ``event_lines`` whose last line has no newline, as a write that was cut off leaves it: with it they would be a byte longer."""
    return lines.groupBy("path").agg(F.sum(F.octet_length("line")).alias("bytes"), F.first("file_size").alias("file_size")).filter("bytes > file_size").select("path")


def checksum_list(text: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a SHA256SUMS text: sha256, path; a line of another form gives nulls."""
    form = r"^([0-9a-f]{64})  (\S.*)$"
    fine = F.col(column).rlike(form)
    return text.select(F.when(fine, F.regexp_extract(column, form, 1)).alias("sha256"), F.when(fine, F.regexp_extract(column, form, 2)).alias("path"), F.col(column).alias("line"))


#: Bytes of a member that are unpacked at most.
MAX_MEMBER = 64 << 20


def archive_members(spark: SparkSession, path: str, most_bytes: int = MAX_MEMBER) -> DataFrame:
    """Members of zip and tar.gz archives: archive, member, size, data. One is in memory at a time; data of over ``most_bytes`` is null."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(raw: bytes) -> Iterator[tuple[str, int, bytes | None]]:
        data = io.BytesIO(raw)
        if zipfile.is_zipfile(data):
            with zipfile.ZipFile(data) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, i.file_size, z.read(i) if i.file_size <= most_bytes else None
        else:
            data.seek(0)
            with tarfile.open(fileobj=data) as t:
                for m in t:
                    if m.isfile():
                        yield m.name, m.size, t.extractfile(m).read() if m.size <= most_bytes else None

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for member, size, data in members(raw.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["archive", "member", "size", "data"])

    return rows.mapInArrow(opened, "archive string, member string, size long, data binary")


ENTRIES = "struct<entries: array<struct<kind: string, path: string, sha256: string, size: bigint>>, kind: string, schema_version: bigint>"


def _bound(spark: SparkSession, path: str, sha256: str, size: int) -> str:
    """The text of a file that must have this identity."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    if len(raw) != size or hashlib.sha256(raw).hexdigest() != sha256:
        raise EvidenceError(f"{path} is not what its descriptor names")
    return raw.decode()


def manifest_document(spark: SparkSession, path: str, sha256: str, size: int) -> DataFrame:
    """The entries of a manifest file, which must have this identity and be in canonical form: kind, path, sha256, size."""
    text = _bound(spark, path, sha256, size)
    if canonical.encode(canonical.strict(text)) != text:
        raise EvidenceError(f"{path} is not canonical JSON")
    rows = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", ENTRIES).alias("m"))
    return rows.select(F.explode("m.entries").alias("e")).select("e.*")


LEDGER = "id string, kind string, subject string, scope string, relationship string, consent_to_list boolean, source_commit string, observed_date string, verified_date string, evidence_url string, status string, retracted_date string, retraction_reason string"


def ledger_document(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A ledger file (JSON with sorted keys, two spaces a level and a newline at the end): what stands beside its records, and the records."""
    text = get_text(spark, path)
    value = canonical.strict(text)
    if json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n" != text:
        raise EvidenceError(f"{path} is not in the form of a ledger")
    names = [x.split()[0] for x in LEDGER.split(", ")]
    rows = [tuple(r.get(n) for n in names) for r in value["records"]]
    return {k: v for k, v in value.items() if k != "records"}, spark.createDataFrame(rows, LEDGER)
