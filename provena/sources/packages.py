"""Packages of files as a sink, ``provena_package``: all files of a table are published at once, or none can be read.

A package is a new folder. Contents lie under their own SHA-256, so a task that runs again, or twice, writes the same. Each task lists its files
in a checksum list, and hands the driver one line about that list, so the driver holds a line a task. When all tasks have ended, it writes
the list of lists, SHA256SUMS, and then the marker, which names the digest of that; without marker there is no package. A failed job removes the folder.

Reading checks marker and list of lists on the driver, the lists and contents in tasks. Folders are made exclusively on local and shared file
systems; on stores without that, a check comes before, and two writers of one place may both go on."""

from __future__ import annotations

import contextlib
import hashlib
import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from provena.errors import BoundaryError, EvidenceError
from provena.shared import importable
from provena.sources.lines import checksum_rows, numbered_lines
from provena.sources.trees import Store, tree

SUMS, MARKER = "SHA256SUMS", "COMMITTED"
FIELDS = ("name", "content")


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


class Folder(Store):
    """A folder that files are written to."""

    def made(self) -> None:
        if self.local:
            try:
                os.mkdir(self.root)
            except FileExistsError as e:
                raise BoundaryError(f"{self.root} exists") from e
            os.mkdir(f"{self.root}/objects")
            os.mkdir(f"{self.root}/sums")
        elif self.fs.get_file_info(self.root).type != pafs.FileType.NotFound:
            raise BoundaryError(f"{self.root} exists")
        else:
            self.fs.create_dir(self.root)

    def put(self, path: str, raw: bytes) -> None:
        """A whole file, there in one step where the file system can rename."""
        where = f"{self.root}/{path}"
        if not self.local:
            self.fs.create_dir(os.path.dirname(where))
            with self.fs.open_output_stream(where) as f:
                f.write(raw)
            return
        with contextlib.suppress(FileExistsError):
            os.mkdir(os.path.dirname(where))  # not those above: a task that goes on behind an abort must not bring the folder back
        beside = f"{where}.{os.getpid()}.{os.urandom(6).hex()}"
        with open(beside, "xb") as f:
            f.write(raw)
        os.replace(beside, where)

    def get(self, path: str) -> bytes | None:
        """A small file, or None if there is none."""
        try:
            with open(f"{self.root}/{path}", "rb") if self.local else self.fs.open_input_stream(f"{self.root}/{path}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def gone(self) -> None:
        """Removes the folder, which first moves to where no task writes."""
        if not self.local:
            self.fs.delete_dir(self.root)
            return
        away = f"{self.root}.{os.urandom(6).hex()}"
        os.rename(self.root, away)
        shutil.rmtree(away)


@dataclass
class Listed(WriterCommitMessage):
    """The checksum list of a task."""

    sha256: str | None


class PackageWriter(DataSourceWriter):
    def __init__(self, root: str, names: list[str]) -> None:
        if sorted(names) != sorted(FIELDS):
            raise BoundaryError(f"a package has the columns {FIELDS}, not {names}")
        self.root = root
        Folder(root).made()

    def write(self, iterator: Iterator[Row]) -> Listed:
        folder, lines = Folder(self.root), []
        for row in iterator:
            name, raw = row["name"], row["content"]
            if name is None or "\n" in name or "\r" in name or name[:1].isspace() or not name or raw is None:
                raise EvidenceError(f"no name or content: {name!r}")
            raw = raw.encode() if isinstance(raw, str) else bytes(raw)
            digest = _sha(raw)
            folder.put(f"objects/{digest[:2]}/{digest}", raw)
            lines.append((name.encode(), digest))
        if not lines:
            return Listed(None)
        body = b"".join(f"{digest}  ".encode() + name + b"\n" for name, digest in sorted(lines))
        folder.put(f"sums/{_sha(body)}", body)
        return Listed(_sha(body))

    def commit(self, messages: list) -> None:
        folder = Folder(self.root)
        body = "".join(f"{m.sha256}  sums/{m.sha256}\n" for m in sorted((m for m in messages if m.sha256), key=lambda m: m.sha256)).encode()
        folder.put(SUMS, body)
        folder.put(MARKER, f"{_sha(body)}\n".encode())

    def abort(self, messages: list) -> None:
        Folder(self.root).gone()


class PackageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provena_package"

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        if overwrite:
            raise BoundaryError("a package is never overwritten")
        return PackageWriter(self.options["path"], [f.name for f in schema.fields])


def publish(files: DataFrame, root: str) -> None:
    """Publishes files (name, content: text or binary) as a package at a place that must not exist; equal lists of two tasks are refused when it is read."""
    spark = files.sparkSession
    importable(spark)
    spark.dataSource.register(PackageSink)
    files.select(*FIELDS).write.format("provena_package").mode("append").save(root)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The files of a package: name, sha256. An error where there is no package, or its lists are not those of the marker."""
    marker, sums = Folder(root).get(MARKER), Folder(root).get(SUMS)
    if marker is None or sums is None:
        raise EvidenceError(f"{root} is no package")
    if marker != f"{_sha(sums)}\n".encode():
        raise EvidenceError(f"{root} is not what its marker names")
    parts = [x.split("  ") for x in sums.decode().splitlines()]
    if not parts:
        return spark.createDataFrame([], "name string, sha256 string")
    want = F.broadcast(spark.createDataFrame([(p[1].split("/")[1], p[0]) for p in parts], "part string, want string"))
    there = spark.read.format("binaryFile").load(f"{root}/sums/*").select(F.element_at(F.split("path", "/"), -1).alias("part"), F.sha2("content", 256).alias("is"))
    wrong = want.join(there, "part", "left").filter(~F.col("want").eqNullSafe(F.col("is"))).limit(1).count()
    if wrong or len(parts) != len({p[0] for p in parts}):
        raise EvidenceError(f"{root} has lists that are missing, changed or there twice")
    rows = checksum_rows(numbered_lines(spark, f"{root}/sums/*")).withColumn("part", F.element_at(F.split("path", "/"), -1))
    return rows.join(want, "part", "left_semi").select(F.col("file").alias("name"), "sha256")


def verified(spark: SparkSession, root: str) -> DataFrame:
    """Per file of a package: name, sha256, size, and status: match, drift or missing, or 'listed twice' for a name of two rows."""
    rows = listed(spark, root)
    # not Spark's own file sources, which pass over empty files
    objects = tree(spark, f"{root}/objects").filter("kind = 'file'").select(F.element_at(F.split("path", "/"), -1).alias("_object"), F.col("sha256").alias("_is"), "size")
    twice = rows.groupBy("name").agg(F.count("*").alias("_n"))
    out = rows.join(twice, "name").join(objects, F.col("sha256") == F.col("_object"), "left")
    status = F.when(F.col("_n") > 1, "listed twice").when(F.col("_is").isNull(), "missing").when(F.col("_is") == F.col("sha256"), "match").otherwise("drift")
    return out.select("name", "sha256", "size", status.alias("status"))
