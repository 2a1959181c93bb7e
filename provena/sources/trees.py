"""Trees of files as a data source, ``provena_tree``: each folder, file, link and other entry below a root is a row.

Folders are dealt to tasks: the driver opens folders breadth first until there are enough to share out (a bounded number of
listings) and each task walks what lies below its own, hashing files in pieces. A filter on the start or the value of a path is pushed: what cannot
meet it is neither listed nor hashed. Local trees are listed without following links; others through Arrow's file systems, which know none."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from provena.errors import BoundaryError, EvidenceError
from provena.operators import records
from provena.shared import importable, written

SCHEMA = "path string, kind string, size long, sha256 string, links long"
#: Folders that the driver lists at most before it shares out, bytes read at once, entries of a tree.
SHARED_OUT, PIECE, MOST = 256, 1 << 20, 10_000_000


@dataclass
class Below(InputPartition):
    """Folders to walk, and entries that are known already."""

    folders: list[str]
    entries: list[tuple]


class Store:
    """Lists and reads one tree; paths are relative, '' is the root."""

    def __init__(self, root: str) -> None:
        parsed = urlparse(root)
        self.local = parsed.scheme in ("", "file")
        self.root = (unquote(parsed.path) if parsed.scheme else root).rstrip("/") if self.local else root
        self.fs = None
        if not self.local:
            self.fs, self.root = pafs.FileSystem.from_uri(root)

    def children(self, folder: str) -> Iterator[tuple]:
        """(path, kind, size, links) of what is in a folder, in no order."""
        where = f"{self.root}/{folder}" if folder else self.root
        prefix = f"{folder}/" if folder else ""
        if not self.local:
            kinds = {pafs.FileType.File: "file", pafs.FileType.Directory: "directory"}
            for found in self.fs.get_file_info(pafs.FileSelector(where)):
                kind = kinds.get(found.type, "other")
                yield prefix + found.base_name, kind, found.size if kind == "file" else None, 1
            return
        with os.scandir(where) as entries:
            for e in entries:
                found = e.stat(follow_symlinks=False)
                kind = "link" if stat.S_ISLNK(found.st_mode) else "directory" if stat.S_ISDIR(found.st_mode) else "file" if stat.S_ISREG(found.st_mode) else "other"
                yield prefix + e.name, kind, found.st_size if kind == "file" else None, found.st_nlink if kind == "file" else 1

    def digest(self, path: str, size: int) -> str:
        """The SHA-256 of a file, which must have as many bytes as were listed."""
        where, state, n = f"{self.root}/{path}", hashlib.sha256(), 0
        with open(where, "rb") if self.local else self.fs.open_input_stream(where) as f:
            while piece := f.read(PIECE):
                state.update(piece)
                n += len(piece)
        if n != size:
            raise EvidenceError(f"{path} changed while it was read")
        return state.hexdigest()


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.most = options["path"], int(options.get("most", MOST))
        self.parts, self.hashed = int(options.get("parts", 32)), options.get("digest", "true") == "true"
        self.largest = int(options.get("most_bytes", 1 << 62))
        self.starts: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith)) and f.attribute == ("path",) and isinstance(f.value, str):
                self.starts.append(f.value)
            yield f  # what it is pushed for is a superset: Spark filters again

    def _wanted(self, path: str) -> bool:
        """Whether a path can meet the filters, or lies above some that can."""
        return all(path.startswith(s) or s.startswith(f"{path}/") for s in self.starts)

    def _row(self, store: Store, path: str, kind: str, size: int | None, links: int) -> tuple:
        if kind == "file" and size > self.largest:
            raise BoundaryError(f"{path} has more than {self.largest} bytes")
        return (path, kind, size, store.digest(path, size) if kind == "file" and self.hashed else None, links)

    def partitions(self) -> list[Below]:
        store, entries, folders, listed = Store(self.root), [], [""], 0
        while folders and len(folders) < self.parts and listed < SHARED_OUT:
            found = [x for x in store.children(folders.pop(0)) if self._wanted(x[0])]
            listed += 1
            entries += found
            folders += [x[0] for x in found if x[1] == "directory"]
            if len(entries) > self.most:
                raise BoundaryError(f"{self.root} has more than {self.most} entries")
        n = max(1, min(self.parts, len(folders) + len(entries)))
        return [Below(folders[i::n], entries[i::n]) for i in range(n)]

    def read(self, partition: Below) -> Iterator[tuple]:
        store, n = Store(self.root), 0
        for entry in partition.entries:
            yield self._row(store, *entry)
        stack = list(partition.folders)
        while stack:
            for entry in store.children(stack.pop()):
                if not self._wanted(entry[0]):
                    continue
                n += 1
                if n > self.most:
                    raise BoundaryError(f"{self.root} has more than {self.most} entries")
                if entry[1] == "directory":
                    stack.append(entry[0])
                yield self._row(store, *entry)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provena_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """Entries below a root: path (relative), kind (directory, file, link, other), size, sha256 and links (names of a file) of files.

    Options: most (entries; more is an error, raised while listing), most_bytes (of a file), digest (false: files are not read), parts (tasks)."""
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("provena_tree").options(**{k: str(v).lower() for k, v in options.items()}).load(root)


def observed(spark: SparkSession, root: str, **options) -> DataFrame:
    """A tree that was the same in two scans and holds only folders and files of one name; anything else is an error."""
    first, second = (written(tree(spark, root, **options)) for _ in range(2))
    changed = [r["path"] for r in records.unstable(first, second, ["path"]).limit(5).collect()]
    if changed:
        raise EvidenceError(f"{root} changed between two scans, as at {changed}")
    odd = [r["path"] for r in second.filter("kind NOT IN ('directory', 'file') OR links > 1").limit(5).collect()]
    if odd:
        raise EvidenceError(f"{root} has links or special files, as {odd}")
    if second.limit(int(options.get("most", MOST)) + 1).count() > int(options.get("most", MOST)):
        raise BoundaryError(f"{root} has too many entries")
    return second.drop("links")
