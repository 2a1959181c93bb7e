"""Logs that several writers append to at once: numbered commits, made exclusively, over folders of rows.

An append reads the commits there are, writes the rows whose key none of them has to a folder of its own, and then tries to make the next
commit, a small file named by its number that names the folder. Who finds that number taken reads what others have committed meanwhile and tries
again; so no row is lost or there twice, and readers see whole commits only. A key that is there with other fields is an error, not a second row.
What a writer that died leaves is a folder that no commit names.

Commits are made by ``sinks.put_text``, in one step on local file systems and where the store's own create is. Readers list commits on the driver, one
line each; ``compact`` puts a new log in the place of a long one."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.errors import EvidenceError
from provena.sources import sinks

COMMITS, ROWS, TRIES = "_commits", "rows", 50


def commits(spark: SparkSession, root: str) -> list[dict]:
    """The commits of a log in their order: number, folder, rows. Numbers without gap from 1; anything else is an error."""
    fs, where = sinks._fs(spark, f"{root}/{COMMITS}")
    if not fs.exists(where):
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(where) if x.getPath().getName().endswith(".json"))
    if names != [f"{i + 1:020d}.json" for i in range(len(names))]:
        raise EvidenceError(f"{root} has commits that are not numbered from 1 without gap")
    if not names:
        return []
    found = spark.read.text(f"{root}/{COMMITS}/*.json", wholetext=True).select("value").collect()
    return sorted((json.loads(r["value"]) for r in found), key=lambda c: c["number"])


def read(spark: SparkSession, root: str, since: int = 0, known: list[dict] | None = None) -> DataFrame | None:
    """The rows of all commits (or those after a number) with commit, the number that brought them; None for a log without rows."""
    some = [c for c in (commits(spark, root) if known is None else known) if c["number"] > since and c["rows"]]
    if not some:
        return None
    table = spark.createDataFrame([(c["folder"], c["number"]) for c in some], "_folder string, commit long")
    rows = spark.read.parquet(*[f"{root}/{ROWS}/{c['folder']}" for c in some])
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.withColumn("_of", folder).join(F.broadcast(table), F.col("_of") == F.col("_folder")).drop("_of", "_folder")


def _settled(rows: DataFrame, there: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows of keys that are not there; an error where a key is there, or comes twice, with other fields."""
    rest = [c for c in rows.columns if c not in key]
    digest = lambda df: F.xxhash64(F.to_json(F.struct(*[df[c] for c in rest]), {"ignoreNullFields": "false"}))
    marked = rows.withColumn("_digest", digest(rows))
    one = marked.dropDuplicates([*key, "_digest"])
    clash = one.groupBy(*key).count().filter("count > 1").select(*key)
    if there is not None:
        old = there.withColumn("_old", digest(there)).select(*key, "_old")
        clash = clash.unionByName(one.join(old, key).filter("_old != _digest").select(*key))
        one = one.join(old, key, "left_anti")
    if bad := [r.asDict() for r in clash.limit(3).collect()]:
        raise EvidenceError(f"other rows are there under {bad}")
    return one.drop("_digest")


def append(rows: DataFrame, root: str, key: list[str]) -> int:
    """Commits the rows of new keys and returns how many there were; running it again, or beside others, adds none twice. Null keys are refused."""
    spark = rows.sparkSession
    if rows.filter(" OR ".join(f"`{k}` IS NULL" for k in key)).limit(1).count():
        raise EvidenceError(f"a row without {key}")
    seen, fresh, folder = 0, rows, None
    for tries in range(TRIES):
        known = commits(spark, root)
        fresh = _settled(fresh, read(spark, root, seen, known), key)
        seen, last = len(known), folder
        folder = uuid.uuid4().hex
        fresh.write.parquet(f"{root}/{ROWS}/{folder}")
        if last:
            fs, where = sinks._fs(spark, f"{root}/{ROWS}/{last}")
        fresh = spark.read.schema(rows.schema).parquet(f"{root}/{ROWS}/{folder}")
        n = fresh.count()
        if last:
            fs.delete(where, True)  # what was written for the number that was taken
        if not n:
            fs, where = sinks._fs(spark, f"{root}/{ROWS}/{folder}")
            fs.delete(where, True)
            return 0
        fs, where = sinks._fs(spark, f"{root}/{COMMITS}")
        fs.mkdirs(where)
        try:
            sinks.put_text(spark, f"{root}/{COMMITS}/{seen + 1:020d}.json", json.dumps({"number": seen + 1, "folder": folder, "rows": n}))
            return n
        except EvidenceError:
            time.sleep(min(1.0, 0.05 * (tries + 1)))
    raise EvidenceError(f"{root} was taken by others {TRIES} times")


def appending(root: str, key: list[str]):
    """For ``foreachBatch``: each micro-batch is one append, so a batch that runs again adds nothing."""
    return lambda batch, _: append(batch, root, key)


def compact(spark: SparkSession, root: str, to: str) -> int:
    """The rows of a log as one commit of a new one; the old one is left."""
    rows = read(spark, root)
    if rows is None:
        return 0
    folder = uuid.uuid4().hex
    rows.drop("commit").write.parquet(f"{to}/{ROWS}/{folder}")
    n = spark.read.parquet(f"{to}/{ROWS}/{folder}").count()
    fs, where = sinks._fs(spark, f"{to}/{COMMITS}")
    fs.mkdirs(where)
    sinks.put_text(spark, f"{to}/{COMMITS}/{1:020d}.json", json.dumps({"number": 1, "folder": folder, "rows": n}))
    return n
