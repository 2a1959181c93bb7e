"""Logs with several writers: nothing lost, nothing twice, whole commits only."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from provena.errors import EvidenceError
from provena.sources import commits

S = "run string, sequence int, line string"


def rows(spark, *at):
    return spark.createDataFrame([("r", i, f"line {i}") for i in at], S)


def test_two_writers_at_once(spark, tmp_path):
    root = f"{tmp_path}/log"

    def write(k):
        return sum(commits.append(rows(spark, *range(10 * j, 10 * j + 15)), root, ["run", "sequence"]) for j in range(k, k + 3))

    with ThreadPoolExecutor(3) as pool:
        added = list(pool.map(write, (0, 1, 2)))
    got = commits.read(spark, root).collect()
    assert sorted(r.sequence for r in got) == list(range(55)) and sum(added) == 55
    known = commits.commits(spark, root)
    assert [c["number"] for c in known] == list(range(1, len(known) + 1)) and sum(c["rows"] for c in known) == 55
    assert sorted(os.listdir(f"{root}/rows")) == sorted(c["folder"] for c in known)
    assert commits.append(rows(spark, *range(55)), root, ["run", "sequence"]) == 0 and len(commits.commits(spark, root)) == len(known)
    assert commits.compact(spark, root, f"{tmp_path}/new") == 55 and commits.read(spark, f"{tmp_path}/new").count() == 55


def test_other_rows_under_a_key_are_refused(spark, tmp_path):
    root, key = f"{tmp_path}/log", ["run", "sequence"]
    assert commits.read(spark, root) is None and commits.append(rows(spark), root, key) == 0
    assert commits.append(rows(spark, 1, 1, 2), root, key) == 2
    with pytest.raises(EvidenceError, match="other rows"):
        commits.append(spark.createDataFrame([("r", 2, "other"), ("r", 3, "x")], S), root, key)
    with pytest.raises(EvidenceError, match="other rows"):
        commits.append(spark.createDataFrame([("r", 4, "x"), ("r", 4, None)], S), root, key)
    with pytest.raises(EvidenceError, match="without"):
        commits.append(spark.createDataFrame([("r", None, "x")], S), root, key)
    assert sorted((r.sequence, r.commit) for r in commits.read(spark, root).collect()) == [(1, 1), (2, 1)]
    os.rename(f"{root}/_commits/{1:020d}.json", f"{root}/_commits/{2:020d}.json")
    with pytest.raises(EvidenceError, match="numbered"):
        commits.read(spark, root)


def test_batches_of_a_stream_that_run_again(spark, tmp_path):
    root, key = f"{tmp_path}/log", ["run", "sequence"]
    rows(spark, *range(20)).repartition(4).write.parquet(f"{tmp_path}/in")
    for state in ("a", "b"):  # a second checkpoint plays all batches again
        stream = spark.readStream.schema(S).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(commits.appending(root, key)).option("checkpointLocation", f"{tmp_path}/{state}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.sequence for r in commits.read(spark, root).collect()) == list(range(20))
