"""Tasks by rows: what a task groups does not grow with the table. Messages are judged by one parse."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from provena import shared
from provena.operators import evidence, records


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "IN_TASK", 50)
    keys = lambda a, b: spark.range(a, b).select(F.concat(F.lit("w/"), F.col("id").cast("string")).alias("k"))
    found = evidence.exactness(keys(0, 600).union(keys(0, 9)), keys(100, 700), "k")
    assert found.rdd.getNumPartitions() >= 24
    assert sorted((r.k, r.fault) for r in found.collect()) == sorted([(f"w/{i}", "missing") for i in range(100)] + [(f"w/{i}", "unexpected") for i in range(600, 700)])
    over = records.volatile_overlap(keys(0, 600).withColumnRenamed("k", "path"), keys(300, 900).withColumnRenamed("k", "path"))
    assert over.rdd.getNumPartitions() >= 12 and over.count() == 300


def test_a_known_fault_is_not_judged_again(spark):
    good = {name: "x" for name in records.RESULT_FIELDS}
    rows = [(json.dumps(good), None), (json.dumps({**good, records.RESULT_FIELDS[0]: {"a": "b"}}), "not a text"), (json.dumps({**good, records.RESULT_FIELDS[-1]: None}), "not a text"), (json.dumps({**good, "a`b": 1}), "fields"), ('"x"', "not one object")]
    df = spark.createDataFrame(rows, "m string, want string")
    got = df.withColumn("fault", records.termination(F.col("m"))).select("fault", "want", records.termination_fields(F.col("m"), F.col("fault")).alias("f")).collect()
    assert all(r.fault == r.want and (r.f is None) == (r.fault is not None) for r in got)
