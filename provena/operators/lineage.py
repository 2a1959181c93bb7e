"""Lineage of a task list: seeds, producers, expected inputs, conflicts. All equi-joins; order is a residual or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import paths as P


def first_producers(outputs: DataFrame) -> DataFrame:
    """(path, producer): the earliest task that declares the path as an output."""
    return outputs.groupBy("path").agg(F.min("task").alias("producer"))


def seeds(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Paths read before or by the task that first makes them, with the first reader; each once."""
    joined = inputs.groupBy("path").agg(F.min("task").alias("reader")).join(first_producers(outputs), "path", "left")
    return joined.filter(F.col("producer").isNull() | (F.col("producer") >= F.col("reader"))).select("path", "reader")


def double_producers(outputs: DataFrame) -> DataFrame:
    """Paths that more than one task declares, with their number."""
    return outputs.groupBy("path").agg(F.countDistinct("task").alias("n")).filter("n > 1")


def overwritten_seeds(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Seeds that some task, that reader or a later one, declares as an output."""
    return seeds(inputs, outputs).join(first_producers(outputs), "path").select("path", "reader", "producer")


def expected_inputs(inputs: DataFrame, outputs: DataFrame, seed: DataFrame, sealed: DataFrame) -> DataFrame:
    """Per (task, path) the identity to expect: the seed's, else what the producer sealed; ``origin`` says which, or that there is none.

    seed: path, sha256, size. sealed: task, path, sha256, size of completed tasks."""
    s = seed.select("path", F.col("sha256").alias("s_sha"), F.col("size").alias("s_size"))
    made = sealed.select(F.col("task").alias("producer"), "path", F.col("sha256").alias("m_sha"), F.col("size").alias("m_size"))
    rows = inputs.join(s, "path", "left").join(first_producers(outputs), "path", "left").join(made, ["producer", "path"], "left")
    earlier = F.col("producer") < F.col("task")
    origin = F.when(F.col("s_sha").isNotNull(), "seed").when(F.col("producer").isNull(), "no producer").when(~earlier, "produced later").when(F.col("m_sha").isNull(), "producer not completed").otherwise("output")
    return rows.select("task", "path", origin.alias("origin"), F.coalesce("s_sha", F.when(earlier, F.col("m_sha"))).alias("sha256"), F.coalesce("s_size", F.when(earlier, F.col("m_size"))).alias("size"))


def ancestor_conflicts(paths: DataFrame) -> DataFrame:
    """(path, ancestor): declared paths below a path that is declared too. Ancestors are exploded, so the join is an equi-join."""
    declared = paths.select("path").distinct()
    return declared.select("path", F.explode(P.ancestors(F.col("path"))).alias("ancestor")).join(declared.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").select("path", "ancestor")


def alias_collisions(paths: DataFrame, key) -> DataFrame:
    """Alias keys that several spellings share."""
    return paths.select("path", key.alias("alias")).distinct().groupBy("alias").agg(F.count("*").alias("n_spellings"), F.min("path").alias("first_spelling")).filter("n_spellings > 1")
