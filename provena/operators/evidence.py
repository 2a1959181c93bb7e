"""Evidence sets and bundles: exactness both ways, references, cross-binding, sealing and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.operators.manifest import diff
from provena.shared import by_keys


def exactness(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, fault) with fault missing or unexpected."""
    sides = expected.select(key, F.lit(True).alias("_expected")).unionByName(present.select(key, F.lit(False).alias("_expected")))
    found = by_keys(sides, expected.count() + present.count(), key).groupBy(key).agg(F.min("_expected").alias("_all"), F.max("_expected").alias("_any"))
    return found.filter(F.col("_all") == F.col("_any")).select(key, F.when(F.col("_all"), "missing").otherwise("unexpected").alias("fault"))


def equal_sets(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def is_subset(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b.select(key).distinct(), key, "left_anti").isEmpty()


def conflicts(outputs: DataFrame, quarantine: DataFrame, key: str = "path") -> DataFrame:
    """Paths that are both present as an output and quarantined."""
    return outputs.select(key).intersect(quarantine.select(key))


def binding(plan: DataFrame, state: DataFrame, log: DataFrame, run: str) -> DataFrame:
    """Per run over plan, state and log: whether all three are there exactly once."""
    parts = [df.groupBy(run).agg(F.count("*").alias(n)) for df, n in ((plan, "n_plan"), (state, "n_state"), (log, "n_log"))]
    out = parts[0].join(parts[1], run, "full_outer").join(parts[2], run, "full_outer").fillna(0, ["n_plan", "n_state", "n_log"])
    return out.withColumn("bound", (F.col("n_plan") == 1) & (F.col("n_state") == 1) & (F.col("n_log") == 1))


def bundle(outputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Sealed rows (role, path, sha256, size); the writer refuses an existing place (see sources.sinks)."""
    row = lambda df, role: df.select(F.lit(role).alias("role"), "path", "sha256", "size")
    return row(outputs, "output").unionByName(row(artifacts, "artifact"))


def verify(sealed: DataFrame, present: DataFrame) -> DataFrame:
    """Totals of a bundle against what is there now: matching, drifted, missing, extra and whether it verifies."""
    d = diff(sealed.withColumn("kind", F.lit("file")), present.withColumn("kind", F.lit("file")))
    out = d.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("match", "drift", "missing", "extra")])
    return out.withColumn("verified", (F.col("n_drift") == 0) & (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def cardinality(owners: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """Per owner how many it owns, and whether it is exactly one."""
    n = owned.groupBy(key).agg(F.count("*").alias("n_owned"))
    return owners.select(key).join(n, key, "left").fillna(0, ["n_owned"]).withColumn("exactly_one", F.col("n_owned") == 1)
