"""Replay of workspaces: the state of a tree after each step, by versions of its entries and a Merkle tree of them.

A version of an entry holds from one step to the next change of its path (``lead``). Entries lie in buckets by the first hexadecimal
digits of the SHA-256 of their path, buckets in nodes by one digit less, up to a root, so folders of any size make no large
node. A node's digest covers its members; a step makes new digests only for the nodes above what it changes, each from the member versions
that hold at that step (an interval join within the node). What a run leaves as it was comes from the baseline, whose nodes all runs
share as one row with an array of members each; it is laid over where a digest is made, so work grows with the changes and not with runs times
entries, and only changes shuffle. The number of digits follows from the number of entries of the baseline (``depth``), so buckets stay small.

Edge cases: an entry that is changed to what it was makes no
new root; of several changes of a path at one step the greatest by (sha256, size) holds, and a removal only if there is no other; a removal of
what is not there changes nothing; an empty tree has a root, the digest of nothing; a run with no change has no row; a null run, step or path is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.shared import bounded, written

BEFORE, FOREVER = -1, 2**62
#: Nodes of the baseline that are broadcast at most.
MOST_NODES = 5_000
MEMBER = ("name", "sha256", "size", "n")


def depth(entries: int) -> int:
    """Hexadecimal digits of buckets for so many entries: about one to sixteen entries for sixteen buckets."""
    digits = 1
    while 16**digits < entries:
        digits += 1
    return digits


def _bucketed(entries: DataFrame, digits: int) -> DataFrame:
    return entries.withColumn("node", F.substring(F.sha2("path", 256), 1, digits))


def versions(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes at steps with ``until``, the step of the next change of their key."""
    return changes.withColumn("until", F.coalesce(F.lead("step").over(Window.partitionBy(*keys).orderBy("step")), F.lit(FOREVER)))


def _listed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*MEMBER)).alias("members"))


def _digested(nodes: DataFrame) -> DataFrame:
    """Nodes with sha256, size and n of their members, in the order of names; members without entries are none."""
    held = F.array_sort(F.filter("members", lambda m: m["n"] > 0))
    total = lambda name: F.aggregate("members", F.lit(0).cast("long"), lambda acc, m: acc + m[name])
    lines = F.transform(held, lambda m: F.concat_ws("\x00", m["name"], m["sha256"], m["size"].cast("string")))
    return nodes.withColumns({"sha256": F.sha2(F.array_join(lines, "\n"), 256), "size": total("size"), "n": total("n")}).drop("members")


def _above(own: DataFrame, base: DataFrame) -> DataFrame:
    """Versions of nodes from those of their members: ``own`` (run, node, name, step, until, sha256, size, n), which cover all steps of each
    member that a run changes, and ``base`` (node, members), the nodes as all runs find them."""
    steps = own.select("run", "node", F.col("step").alias("at")).distinct()
    holding = steps.join(own, ["run", "node"]).filter((F.col("step") <= F.col("at")) & (F.col("at") < F.col("until")))
    changed = _listed(holding, "run", "node", "at").withColumnRenamed("members", "changed")
    laid = changed.join(bounded(base.withColumnRenamed("node", "_node"), MOST_NODES), F.col("node") == F.col("_node"), "left")
    rest = F.filter(F.coalesce("members", F.array().cast(base.schema["members"].dataType)), lambda m: ~F.array_contains(F.col("changed.name"), m["name"]))
    return _digested(laid.select("run", "node", F.col("at").alias("step"), F.concat("changed", rest).alias("members")))


def _moved_up(nodes: DataFrame) -> DataFrame:
    """Nodes as members of those above them."""
    return nodes.withColumns({"name": F.right("node", F.lit(1)), "node": F.left("node", F.length("node") - 1)})


def replay(baseline: DataFrame, changes: DataFrame, digits: int | None = None) -> DataFrame:
    """Per run and step at which something may have changed: n_entries, total_bytes and root_sha256 of the tree after it; step -1 is before all.

    ``baseline`` has path (each once), sha256, size; ``changes`` has run, step (from 0), path, sha256, size; a null sha256 removes the path."""
    digits = digits or depth(baseline.count())
    one = F.lit(1).cast("long").alias("n")
    base = written(_listed(_bucketed(baseline.select("path", "sha256", "size"), digits).select("node", F.col("path").alias("name"), "sha256", "size", one), "node"))
    last = changes.filter("run IS NOT NULL AND step IS NOT NULL AND path IS NOT NULL").groupBy("run", "step", "path").agg(F.max(F.struct("sha256", "size")).alias("e"))
    last = last.select("run", F.col("step").cast("long").alias("step"), "path", "e.sha256", F.coalesce(F.when(F.col("e.sha256").isNotNull(), F.col("e.size")), F.lit(0)).cast("long").alias("size"), F.col("e.sha256").isNotNull().cast("long").alias("n"))
    touched = last.select("run", "path").distinct().join(baseline.select("path", "sha256", "size", one), "path", "left")
    first = touched.select("run", F.lit(BEFORE).cast("long").alias("step"), "path", "sha256", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    own = written(versions(_bucketed(last.unionByName(first), digits).withColumnRenamed("path", "name"), ["run", "name"]))
    for _ in range(digits):
        own = written(versions(_moved_up(_above(own, base)), ["run", "node", "name"]))
        base = written(_listed(_moved_up(_digested(base)), "node"))
    roots = _above(own, base)
    return roots.select("run", "step", F.col("n").alias("n_entries"), F.col("size").alias("total_bytes"), F.col("sha256").alias("root_sha256"))


def root(entries: DataFrame, digits: int) -> DataFrame:
    """One row: n_entries, total_bytes and root_sha256 of a tree (path, sha256, size), made in one go."""
    nodes = _bucketed(entries.select("path", "sha256", "size"), digits).select("node", F.col("path").alias("name"), "sha256", "size", F.lit(1).cast("long").alias("n"))
    for _ in range(digits):
        nodes = _moved_up(_digested(_listed(nodes, "node")))
    return _digested(_listed(nodes)).select(F.col("n").alias("n_entries"), F.col("size").alias("total_bytes"), F.col("sha256").alias("root_sha256"))


def underivable(recorded: DataFrame, replayed: DataFrame) -> DataFrame:
    """Recorded states (run, step, root_sha256) that the replay doesn't give: other root, or of a step before the first of the run.

    A step at which nothing changed has the root of the last one before it."""
    spans = versions(replayed.select("run", "step", F.col("root_sha256").alias("_root")), ["run"]).withColumnRenamed("step", "_from")
    held = recorded.join(spans, "run", "left").filter(F.col("_from").isNull() | ((F.col("_from") <= F.col("step")) & (F.col("step") < F.col("until"))))
    found = held.filter(F.col("root_sha256").eqNullSafe(F.col("_root"))).select("run", "step", "root_sha256").distinct()
    same = (recorded["run"].eqNullSafe(F.col("_run"))) & (recorded["step"].eqNullSafe(F.col("_step"))) & recorded["root_sha256"].eqNullSafe(F.col("_sha"))
    return recorded.join(found.toDF("_run", "_step", "_sha"), same, "left_anti")
