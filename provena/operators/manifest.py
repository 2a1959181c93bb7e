"""Manifests: identities of entries, tree summary, closed-world diff, projected state, shape rules.

A manifest has columns path, kind ('file' or 'directory'), sha256 and size (null for directories)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import identity as I
from provena.functions import paths as P

MAX_ENTRIES, MAX_FILE, MAX_TOTAL = 10_000, 1 << 30, 4 << 30


def from_contents(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """A manifest of files with these contents; a null content is an empty file."""
    body = F.coalesce(content, F.lit(""))
    return df.select(path.alias("path"), F.lit("file").alias("kind"), I.sha256(body).alias("sha256"), I.size_of(body).alias("size"))


def entry_json() -> Column:
    """One entry as canonical JSON; directories have no identity fields."""
    return F.to_json(F.struct("kind", "path", "sha256", "size"))


def tree_summary(entries: DataFrame, *by: str, most: int | None = None) -> DataFrame:
    """Per group: entries, directories, files, total bytes, and the digest of all entries in path order.

    The digest is sequential in a group, so a group is hashed where its sorted rows stream by: time and traffic are linear,
    and memory is one batch, however large a group is. With ``most``, larger groups are counted only; ``within_limits`` tells
    of a passed limit without that."""
    total = entries.groupBy(*by).agg(F.count("*").alias("n_entries"), F.count_if(F.col("kind") == "directory").alias("n_directories"), F.count_if(F.col("kind") == "file").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))
    found = _tree_digests(entries, by).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "tree_sha256")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    digest = F.col("tree_sha256") if most is None else F.when(F.col("n_entries") <= most, F.col("tree_sha256"))
    return total.join(found, same, "left").select(*total.columns, digest.alias("tree_sha256"))


def within_limits(summary: DataFrame, most: int = MAX_ENTRIES, most_bytes: int = MAX_TOTAL) -> DataFrame:
    """A tree summary with whether each group keeps to the limits of entries and bytes."""
    return summary.withColumn("within_limits", (F.col("n_entries") <= most) & (F.col("total_bytes") <= most_bytes))


def _tree_digests(entries: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per group: tree_sha256."""
    rows = entries.select(*by, "path", entry_json().alias("_entry"))
    # one place per group, whose rows come in the byte order of paths; equal paths by their entries
    rows = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, "path", "_entry").drop("path")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, row = None, None, []

        def ended() -> pa.RecordBatch:
            state.update(b'],"kind":"tree","schema_version":1}\n')
            return pa.RecordBatch.from_arrays([*row, pa.array([state.hexdigest()], pa.string())], names=[*by, "tree_sha256"])

        for batch in batches:
            groups = zip(*[batch.column(i).to_pylist() for i in range(len(by))], strict=True) if by else [()] * batch.num_rows
            for k, (group, body) in enumerate(zip(groups, batch.column(len(by)).to_pylist(), strict=True)):
                if state is None or group != now:
                    if state is not None:
                        yield ended()
                    now, state, row = group, hashlib.sha256(b'{"entries":['), [batch.column(i).slice(k, 1) for i in range(len(by))]
                else:
                    state.update(b",")
                state.update(body.encode())
        if state is not None:
            yield ended()

    return rows.mapInArrow(hashed, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "tree_sha256 string"]))


def diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Closed world: every path of either side with status missing, extra, drift or match."""
    e = expected.select("path", F.col("kind").alias("e_kind"), F.col("sha256").alias("e_sha"), F.col("size").alias("e_size"), F.lit(True).alias("_e"))
    a = actual.select("path", F.col("kind").alias("a_kind"), F.col("sha256").alias("a_sha"), F.col("size").alias("a_size"), F.lit(True).alias("_a"))
    same = F.col("e_kind").eqNullSafe(F.col("a_kind")) & F.col("e_sha").eqNullSafe(F.col("a_sha")) & F.col("e_size").eqNullSafe(F.col("a_size"))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(same, "match").otherwise("drift")
    return e.join(a, "path", "full_outer").select("path", status.alias("status"))


def projected(baseline: DataFrame, outputs: DataFrame) -> DataFrame:
    """Baseline and sealed outputs together; ``collides`` marks a path that is in both or sealed twice."""
    both = baseline.select("path", "kind", "sha256", "size").unionByName(outputs.select("path", "kind", "sha256", "size"))
    n = both.groupBy("path").agg(F.count("*").alias("n"), F.min(F.struct("kind", "sha256", "size")).alias("e"))
    return n.select("path", "e.kind", "e.sha256", "e.size", (F.col("n") > 1).alias("collides"))


def violations(entries: DataFrame) -> DataFrame:
    """(path, rule) for every broken rule of a manifest: portable paths, identities, explicit parents, no file above another entry, no doubles."""
    dirs = entries.filter("kind = 'directory'").select(F.col("path").alias("up"))
    files = entries.filter("kind = 'file'").select(F.col("path").alias("up"))
    above = entries.select("path", F.explode(P.ancestors(F.col("path"))).alias("up"))
    rules = [
        entries.filter(~P.portable(F.col("path"))).select("path", F.lit("path not portable").alias("rule")),
        entries.filter(P.depth(F.col("path")) > P.MAX_DEPTH).select("path", F.lit("too deep").alias("rule")),
        entries.filter((F.col("kind") == "file") & ~I.valid_identity(F.col("sha256"), F.col("size"))).select("path", F.lit("bad identity").alias("rule")),
        entries.filter((F.col("kind") == "directory") & (F.col("sha256").isNotNull() | F.col("size").isNotNull())).select("path", F.lit("directory with identity").alias("rule")),
        entries.filter(F.col("size") > MAX_FILE).select("path", F.lit("file too large").alias("rule")),
        entries.groupBy("path").count().filter("count > 1").select("path", F.lit("listed twice").alias("rule")),
        above.join(dirs, "up", "left_anti").select("path", F.lit("parent not listed").alias("rule")).distinct(),
        above.join(files, "up", "left_semi").select("path", F.lit("below a file").alias("rule")).distinct(),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


def out_of_order(entries: DataFrame, group: str, order: str, path: str = "path") -> DataFrame:
    """Entries that do not come strictly after the one before in byte order."""
    w = Window.partitionBy(group).orderBy(order)
    return entries.withColumn("_before", F.lag(path).over(w)).filter(F.col("_before") >= F.col(path)).drop("_before")


def history(baseline: DataFrame, sealed: DataFrame) -> DataFrame:
    """Replay: after each sealing step (run, step) the cumulative number and bytes of outputs, baseline included."""
    base = baseline.agg(F.count("*").alias("_n"), F.coalesce(F.sum("size"), F.lit(0)).alias("_size"))  # one row
    per = sealed.groupBy("run", "step").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    after = per.select("run", "step", F.sum("n").over(w).alias("n"), F.sum("size").over(w).alias("size")).join(F.broadcast(base))
    return after.select("run", "step", (F.col("_n") + F.col("n")).alias("n_after"), (F.col("_size") + F.col("size")).cast("long").alias("bytes_after"))
