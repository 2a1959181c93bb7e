"""Event logs: prefix-hash chain, contiguity, transition status."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_EVENTS, MAX_EVENT_BYTES, MAX_LOG_BYTES = 100_000, 256 * 1024, 64 << 20


def chain(events: DataFrame, run: str, sequence: str, line: str) -> DataFrame:
    """Per event: run, sequence, previous_sha256, the SHA-256 of all bytes of the run before it.

    The hash of a prefix is sequential in a run, so a run is hashed where its sorted rows stream by: time and traffic are
    linear, and memory is one batch, however long a run is."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.select(run, sequence, line).repartition(F.col(run)).sortWithinPartitions(run, sequence)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, started = None, hashlib.sha256(), False
        for batch in batches:
            out = []
            for r, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not started or r != now:
                    now, state, started = r, hashlib.sha256(), True
                out.append(state.hexdigest())
                state.update((body or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[run, sequence, "previous_sha256"])

    return rows.mapInArrow(hashed, f"`{run}` {kinds[run]}, `{sequence}` {kinds[sequence]}, previous_sha256 string")


def chain_by_window(events: DataFrame, run: str, sequence: str, line: str) -> DataFrame:
    """The same by a window: JVM only, but quadratic in the length of a run; for short runs."""
    w = Window.partitionBy(run).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    return events.select(run, sequence, F.sha2(F.array_join(F.collect_list(F.coalesce(line, F.lit(""))).over(w), ""), 256).alias("previous_sha256"))


def broken_links(events: DataFrame, run: str, sequence: str, line: str, recorded: str) -> DataFrame:
    """Events whose recorded prefix hash is not that of the bytes before them."""
    found = chain(events, run, sequence, line)
    return events.join(found, [run, sequence]).filter(~F.col(recorded).eqNullSafe(F.col("previous_sha256"))).select(run, sequence)


def contiguity(events: DataFrame, run: str, sequence: str, ts: str) -> DataFrame:
    """Per run: events, first and last sequence, gaps, and times that run backwards."""
    w = Window.partitionBy(run).orderBy(sequence)
    marked = events.withColumns({"_gap": F.col(sequence) - F.lag(sequence).over(w), "_back": F.lag(ts).over(w) > F.col(ts)})
    return marked.groupBy(run).agg(F.count("*").alias("n_events"), F.min(sequence).alias("first_seq"), F.max(sequence).alias("last_seq"), F.count_if(F.col("_gap") != 1).alias("n_gaps"), F.count_if("_back").alias("n_backwards"))


def observation(events: DataFrame, run: str, line: str) -> DataFrame:
    """Per run: number of records and bytes, and whether the limits hold."""
    size = F.octet_length(line).cast("long")
    out = events.groupBy(run).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("longest"))
    return out.withColumn("within_limits", (F.col("n") <= MAX_EVENTS) & (F.col("bytes") <= MAX_LOG_BYTES) & (F.col("longest") <= MAX_EVENT_BYTES))


def whole(events: DataFrame, run: str, sequence: str, line: str) -> DataFrame:
    """Per run: records (n), bytes, longest record, the SHA-256 of the whole log in the order of its sequence, and whether the limits hold.

    As for the chain, a log is hashed where its sorted rows stream by; a null line has no bytes, a null run is a run."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.select(run, sequence, line).repartition(F.col(run)).sortWithinPartitions(run, sequence)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, size, longest = None, None, 0, 0, 0

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([now, *[pa.array([x]) for x in (n, size, longest, state.hexdigest())]], names=[run, "n", "bytes", "longest", "sha256"])

        for batch in batches:
            for k, (r, body) in enumerate(zip(batch.column(0), batch.column(2).to_pylist(), strict=True)):
                if state is None or r != now[0]:
                    if state is not None:
                        yield ended()
                    now, state, n, size, longest = batch.column(0).slice(k, 1), hashlib.sha256(), 0, 0, 0
                raw = (body or "").encode()
                state.update(raw)
                n, size, longest = n + 1, size + len(raw), max(longest, len(raw))
        if state is not None:
            yield ended()

    out = rows.mapInArrow(hashed, f"`{run}` {kinds[run]}, n long, bytes long, longest long, sha256 string")
    return out.withColumn("within_limits", (F.col("n") <= MAX_EVENTS) & (F.col("bytes") <= MAX_LOG_BYTES) & (F.col("longest") <= MAX_EVENT_BYTES))


def transition_status(acknowledged: Column, logged: Column, pending: Column, prefix_equal: Column) -> Column:
    """stable, pending_before_log, pending_after_log or diverged, from counts, the pending mark and whether the acknowledged prefix is unchanged."""
    return (
        F.when(~prefix_equal, "diverged").when(~pending & (logged == acknowledged), "stable").when(pending & (logged == acknowledged), "pending_before_log")
        .when(pending & (logged == acknowledged + 1), "pending_after_log").otherwise("diverged")
    )
