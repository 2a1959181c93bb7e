"""Streaming forms: the exact prefix-hash chain of logs and the phases of runs, as keyed state that crosses batches.

Records of a run are numbered from 1 and taken in that order, whatever batch they come in: one that comes early waits in the
state. A record whose number has passed or waits already, or that has no run or number, is returned with a fault and changes nothing.

Runs share a bucket, the key of the state, so the midstates of many are loaded, hashed side by side and stored together. The number of
buckets bounds the parallel tasks and is fixed for the life of a checkpoint. The provider of the state must be RocksDB (``session``)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from provena.functions.prefixes import EMPTY, Prefix, advanced
from provena.shared import importable

BUCKETS, AT_ONCE = 64, 20_000
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> SparkSession:
    """A session beside the given one, in which keyed state can be kept."""
    importable(spark)
    new = spark.newSession()
    for key in ("spark.checkpoint.dir", "spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(key, None)) is not None and new.conf.isModifiable(key):
            new.conf.set(key, value)
    new.conf.set(PROVIDER, ROCKSDB)
    return new


class InOrder(StatefulProcessor):
    """Gives the records of runs to ``went_on`` in the order of their numbers."""

    #: The fields of a run's own state, their values before its first record, and how many fields a result has.
    fields, first, width = "", (), 0

    def __init__(self, run: str, body: str, names: list[str]) -> None:
        self.run_type, self.body_type, self.row = run, body, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", f"run {self.run_type}", f"next long, waiting long, {self.fields}")
        self.early = handle.getMapState("early", f"run {self.run_type}, number long", f"body {self.body_type}")

    def went_on(self, states: list[tuple], bodies: list[list]) -> tuple[list[list[tuple]], list[tuple]]:
        """Per run the results of its new records, and its state after them."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        while some := list(islice(rows, AT_ONCE)):
            yield from self._taken(some)

    def _taken(self, rows: list[Row]) -> Iterator[Row]:
        none, by_run = (None,) * self.width, {}
        for _, run, number, body in rows:
            if run is None or number is None:
                yield self.row(run, number, *none, "no run or number")
            else:
                by_run.setdefault(run, []).append((number, body))
        names, numbers, states, bodies, marks = [], [], [], [], []
        for run, records in by_run.items():
            first, waiting, *state = self.runs.getValue((run,)) or (1, 0, *self.first)
            number, ready = first, []
            for n, body in sorted(records, key=lambda r: r[0]):
                if n < number or (n > number and self.early.containsKey((run, n))):
                    yield self.row(run, n, *none, "number again")
                    continue
                if n > number:
                    self.early.updateValue((run, n), (body,))
                    waiting += 1
                    continue
                ready.append(body)
                number += 1
                while waiting and self.early.containsKey((run, number)):
                    ready.append(self.early.getValue((run, number))[0])
                    self.early.removeKey((run, number))
                    number, waiting = number + 1, waiting - 1
            names.append(run)
            numbers.append(first)
            states.append(tuple(state))
            bodies.append(ready)
            marks.append((number, waiting))
        results, after = self.went_on(states, bodies)
        for run, first, of_run, mark, state in zip(names, numbers, results, marks, after, strict=True):
            self.runs.updateValue((run,), (*mark, *state))
            for k, result in enumerate(of_run):
                yield self.row(run, first + k, *result, None)


class Chain(InOrder):
    fields, first, width = "midstate binary, rest binary, size long", tuple(EMPTY), 3

    def went_on(self, states, bodies):
        digests, after = advanced([Prefix(bytes(m), bytes(r), n) for m, r, n in states], [[(b or "").encode() for b in of_run] for of_run in bodies])
        out = []
        for (_, _, size), of_run, ds in zip(states, bodies, digests, strict=True):
            sizes = [size := size + len((b or "").encode()) for b in of_run]
            out.append(list(zip(ds, ds[1:], sizes, strict=False)))
        return out, [tuple(p) for p in after]


class Phases(InOrder):
    fields, first, width = "blocked boolean, proved boolean", (False, False), 1
    #: The phase after each outcome; all others block.
    NAMES = {"completed": "Verifying", "awaiting_approval": "AwaitingApproval", "verified": "Succeeded"}

    def went_on(self, states, bodies):
        out, after = [], []
        for (blocked, proved), of_run in zip(states, bodies, strict=True):
            phases = []
            for outcome in of_run:
                blocked = blocked or outcome not in self.NAMES or (outcome == "verified" and not proved)
                proved = proved or outcome == "completed"
                phases.append(("Blocked" if blocked else self.NAMES[outcome],))
            out.append(phases)
            after.append((blocked, proved))
        return out, after


def _kept(kind: type[InOrder], rows: DataFrame, run: str, number: str, body: str, result: str, buckets: int) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    bucket: Column = F.pmod(F.xxhash64(F.col(run)), F.lit(buckets)).cast("int")
    keyed = rows.select(bucket.alias("_bucket"), F.col(run).alias("_run"), F.col(number).cast("long").alias("_number"), F.col(body).alias("_body"))
    names = [run, number, *(x.split()[0] for x in result.split(", ")), "fault"]
    return keyed.groupBy("_bucket").transformWithState(kind(types[run], types[body], names), f"`{run}` {types[run]}, `{number}` long, {result}, fault string", "Append", "None")


def chained(events: DataFrame, run: str, number: str, line: str, buckets: int = BUCKETS) -> DataFrame:
    """Per record of a stream: run, number, previous_sha256 and sha256 of the log before and with it, size (bytes with it), fault."""
    return _kept(Chain, events, run, number, line, "previous_sha256 string, sha256 string, size long", buckets)


def phases(results: DataFrame, run: str, number: str, outcome: str, buckets: int = BUCKETS) -> DataFrame:
    """Per result of a stream: run, number, phase, fault. Blocked is for ever; Succeeded needs a completed result before it."""
    return _kept(Phases, results, run, number, outcome, "phase string", buckets)
