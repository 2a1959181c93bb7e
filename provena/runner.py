"""A driver-side runner of ordered Spark steps under the evidence protocol.

A step is ``f(spark, inputs) -> outputs``, names to DataFrames. Outputs are written where nothing is, read back, identified
and sealed; a completed prefix whose identities still hold is skipped. Each transition is one event in an append-only list and
a state document whose pending event is written first, so a crash between the two is seen and reconciled. A resume may be
bound to the digest of an inspected decision; a stale digest is refused before anything is written."""

from __future__ import annotations

import hashlib
import inspect as source_of
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from provena.errors import ConfigurationError, EvidenceError, TaskError
from provena.functions.canonical import encode, strict
from provena.sources import sinks

MAX_ATTEMPTS, MAX_RUN_ATTEMPTS = 4, 256


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], dict[str, DataFrame]]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()

    @property
    def identity(self) -> str:
        return hashlib.sha256(source_of.getsource(self.run).encode()).hexdigest()


@dataclass
class Runner:
    spark: SparkSession
    root: str
    steps: list[Step]
    seeds: dict[str, DataFrame] = field(default_factory=dict)
    _log: tuple | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        made: set[str] = set(self.seeds)
        for step in self.steps:
            if missing := set(step.inputs) - made:
                raise ConfigurationError(f"{step.name} reads {sorted(missing)} before any step makes it")
            if doubled := made & set(step.outputs):
                raise ConfigurationError(f"{step.name} makes {sorted(doubled)} anew")
            made |= set(step.outputs)

    # evidence on disk
    def _state(self) -> dict:
        return strict(sinks.get_text(self.spark, f"{self.root}/state.json"))

    def _events(self, n: int) -> list[str]:
        return [sinks.get_text(self.spark, f"{self.root}/events/{i:08d}.json") for i in range(n)]

    def _commit(self, state: dict, kind: str, **details) -> None:
        event = {"type": kind, "sequence": state["count"] + 1, "previous_sha256": state["log_sha256"], "run_id": state["run_id"], "details": details}
        sinks.put_json(self.spark, f"{self.root}/state.json", state | {"pending": event}, replace=True)
        sinks.put_json(self.spark, f"{self.root}/events/{state['count']:08d}.json", event)
        state |= self._acknowledged(state, event)
        sinks.put_json(self.spark, f"{self.root}/state.json", state, replace=True)

    def _acknowledged(self, state: dict, event: dict) -> dict:
        """What the state says after an event; the digest of the log so far is carried along, and read anew only by a new runner."""
        if self._log is None or self._log[0] != state["count"]:
            self._log = state["count"], hashlib.sha256("".join(self._events(state["count"])).encode())
        digest = self._log[1].copy()
        digest.update(encode(event).encode())
        self._log = state["count"] + 1, digest
        return {"count": state["count"] + 1, "log_sha256": digest.hexdigest(), "pending": None}

    # one writer at a time
    @property
    def _lock(self) -> str:
        return f"{self.root}/LOCK"

    @contextmanager
    def _alone(self):
        """Holds the lock of the run; a second writer is refused. A writer that died leaves its lock, see ``break_lock``."""
        token = uuid.uuid4().hex
        try:
            sinks.put_text(self.spark, self._lock, token)
        except Exception as e:
            raise EvidenceError(f"another writer holds {self._lock}") from e
        try:
            yield
        finally:
            if self.inspect_lock() == token:
                sinks.remove(self.spark, self._lock)

    def inspect_lock(self) -> str | None:
        """The token of the writer that holds the run, or None; writes nothing."""
        return sinks.get_text(self.spark, self._lock) if self._exists(self._lock) else None

    def break_lock(self, token: str) -> None:
        """Removes the lock of a writer that is known to be dead; ``token`` must be the one that was inspected."""
        if self.inspect_lock() != token:
            raise EvidenceError("the lock is not the one that was inspected")
        sinks.remove(self.spark, self._lock)

    def _exists(self, path: str) -> bool:
        fs, where = sinks._fs(self.spark, path)
        return fs.exists(where)

    def transition(self) -> str:
        """stable, pending_before_log or pending_after_log; raises if state and events diverge."""
        state = self._state()
        log = "".join(self._events(state["count"]))
        if hashlib.sha256(log.encode()).hexdigest() != state["log_sha256"]:
            raise EvidenceError("events differ from the acknowledged state")
        beyond = self._exists(f"{self.root}/events/{state['count']:08d}.json")
        if state["pending"] is None:
            if beyond:
                raise EvidenceError("an event that no state announced")
            return "stable"
        if not beyond:
            return "pending_before_log"
        if sinks.get_text(self.spark, f"{self.root}/events/{state['count']:08d}.json") != encode(state["pending"]):
            raise EvidenceError("the log diverges from the pending event")
        return "pending_after_log"

    def reconcile(self) -> str:
        status, state = self.transition(), self._state()
        if status == "stable":
            return status
        if status == "pending_before_log":
            sinks.put_json(self.spark, f"{self.root}/events/{state['count']:08d}.json", state["pending"])
        state |= self._acknowledged(state, state["pending"])
        sinks.put_json(self.spark, f"{self.root}/state.json", state, replace=True)
        return status

    # public operations
    def start(self) -> dict:
        with self._alone():
            return self._start()

    def _start(self) -> dict:
        plan = {"steps": [{"name": s.name, "inputs": list(s.inputs), "outputs": list(s.outputs), "code": s.identity} for s in self.steps], "seeds": {k: sinks.table_identity(df) for k, df in sorted(self.seeds.items())}}
        sinks.put_json(self.spark, f"{self.root}/plan.json", plan)
        state = {"run_id": uuid.uuid4().hex, "status": "running", "count": 0, "log_sha256": hashlib.sha256(b"").hexdigest(), "pending": None, "tasks": {s.name: {"status": "pending", "attempts": 0, "outputs": {}} for s in self.steps}}
        sinks.put_json(self.spark, f"{self.root}/state.json", state)
        self._commit(state, "run_started", tasks=len(self.steps))
        return self._go(state)

    def inspect(self) -> dict:
        """The decision that a resume would act on, with its digest; writes nothing."""
        if self.transition() != "stable":
            raise EvidenceError("a pending transition must be reconciled first")
        state = self._state()
        self._verify_prefix(state)
        prefix = [s.name for s in self.steps if state["tasks"][s.name]["status"] == "completed"]
        following = next((s.name for s in self.steps if s.name not in prefix), None)
        if self._exists(f"{self.root}/bundle.json"):
            action = "already-complete"
        elif following is None:
            action = "seal-completed-run"
        else:
            action = "recover-and-resume" if state["tasks"][following]["status"] in ("running", "failed") else "resume"
        decision = {"action": action, "completed_prefix": prefix, "next_task": following, "log_sha256": state["log_sha256"], "outputs": {n: state["tasks"][n]["outputs"] for n in prefix}}
        return decision | {"decision_sha256": hashlib.sha256(encode(decision).encode()).hexdigest()}

    def resume(self, expected_decision_sha256: str | None = None) -> dict:
        """Goes on as a decision says; one that is named must be the present one before the lock is taken and while it is held."""
        if expected_decision_sha256 is not None and self.inspect()["decision_sha256"] != expected_decision_sha256:
            raise EvidenceError("the approved decision is stale")
        with self._alone():
            return self._resume(expected_decision_sha256)

    def _resume(self, expected_decision_sha256: str | None) -> dict:
        if expected_decision_sha256 is None:
            self.reconcile()
        decision = self.inspect()
        if expected_decision_sha256 is not None and decision["decision_sha256"] != expected_decision_sha256:
            raise EvidenceError("the approved decision is stale")
        if decision["action"] == "already-complete":
            return self.verify()
        state = self._state()
        if decision["action"] != "seal-completed-run":
            self._commit(state, "run_resumed", previous_status=state["status"])
            task = state["tasks"][decision["next_task"]]
            if task["status"] in ("running", "failed"):
                moved = self._quarantine(decision["next_task"], task["attempts"])
                task["status"] = "pending"
                self._commit(state, "task_recovery_prepared", attempt=task["attempts"], quarantined_outputs=moved)
        state["status"] = "running"
        return self._go(state)

    def verify(self) -> dict:
        """Everything sealed is still as it was sealed; returns totals."""
        if self.transition() != "stable":
            raise EvidenceError("a pending transition")
        bundle, state = strict(sinks.get_text(self.spark, f"{self.root}/bundle.json")), self._state()
        self._verify_prefix(state)
        if bundle["log_sha256"] != state["log_sha256"] or bundle["outputs"] != {n: t["outputs"] for n, t in state["tasks"].items()}:
            raise EvidenceError("the bundle differs from the state")
        if bundle["plan_sha256"] != hashlib.sha256(sinks.get_text(self.spark, f"{self.root}/plan.json").encode()).hexdigest():
            raise EvidenceError("the plan has changed")
        return {"tasks": len(state["tasks"]), "outputs": sum(len(t["outputs"]) for t in state["tasks"].values()), "attempts": sum(t["attempts"] for t in state["tasks"].values()), "events": state["count"]}

    # steps
    def _path(self, name: str) -> str:
        return f"{self.root}/data/{name}"

    def _table(self, name: str) -> DataFrame:
        return self.seeds[name] if name in self.seeds else self.spark.read.parquet(self._path(name))

    def _verify_prefix(self, state: dict) -> None:
        open_ = False
        for step in self.steps:
            task = state["tasks"][step.name]
            if task["status"] != "completed":
                open_ = True
                continue
            if open_:
                raise EvidenceError(f"{step.name} is completed after an open task")
            for name, sealed in task["outputs"].items():
                if sinks.table_identity(self.spark.read.parquet(self._path(name))) != sealed:
                    raise EvidenceError(f"{name} has drifted")

    def _quarantine(self, task: str, attempt: int) -> int:
        moved = 0
        for name in next(s for s in self.steps if s.name == task).outputs:
            fs, where = sinks._fs(self.spark, self._path(name))
            if fs.exists(where):
                digest = hashlib.sha256(f"{task}\0{attempt}\0{name}".encode()).hexdigest()
                _, to = sinks._fs(self.spark, f"{self.root}/quarantine/a{attempt:08d}.{digest}.artifact")
                fs.mkdirs(to.getParent())
                if not fs.rename(where, to):
                    raise EvidenceError(f"{name} could not be moved")
                moved += 1
        return moved

    def _go(self, state: dict) -> dict:
        for step in self.steps:
            task = state["tasks"][step.name]
            if task["status"] == "completed":
                continue
            if task["attempts"] >= MAX_ATTEMPTS or sum(t["attempts"] for t in state["tasks"].values()) >= MAX_RUN_ATTEMPTS:
                raise EvidenceError(f"{step.name} has no attempt left")
            if any(self._exists(self._path(name)) for name in step.outputs):
                raise EvidenceError(f"an output of {step.name} is already there")
            task |= {"status": "running", "attempts": task["attempts"] + 1}
            before = {name: sinks.table_identity(self._table(name)) for name in step.inputs}
            self._commit(state, "task_started", task=step.name, attempt=task["attempts"])
            try:
                made = step.run(self.spark, {name: self._table(name) for name in step.inputs})
                if set(made) != set(step.outputs):
                    raise TaskError(f"{step.name} made {sorted(made)}")
                sealed = {name: sinks.publish(df, self._path(name)) for name, df in made.items()}
                if before != {name: sinks.table_identity(self._table(name)) for name in step.inputs}:
                    raise TaskError(f"an input of {step.name} drifted")
            except Exception as e:
                task["status"] = state["status"] = "failed"
                self._commit(state, "task_failed", task=step.name, attempt=task["attempts"], reason=type(e).__name__)
                raise TaskError(f"{step.name}: {e}") from e
            task |= {"status": "completed", "outputs": sealed}
            self._commit(state, "task_completed", task=step.name, attempt=task["attempts"], outputs=len(sealed))
        state["status"] = "completed"
        self._commit(state, "run_completed", tasks=len(self.steps))
        plan = sinks.get_text(self.spark, f"{self.root}/plan.json")
        sinks.put_json(self.spark, f"{self.root}/bundle.json", {"run_id": state["run_id"], "plan_sha256": hashlib.sha256(plan.encode()).hexdigest(), "log_sha256": state["log_sha256"], "outputs": {n: t["outputs"] for n, t in state["tasks"].items()}})
        return self.verify()
