"""Control plane as data: specification rules, result matrix, phases, write-once fields, lease steps."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Forms of digests and ids.
HEX64 = r"^[0-9a-f]{64}$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
RUN_ID = r"^[0-9a-f]{32}$"
#: Fixed values of the protocol: error codes of a blocked result, and bounds of a deadline in seconds.
ERROR_CODES = ("invalid_request", "execution_failed", "evidence_invalid", "internal_error")
LEAST_DEADLINE, MOST_DEADLINE = 30, 1800


def spec_fault(pvc: Column, suite: Column, suite_sha: Column, image: Column, deadline: Column) -> Column:
    """The first rule that an execution specification breaks, or null."""
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(bad(pvc.rlike(rf"^{label}(\.{label})*$") & (F.length(pvc) <= 253)), "pvc")
        .when(bad(suite.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*\.toml$") & ~suite.rlike(r"(^|/)(\.{1,2})?(/|$)") & (F.octet_length(suite) <= 512)), "suite path")
        .when(bad(suite_sha.rlike(HEX64)), "suite digest")
        .when(bad(image.rlike(r"^[a-z0-9]([a-z0-9._:/-]*[a-z0-9])?@sha256:[0-9a-f]{64}$")), "image not pinned")
        .when(bad(deadline.between(LEAST_DEADLINE, MOST_DEADLINE)), "deadline")
    )


#: Fixed values of the protocol: how fields look when they are set, and by outcome what fields must be, under the name of the fault. A field is set,
#: empty, empty at a start and else set, or one of some values.
FORMS = {"uid": UUID, "spec": HEX64, "run": RUN_ID, "decision": HEX64, "bundle": HEX64, "error": f"^({'|'.join(ERROR_CODES)})$", "action": "^(start|resume|verify)$"}
SET, EMPTY, EMPTY_AT_START = "set", "empty", "empty at start"
ALWAYS = (("action", {"action": SET}), ("uid", {"uid": SET}), ("spec", {"spec": SET}))
OUTCOMES = {
    "completed": (("outcome for action", {"action": ("start", "resume")}), ("run or bundle", {"run": SET, "bundle": SET}), ("error code", {"error": EMPTY}), ("decision", {"decision": EMPTY_AT_START})),
    "awaiting_approval": (("outcome for action", {"action": ("start",)}), ("run or decision", {"run": SET, "decision": SET}), ("bundle or error", {"bundle": EMPTY, "error": EMPTY})),
    "verified": (("outcome for action", {"action": ("verify",)}), ("run or bundle", {"run": SET, "bundle": SET}), ("decision or error", {"decision": EMPTY, "error": EMPTY})),
    "blocked": (("evidence on block", {"run": EMPTY, "decision": EMPTY, "bundle": EMPTY}), ("error code", {"error": SET})),
}


def result_fault(action: Column, outcome: Column, uid: Column, spec: Column, run: Column, decision: Column, bundle: Column, error: Column) -> Column:
    """The first rule of ``ALWAYS`` and of its outcome that a step result breaks, or null; all nine fields are strings, empty for none."""
    fields = {"action": action, "uid": uid, "spec": spec, "run": run, "decision": decision, "bundle": bundle, "error": error}

    def meets(name: str, want) -> Column:
        value = fields[name]
        if isinstance(want, tuple):
            return value.isin(*want)
        own = {SET: value.rlike(FORMS[name]), EMPTY: value == ""}
        return F.when(action == "start", own[EMPTY]).otherwise(own[SET]) if want == EMPTY_AT_START else own[want]

    rules = [(F.lit(True), name, wants) for name, wants in ALWAYS] + [(outcome == o, name, wants) for o, of_it in OUTCOMES.items() for name, wants in of_it]
    broken = [F.when(held & ~reduce(and_, [meets(f, want) for f, want in wants.items()]), name) for held, name, wants in rules]
    return F.coalesce(*broken, F.when(outcome.isin(*OUTCOMES), None).otherwise("outcome"))


def phase_of(outcome: Column) -> Column:
    return F.when(outcome == "completed", "Verifying").when(outcome == "awaiting_approval", "AwaitingApproval").when(outcome == "verified", "Succeeded").otherwise("Blocked")


def phases(results: DataFrame, run: str, order: str, outcome: str) -> DataFrame:
    """Per result the phase after it, with Succeeded only after a completed one and Blocked for ever once reached."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    unproved = (F.col(outcome) == "verified") & ~F.coalesce(F.max(F.col(outcome) == "completed").over(before), F.lit(False))
    bad = F.when(unproved, True).otherwise(~F.col(outcome).isin("completed", "awaiting_approval", "verified"))
    return results.withColumn("_bad", bad).withColumn("phase", F.when(F.max("_bad").over(w), "Blocked").otherwise(phase_of(F.col(outcome)))).drop("_bad")


def write_once(versions: DataFrame, key: str, order: str, value: str, published: str) -> DataFrame:
    """Versions that change a set value, or set it first to something else than what was published."""
    w = Window.partitionBy(key).orderBy(order)
    was = F.lag(value).over(w)
    marked = versions.withColumn("_was", was)
    changed = F.col("_was").isNotNull() & ~F.col(value).eqNullSafe(F.col("_was"))
    wrong = F.col("_was").isNull() & F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.col(published))
    return marked.withColumn("fault", F.when(changed, "changed").when(wrong, "not as published")).filter("fault is not null").drop("_was")


def lease_steps(leases: DataFrame, key: str, order: str, transitions: str) -> DataFrame:
    """Observations whose count of transitions is not one more than the one before."""
    w = Window.partitionBy(key).orderBy(order)
    return leases.withColumn("_was", F.lag(transitions).over(w)).filter(F.col("_was").isNotNull() & (F.col(transitions) != F.col("_was") + 1)).drop("_was")
