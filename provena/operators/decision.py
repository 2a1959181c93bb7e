"""Resume and lock decisions: one row per run, its action and the digest that an approval must name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def action(bundled: Column, next_status: Column, run_completed: Column) -> Column:
    """already-complete, seal-completed-run, recover-and-resume, resume, or null where the evidence contradicts itself."""
    return (
        F.when(bundled, F.when(next_status.isNull() & run_completed, "already-complete"))
        .when(next_status.isNull(), F.when(run_completed, "seal-completed-run"))
        .when(next_status.isin("running", "failed"), "recover-and-resume").otherwise("resume")
    )


def with_digest(decisions: DataFrame, fields: list[str]) -> DataFrame:
    """Adds decision_sha256, the SHA-256 of the canonical JSON of the fields (in name order, nulls kept) and a newline."""
    body = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return decisions.withColumn("decision_sha256", F.sha2(F.concat(body, F.lit("\n")), 256))


def stale(approved: Column, current: Column) -> Column:
    """Whether an approval names another state than the present one; nothing may be written then."""
    return ~approved.eqNullSafe(current)


def lock(first: Column, second: Column, token: Column, token_again: Column, recorded: Column) -> Column:
    """(verdict, reason) on a writer lock from two observations of its owner: liveness each, start token each, and the recorded token.

    Verdicts and reasons are fixed values."""
    verdict = lambda v, r: F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("reason"))
    has = lambda c: F.coalesce(c != "", F.lit(False))
    unknown, changed = verdict("refuse", "owner-liveness-unknown"), verdict("refuse", "owner-observation-changed")
    return (
        F.when((first == "unknown") | (second == "unknown"), unknown)
        .when((first == "dead") & (second == "dead"), verdict("recover-orphan", "owner-dead"))
        .when((first == "dead") | (second != "alive"), changed)
        .when(~has(token) | ~has(token_again), verdict("refuse", "owner-identity-unverifiable"))
        .when(token != token_again, changed)
        .when(~has(recorded), verdict("refuse", "owner-identity-unverifiable"))
        .when(token == recorded, verdict("refuse", "owner-alive"))
        .otherwise(verdict("recover-orphan", "owner-pid-reused"))
    )
