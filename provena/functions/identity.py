"""Content identity, digests and derived names (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX64 = r"^[0-9a-f]{64}$"
#: SHA-256 of no bytes: what the first record of a log names as its prefix.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def sha256(value: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes or of binary data."""
    return F.sha2(value.cast("binary"), 256)


def size_of(value: Column) -> Column:
    """Bytes, not code points."""
    return F.octet_length(value).cast("long")


def identity(value: Column) -> Column:
    return F.struct(sha256(value).alias("sha256"), size_of(value).alias("size"))


def same_identity(a_sha: Column, a_size: Column, b_sha: Column, b_size: Column) -> Column:
    """True when digest and size agree; a missing identity equals nothing, not even another missing one."""
    return F.coalesce((a_sha == b_sha) & (a_size == b_size), F.lit(False))


def valid_identity(sha: Column, size: Column) -> Column:
    return F.coalesce(sha.rlike(HEX64) & (size >= 0), F.lit(False))


def quarantine_name(task: Column, attempt: Column, path: Column) -> Column:
    """``a<8 digits>.<sha256 of task NUL attempt NUL path>.artifact``"""
    digest = F.sha2(F.concat_ws("\x00", task, attempt.cast("string"), path), 256)
    return F.concat(F.lit("a"), F.format_string("%08d", attempt), F.lit("."), digest, F.lit(".artifact"))


def job_name(uid: Column, action: Column, spec_sha: Column, prefix: str = "agentrun-") -> Column:
    """Deterministic: the first 16 hex digits of the SHA-256 of uid NUL action NUL spec."""
    return F.concat(F.lit(prefix), action, F.lit("-"), F.substring(F.sha2(F.concat_ws("\x00", uid, action, spec_sha), 256), 1, 16))


def log_name(task: Column, attempt: Column, stream: str) -> Column:
    return F.concat(F.lit("logs/"), task, F.lit("/attempt-"), F.format_string("%04d", attempt), F.lit(f".{stream}.log"))


def bare_digest(descriptor: Column) -> Column:
    """``sha256:<hex>`` without its prefix; null for any other form."""
    return F.when(descriptor.rlike(r"^sha256:[0-9a-f]{64}$"), F.substring(descriptor, 8, 64))


def path_set_digest(paths: Column) -> Column:
    """SHA-256 of the canonical JSON list of a set of paths in byte order."""
    return F.sha2(F.concat(F.to_json(F.array_sort(F.array_distinct(paths))), F.lit("\n")), 256)


def execution_spec_sha(schema_version: str, pvc: Column, suite: Column, suite_sha: Column, image: Column, deadline: Column) -> Column:
    """SHA-256 of the JSON of the specification in declared field order, with no newline at its end."""
    fields = F.struct(F.lit(schema_version).alias("schemaVersion"), pvc.alias("pvcName"), suite.alias("suitePath"), suite_sha.alias("suiteSHA256"), image.alias("runnerImage"), deadline.cast("long").alias("activeDeadlineSeconds"))
    return F.sha2(F.to_json(fields), 256)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)
