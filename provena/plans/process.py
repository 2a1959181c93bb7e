"""Queries on attempts, work counts, decisions and phases over the given tables, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import identity as I
from provena.operators import control, decision, state
from provena.plans import tables as t

SPEC_VERSION = "execution-spec/v1"


def latest_attempts(spark, sf):
    orders = t.read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    best = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    orders = orders.groupBy("l_orderkey", "l_linenumber").agg(F.max(best).alias("b")).select("l_orderkey", "l_linenumber", "b.l_partkey", "b.l_suppkey")
    return state.latest(orders, ["l_orderkey"], "l_linenumber")


def attempt_numbering(spark, sf):
    return state.numbering(t.attempts(spark, sf), ["run"], "number")


def completed_prefix(spark, sf):
    tasks = t.attempts(spark, sf).groupBy("run", "number").agg(F.min("done").alias("done"))
    return state.completed_prefix(tasks, "run", "number", F.col("done"))


def superseded_attempts(spark, sf):
    tasks = t.attempts(spark, sf).groupBy("run", "number").agg(F.max("flag").alias("flag"))
    return state.superseded(tasks, ["run"], "number", F.col("flag") == "R").select("run", "number")


def attempt_budgets(spark, sf):
    rows = t.read(spark, sf, "lineitem", "l_suppkey", "l_orderkey").select(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("task"))
    return state.budgets(rows, "run", "task")


def work_counts(spark, sf):
    rows = t.attempts(spark, sf).select(F.col("worker").alias("run"), "task", "done")
    return state.work(rows, "run", "task", F.col("done"))


def resume_decisions(spark, sf):
    prefix = completed_prefix(spark, sf)
    status = t.read(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = status.join(prefix, F.col("o_orderkey") == F.col("run")).select(
        "run", "prefix", F.col("next_task").cast("long").alias("next_task"),
        decision.action(F.col("o_orderpriority") == "5-LOW", F.when(F.col("next_task").isNotNull(), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")), F.col("o_orderstatus") == "F").alias("action"),
    )
    return decision.with_digest(rows, ["run", "prefix", "next_task", "action"])


def lock_decisions(spark, sf):
    e = t.read(spark, sf, "events", "user_id", "event_id", "event_type", "props")
    word = lambda c: F.when(c == "error", "dead").when(c == "signup", "unknown").otherwise("alive")
    per = e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("a"), F.max_by("event_type", "event_id").alias("b"), F.min_by("props", "event_id").alias("x"), F.max_by("props", "event_id").alias("y"), F.max("props").alias("z"))
    d = decision.lock(word(F.col("a")), word(F.col("b")), F.col("x"), F.when(F.col("b") == "click", F.col("x")).otherwise(F.col("y")), F.when(F.col("a") == "view", F.col("x")).otherwise(F.col("z")))
    return per.select("user_id", d.alias("d")).select("user_id", "d.verdict", "d.reason")


def result_phases(spark, sf):
    e = t.read(spark, sf, "events", "user_id", "event_id", "event_type")
    outcome = F.when(F.col("event_type") == "signup", "awaiting_approval").when(F.col("event_type").isin("view", "click"), "completed").when(F.col("event_type") == "purchase", "verified").otherwise("blocked")
    return control.phases(e.withColumn("outcome", outcome), "user_id", "event_id", "outcome").select("user_id", "event_id", "phase")


def result_matrix(spark, sf):
    r = t.step_results(spark, sf)
    names = ("action", "outcome", "uid", "spec", "run", "decision", "bundle", "error")
    return r.select("o_orderkey", "action", "outcome", control.result_fault(*map(F.col, names)).alias("fault"))


def attempt_rules(spark, sf):
    a = t.attempt_records(spark, sf)
    return a.select("o_orderkey", "status", F.array_join(state.attempt_faults(), ",").alias("faults"))


def scope_rules(spark, sf):
    a = t.attempt_records(spark, sf)
    return a.select("o_orderkey", state.scope_fault(*map(F.col, ("status", "child", "guard", "scope", "empty", "closure"))).alias("fault"))


def spec_digests(spark, sf):
    s = t.specifications(spark, sf)
    fields = [F.col(c) for c in ("pvc", "suite", "suite_sha", "image", "deadline")]
    return s.select("o_orderkey", I.execution_spec_sha(SPEC_VERSION, *fields).alias("spec_sha256"), control.spec_fault(*fields).alias("fault"))


def write_once(spark, sf):
    o = t.read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    versions = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("value"), F.lit("F").alias("published"))
    return control.write_once(versions, "o_custkey", "o_orderkey", "value", "published").select("o_custkey", "o_orderkey", "fault")


def lease_steps(spark, sf):
    return control.lease_steps(t.event_log(spark, sf), "run", "micros", "seq").select("run", "seq")


QUERIES = {f.__name__: f for f in (latest_attempts, attempt_numbering, completed_prefix, superseded_attempts, attempt_budgets, work_counts, resume_decisions, lock_decisions, result_phases, result_matrix, attempt_rules, scope_rules, spec_digests, write_once, lease_steps)}

_PREFIX = """t AS (SELECT l_orderkey AS run, l_linenumber AS number, bool_and(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1, 2), o AS (SELECT *, sum(CASE WHEN done THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY number ROWS UNBOUNDED PRECEDING) AS op FROM t),
    pre AS (SELECT run, count(*) AS n_tasks, count(*) FILTER (op = 0) AS prefix, min(number) FILTER (NOT done) AS next_task, count(*) FILTER (done AND op > 0) AS n_illegal FROM o GROUP BY run)"""
_d, _pick = t.digit_sql, t.pick_sql
_KEYED = "k AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS m, sha256(o_orderkey::VARCHAR) AS h FROM orders)"
_RESULTS = f"""{_KEYED}, r AS (SELECT o_orderkey, {_pick(1, "start", "resume", "verify", "start", "resume", "verify", "restart")} AS action, {_pick(2, "completed", "awaiting_approval", "verified", "blocked", "completed", "odd")} AS outcome,
        CASE WHEN {_d(3)} = 0 THEN upper(h) ELSE h END AS uid, CASE WHEN {_d(4)} = 0 THEN '' ELSE h END AS spec, CASE WHEN {_d(5)} < 6 THEN h[1:32] WHEN {_d(5)} < 13 THEN '' ELSE h END AS run,
        CASE WHEN {_d(6)} < 8 THEN h ELSE '' END AS decision, CASE WHEN {_d(7)} < 8 THEN h ELSE '' END AS bundle, {_pick(8, "", "", "execution_failed", "", "invalid_request", "evidence_invalid", "internal_error", "task_error")} AS error FROM k)"""
_ATTEMPTS = f"""{_KEYED}, a AS (SELECT o_orderkey, {_pick(1, "completed", "failed", "interrupted", "running", "completed", "failed", "odd")} AS status, CASE WHEN {_d(2)} = 0 THEN 3 ELSE 2 END AS number, CASE WHEN {_d(3)} > 0 THEN 10 END AS started,
        {_pick(4, 20, None, 20, 5, 20)} AS ended, {_pick(5, 7, None, 7, 8)} AS child, CASE WHEN {_d(6)} > 3 THEN 't' END AS token, {_d(7)} < 3 AS guard, {_pick(8, 0, None, 1)} AS code, {_pick(9, None, None, "lost", "")} AS unavailable,
        CASE WHEN {_d(10)} < 8 THEN 'o' END AS outputs, CASE WHEN {_d(11)} < 5 THEN 'e' WHEN {_d(11)} = 5 THEN '' WHEN {_d(11)} = 6 THEN repeat('x', 8193) END AS error, CASE WHEN {_d(12)} < 4 THEN 'r' END AS reason, CASE WHEN {_d(13)} < 5 THEN 'q' END AS quarantined,
        {_pick(14, 7, None, 7, 8, 0)} AS scope, CASE WHEN {_d(15)} > 0 THEN {_d(15)} < 9 END AS nothing, {_pick(16, "pending-launch", "active", "not-created", "launch-cleaned", "natural-empty", "terminated", "recovered-empty", "exited")} AS closure FROM k)"""
_SPECS = f"""{_KEYED}, s AS (SELECT o_orderkey, {_pick(1, "pvc-", "pvc.a-", "Pvc-", "pvc..a", "-pvc", "pvc-")} || o_orderkey AS pvc, {_pick(2, "s/", "", "../", "s/./", "/s", "s//", "s/", "a_b/")} || o_orderkey || {_pick(3, ".toml", ".toml", ".toml", ".json")} AS suite,
        CASE WHEN {_d(4)} = 0 THEN upper(h) WHEN {_d(4)} = 1 THEN h[1:63] ELSE h END AS sha, {_pick(5, "registry/x@sha256:", "r.io:5000/x@sha256:", "Registry/x@sha256:", "x@sha256:", "x:latest@")} || h AS image, {_pick(6, 30, 29, 1800, 1801, 600, 60, 900)} AS deadline FROM k)"""
ORACLES = {
    "latest_attempts": """WITH m AS (SELECT l_orderkey, max((l_linenumber, l_partkey, l_suppkey)) AS b
        FROM lineitem
        GROUP BY 1) SELECT l_orderkey, b[1] AS l_linenumber, b[2] AS l_partkey, b[3] AS l_suppkey
        FROM m""",
    "attempt_numbering": """SELECT l_orderkey AS run, count(*) AS n_attempts, max(l_linenumber)::BIGINT AS last_attempt, count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS contiguous
        FROM lineitem
        GROUP BY 1""",
    "completed_prefix": f"WITH {_PREFIX} SELECT * FROM pre",
    "superseded_attempts": """WITH t AS (SELECT l_orderkey AS run, l_linenumber AS number, max(l_returnflag) AS flag
        FROM lineitem
        GROUP BY 1, 2) SELECT run, number
        FROM (SELECT *, lead(number) OVER (PARTITION BY run ORDER BY number) AS nx
        FROM t)
        WHERE nx IS NOT NULL AND flag <> 'R'""",
    "attempt_budgets": """WITH p AS (SELECT l_suppkey AS run, l_orderkey AS task, count(*) AS n
        FROM lineitem
        GROUP BY 1, 2) SELECT run, count(*) AS n_tasks, sum(n)::BIGINT AS n_attempts, max(n) AS most, max(n) <= 4 AND sum(n) <= 256 AS within_budget
        FROM p
        GROUP BY run""",
    "work_counts": """WITH p AS (SELECT l_suppkey AS run, l_partkey AS task, count(*) AS calls, count(*) FILTER (l_linestatus = 'F') AS good
        FROM lineitem
        GROUP BY 1, 2) SELECT run, sum(calls)::BIGINT AS calls, sum(good)::BIGINT AS successes, sum(greatest(0, good - 1))::BIGINT AS duplicates, count(*) FILTER (good > 0) AS completed
        FROM p
        GROUP BY run""",
    "resume_decisions": f"""WITH {_PREFIX}, d AS (SELECT run, prefix, next_task::BIGINT AS next_task, CASE WHEN o_orderpriority = '5-LOW' THEN CASE WHEN next_task IS NULL AND o_orderstatus = 'F' THEN 'already-complete' END WHEN next_task IS NULL THEN CASE WHEN o_orderstatus = 'F' THEN 'seal-completed-run' END WHEN o_orderstatus = 'P' THEN 'recover-and-resume' ELSE 'resume' END AS action
        FROM orders JOIN pre ON run = o_orderkey) SELECT *, sha256('{{"action":' || coalesce('"' || action || '"', 'null') || ',"next_task":' || coalesce(next_task::VARCHAR, 'null') || ',"prefix":' || prefix || ',"run":' || run || '}}' || chr(10)) AS decision_sha256 FROM d""",
    "lock_decisions": """WITH p AS (SELECT user_id, arg_min(event_type, event_id) AS a, arg_max(event_type, event_id) AS b, arg_min(props, event_id) AS x, arg_max(props, event_id) AS y, max(props) AS z FROM events GROUP BY 1),
        w AS (SELECT user_id, CASE a WHEN 'error' THEN 'dead' WHEN 'signup' THEN 'unknown' ELSE 'alive' END AS f, CASE b WHEN 'error' THEN 'dead' WHEN 'signup' THEN 'unknown' ELSE 'alive' END AS s, x, CASE WHEN b = 'click' THEN x ELSE y END AS y, CASE WHEN a = 'view' THEN x ELSE z END AS z FROM p),
        r AS (SELECT user_id, CASE WHEN f = 'unknown' OR s = 'unknown' THEN 'owner-liveness-unknown' WHEN f = 'dead' AND s = 'dead' THEN 'owner-dead' WHEN f = 'dead' OR s <> 'alive' OR x <> y THEN 'owner-observation-changed' WHEN x = z THEN 'owner-alive' ELSE 'owner-pid-reused' END AS reason FROM w)
        SELECT user_id, CASE WHEN reason IN ('owner-dead', 'owner-pid-reused') THEN 'recover-orphan' ELSE 'refuse' END AS verdict, reason FROM r""",
    "result_phases": """WITH e AS (SELECT *, max(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM events),
        b AS (SELECT *, max(CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND coalesce(c, 0) = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bad FROM e)
        SELECT user_id, event_id, CASE WHEN bad = 1 THEN 'Blocked' WHEN event_type = 'signup' THEN 'AwaitingApproval' WHEN event_type = 'purchase' THEN 'Succeeded' ELSE 'Verifying' END AS phase FROM b""",
    "result_matrix": f"""WITH {_RESULTS} SELECT o_orderkey, action, outcome, CASE
          WHEN action NOT IN ('start', 'resume', 'verify') THEN 'action'
          WHEN uid <> lower(uid) THEN 'uid'
          WHEN spec = '' THEN 'spec'
          WHEN outcome = 'completed' THEN CASE
            WHEN action = 'verify' THEN 'outcome for action'
            WHEN length(run) <> 32 OR bundle = '' THEN 'run or bundle'
            WHEN error <> '' THEN 'error code'
            WHEN (action = 'start') <> (decision = '') THEN 'decision' END
          WHEN outcome = 'awaiting_approval' THEN CASE
            WHEN action <> 'start' THEN 'outcome for action'
            WHEN length(run) <> 32 OR decision = '' THEN 'run or decision'
            WHEN bundle <> '' OR error <> '' THEN 'bundle or error' END
          WHEN outcome = 'verified' THEN CASE
            WHEN action <> 'verify' THEN 'outcome for action'
            WHEN length(run) <> 32 OR bundle = '' THEN 'run or bundle'
            WHEN decision <> '' OR error <> '' THEN 'decision or error' END
          WHEN outcome = 'blocked' THEN CASE
            WHEN run || decision || bundle <> '' THEN 'evidence on block'
            WHEN error NOT IN ('invalid_request', 'execution_failed', 'evidence_invalid', 'internal_error') THEN 'error code' END
          ELSE 'outcome' END AS fault FROM r""",
    "attempt_rules": f"""WITH {_ATTEMPTS} SELECT o_orderkey, status, array_to_string([x FOR x IN [
          CASE WHEN status = 'odd' THEN 'status' END,
          CASE WHEN number <> 2 THEN 'number' END,
          CASE WHEN started IS NULL THEN 'started' END,
          CASE WHEN (status = 'running') = (ended IS NOT NULL) THEN 'ended' END,
          CASE WHEN ended < started THEN 'order' END,
          CASE WHEN guard AND NOT (status = 'running' AND child IS NULL AND token IS NULL) THEN 'guard' END,
          CASE WHEN status = 'running' AND child IS NULL AND NOT guard THEN 'child' END,
          CASE WHEN status = 'running' AND code IS NOT NULL THEN 'running code' END,
          CASE WHEN unavailable = '' OR (unavailable IS NOT NULL AND NOT (status = 'interrupted' AND child IS NOT NULL AND code IS NULL)) THEN 'unavailable' END,
          CASE WHEN ended_badly AND child IS NULL AND code IS NOT NULL THEN 'code without child' END,
          CASE WHEN ended_badly AND child IS NOT NULL AND code IS NULL AND unavailable IS NULL THEN 'no code' END,
          CASE WHEN status = 'completed' AND (child IS NULL OR token IS NULL) THEN 'completed child' END,
          CASE WHEN status = 'completed' AND code IS DISTINCT FROM 0 THEN 'completed code' END,
          CASE WHEN (status = 'completed') <> (outputs IS NOT NULL) THEN 'outputs' END,
          CASE WHEN ended_badly AND error IS NULL AND reason IS NULL THEN 'no detail' END,
          CASE WHEN length(error) NOT BETWEEN 1 AND 8192 THEN 'detail' END,
          CASE WHEN quarantined IS NOT NULL AND NOT ended_badly THEN 'quarantine' END] IF x IS NOT NULL], ',') AS faults
        FROM (SELECT *, status IN ('failed', 'interrupted') AS ended_badly FROM a)""",
    "scope_rules": f"""WITH {_ATTEMPTS} SELECT o_orderkey, CASE
          WHEN scope = 0 THEN 'scope id'
          WHEN nothing IS NULL THEN 'empty'
          WHEN closure = 'exited' THEN 'closure'
          WHEN guard THEN CASE WHEN NOT (scope IS NULL AND NOT nothing AND closure = 'pending-launch') THEN 'launch' END
          WHEN child IS NULL THEN CASE WHEN NOT (status = 'failed' AND scope IS NULL AND nothing AND closure IN ('not-created', 'launch-cleaned')) THEN 'absent' END
          WHEN scope IS DISTINCT FROM child THEN 'leader'
          WHEN status = 'running' THEN CASE WHEN NOT (closure = 'active' AND NOT nothing) THEN 'running' END
          WHEN NOT (nothing AND closure IN ('natural-empty', 'terminated', 'recovered-empty')) THEN 'terminal' END AS fault FROM a""",
    "spec_digests": f"""WITH {_SPECS} SELECT o_orderkey,
          sha256('{{"schemaVersion":"execution-spec/v1","pvcName":"' || pvc || '","suitePath":"' || suite || '","suiteSHA256":"' || sha || '","runnerImage":"' || image || '","activeDeadlineSeconds":' || deadline || '}}') AS spec_sha256,
          CASE WHEN pvc <> lower(pvc) OR pvc LIKE '%..%' OR pvc LIKE '-%' THEN 'pvc'
            WHEN suite NOT LIKE '%.toml' OR suite LIKE '/%' OR suite LIKE '%//%' OR list_has_any(string_split(suite, '/'), ['.', '..']) THEN 'suite path'
            WHEN sha <> lower(sha) OR length(sha) <> 64 THEN 'suite digest'
            WHEN image <> lower(image) OR NOT contains(image, '@sha256:') THEN 'image not pinned'
            WHEN deadline < 30 OR deadline > 1800 THEN 'deadline' END AS fault FROM s""",
    "write_once": """WITH v AS (SELECT o_custkey, o_orderkey, nullif(o_orderstatus, 'P') AS v FROM orders), w AS (SELECT *, lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM v)
        SELECT o_custkey, o_orderkey, CASE WHEN was IS NOT NULL THEN 'changed' ELSE 'not as published' END AS fault FROM w WHERE (was IS NOT NULL AND v IS DISTINCT FROM was) OR (was IS NULL AND v IS NOT NULL AND v <> 'F')""",
    "lease_steps": """SELECT run, seq
        FROM (SELECT user_id AS run, event_id AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS was
        FROM events)
        WHERE was IS NOT NULL AND seq <> was + 1""",
}
