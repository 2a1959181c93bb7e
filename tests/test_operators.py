from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from provena.operators import control, decision, eventlog, evidence, ledger, lineage, manifest, state

M = "path string, kind string, sha256 string, size long"
H = "a" * 64


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_diff_has_all_four_statuses(spark):
    e = table(spark, [("a", "file", H, 1), ("b", "file", H, 1), ("c", "file", H, 1), ("d", "directory", None, None)], M)
    a = table(spark, [("a", "file", H, 1), ("b", "file", H, 2), ("d", "directory", None, None), ("x", "file", H, 1)], M)
    assert dict(manifest.diff(e, a).collect()) == {"a": "match", "b": "drift", "c": "missing", "d": "match", "x": "extra"}
    assert manifest.diff(e.limit(0), a.limit(0)).count() == 0


def test_tree_summary_and_cap(spark):
    rows = [("s", "a", "directory", None, None), ("s", "a/b", "file", H, 3), ("t", "z", "file", H, 1)]
    df = table(spark, rows, "g string, " + M)
    want = '{"entries":[{"kind":"directory","path":"a"},{"kind":"file","path":"a/b","sha256":"' + H + '","size":3}],"kind":"tree","schema_version":1}\n'
    got = {r.g: r for r in manifest.tree_summary(df, "g").collect()}
    assert got["s"].tree_sha256 == hashlib.sha256(want.encode()).hexdigest() and (got["s"].n_directories, got["s"].n_files, got["s"].total_bytes) == (1, 1, 3)
    capped = {r.g: r for r in manifest.tree_summary(df, "g", most=1).collect()}
    assert capped["s"].tree_sha256 is None and capped["s"].n_entries == 2 and capped["t"].tree_sha256 is not None
    assert manifest.tree_summary(df.drop("g")).first().n_entries == 3


def test_tree_summary_of_a_large_group(spark):
    n = 10_001
    df = spark.range(n).select(F.when(F.col("id") < 3, F.lit(None)).otherwise("s").alias("g"), F.concat(F.lit("p/é"), "id").alias("path"), F.lit("file").alias("kind"), F.lit(H).alias("sha256"), F.lit(3).cast("long").alias("size"))
    df = df.unionByName(df.filter("path in ('p/é9', 'p/é10')").withColumn("g", F.lit("t")))

    def want(ids):
        entries = ",".join(f'{{"kind":"file","path":"{p}","sha256":"{H}","size":3}}' for p in sorted((f"p/é{i}" for i in ids), key=str.encode))
        return hashlib.sha256(('{"entries":[' + entries + '],"kind":"tree","schema_version":1}\n').encode()).hexdigest()

    got = {r.g: r for r in manifest.within_limits(manifest.tree_summary(df, "g"), most=9_000).collect()}
    assert {g: r.tree_sha256 for g, r in got.items()} == {None: want(range(3)), "s": want(range(3, n)), "t": want([9, 10])}
    assert {g: r.within_limits for g, r in got.items()} == {None: True, "s": False, "t": True}
    assert manifest.tree_summary(df.drop("g").filter("path != 'p/é9' and path != 'p/é10'")).first().tree_sha256 == want(i for i in range(n) if i not in (9, 10))


def test_manifest_violations(spark):
    rows = [("a", "file", H, 1), ("a/b", "file", H, 1), ("../x", "file", H, 1), ("c", "file", "bad", 1), ("d", "directory", H, 1), ("e/f", "file", H, 1), ("g", "file", H, 1), ("g", "file", H, 1)]
    got = {(r.path, r.rule) for r in manifest.violations(table(spark, rows, M)).collect()}
    assert {("a/b", "below a file"), ("../x", "path not portable"), ("c", "bad identity"), ("d", "directory with identity"), ("e/f", "parent not listed"), ("g", "listed twice")} <= got
    assert not any(p == "c" and r != "bad identity" for p, r in got)


def test_projected_collision(spark):
    b, o = table(spark, [("a", "file", H, 1)], M), table(spark, [("a", "file", H, 2), ("b", "file", H, 1)], M)
    assert {(r.path, r.collides) for r in manifest.projected(b, o).collect()} == {("a", True), ("b", False)}


def test_chain_is_over_the_prefix(spark):
    rows = [(r, i, f"{r}-{i}\n") for r in (1, 2) for i in range(1, 6)]
    df = table(spark, rows, "run int, seq int, line string")
    want = {(r, i): hashlib.sha256("".join(f"{r}-{j}\n" for j in range(1, i)).encode()).hexdigest() for r in (1, 2) for i in range(1, 6)}
    for f in (eventlog.chain, eventlog.chain_by_window):
        assert {(x.run, x.seq): x.previous_sha256 for x in f(df, "run", "seq", "line").collect()} == want
    bad = df.withColumn("rec", F.lit("0" * 64))
    assert eventlog.broken_links(bad, "run", "seq", "line", "rec").count() == 10


def test_contiguity(spark):
    df = table(spark, [(1, 1, 5), (1, 2, 6), (1, 4, 3)], "run int, seq int, ts int")
    r = eventlog.contiguity(df, "run", "seq", "ts").first()
    assert (r.n_events, r.first_seq, r.last_seq, r.n_gaps, r.n_backwards) == (3, 1, 4, 1, 1)


def test_transition_table(spark):
    rows = [(1, 1, False, True, "stable"), (1, 1, True, True, "pending_before_log"), (1, 2, True, True, "pending_after_log"), (1, 2, False, True, "diverged"), (1, 3, True, True, "diverged"), (1, 1, False, False, "diverged")]
    df = table(spark, rows, "a int, l int, p boolean, s boolean, want string")
    assert df.filter(eventlog.transition_status(*map(F.col, "alps")) != F.col("want")).count() == 0


def test_state(spark):
    tasks = table(spark, [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True), (2, 1, True)], "run int, k int, done boolean")
    got = {r.run: (r.n_tasks, r.prefix, r.next_task, r.n_illegal) for r in state.completed_prefix(tasks, "run", "k", F.col("done")).collect()}
    assert got == {1: (4, 2, 3, 1), 2: (1, 1, None, 0)}
    att = table(spark, [(1, "t", n, n == 6) for n in range(1, 7)], "run int, task string, n int, ok boolean")
    assert state.budgets(att, "run", "task").first().within_budget is False
    assert state.numbering(att, ["task"], "n").first().contiguous is True
    assert state.latest(att, ["task"], "n").first().n == 6
    assert state.superseded(att, ["task"], "n", F.lit(True)).count() == 0 and state.superseded(att, ["task"], "n", F.lit(False)).count() == 5


ATTEMPT = {"status": "completed", "index": 0, "number": 1, "started": 1, "ended": 2, "child": 7, "token": "t", "guard": False, "return_code": 0, "unavailable": None, "outputs": "o", "error": None, "reason": None, "quarantined": None}
ATTEMPT_TYPE = "status string, index int, number int, started int, ended int, child int, token string, guard boolean, return_code int, unavailable string, outputs string, error string, reason string, quarantined string"


def test_attempt_rules(spark):
    failed = {"status": "failed", "return_code": 75, "outputs": None, "error": "exit 75"}
    cases = [
        ({}, []), (failed, []), (failed | {"outputs": "o"}, ["outputs"]), (failed | {"error": None}, ["no detail"]), (failed | {"error": "x" * 8193}, ["detail"]), (failed | {"quarantined": "q"}, []), ({"quarantined": "q"}, ["quarantine"]),
        ({"status": "running", "ended": None, "return_code": None}, ["outputs"]), ({"status": "running", "ended": None, "return_code": None, "outputs": None}, []),
        ({"status": "running", "ended": None, "return_code": None, "outputs": None, "child": None, "token": None}, ["child"]), ({"status": "running", "ended": None, "return_code": None, "outputs": None, "child": None, "token": None, "guard": True}, []),
        ({"return_code": 1}, ["completed code"]), ({"number": 2}, ["number"]), ({"ended": 0}, ["order"]), ({"token": None}, ["completed child"]), ({"status": "odd"}, ["status", "outputs"]),
        (failed | {"return_code": None}, ["no code"]), (failed | {"status": "interrupted", "return_code": None, "unavailable": "lost"}, []), (failed | {"child": None}, ["code without child"]),
    ]
    df = table(spark, [tuple((ATTEMPT | change).values()) for change, _ in cases], ATTEMPT_TYPE)
    assert [r.f for r in df.select(state.attempt_faults().alias("f")).collect()] == [want for _, want in cases]


def test_scope_rules(spark):
    cases = [
        ("completed", 7, False, 7, True, "natural-empty", None), ("completed", 7, False, 7, False, "natural-empty", "terminal"), ("interrupted", 7, False, 7, True, "recovered-empty", None), ("running", 7, False, 7, False, "active", None),
        ("running", 7, False, 7, False, "terminated", "running"), ("failed", None, False, None, True, "not-created", None), ("completed", None, False, None, True, "not-created", "absent"), ("running", None, True, None, False, "pending-launch", None),
        ("running", None, True, None, True, "pending-launch", "launch"), ("completed", 7, False, 8, True, "terminated", "leader"), ("completed", 7, False, 7, True, "exited", "closure"), ("completed", 7, False, 0, True, "terminated", "scope id"), ("completed", 7, False, 7, None, "terminated", "empty"),
    ]
    df = table(spark, cases, "status string, child int, guard boolean, scope int, empty boolean, closure string, want string")
    fault = state.scope_fault(*map(F.col, ("status", "child", "guard", "scope", "empty", "closure")))
    assert df.filter(~fault.eqNullSafe(F.col("want"))).count() == 0


def test_work_counts_of_the_two_strategies(spark):
    """Twelve tasks of which the sixth fails once: a full restart repeats five, a resume none."""
    naive = [(f"t{i}", True) for i in range(1, 6)] + [("t6", False)] + [(f"t{i}", True) for i in range(1, 13)]
    resume = [(f"t{i}", True) for i in range(1, 6)] + [("t6", False)] + [(f"t{i}", True) for i in range(6, 13)]
    df = table(spark, [("naive", *x) for x in naive] + [("resume", *x) for x in resume], "run string, task string, ok boolean")
    got = {r.run: (r.calls, r.successes, r.duplicates, r.completed) for r in state.work(df, "run", "task", F.col("ok")).collect()}
    assert got == {"naive": (18, 17, 5, 12), "resume": (13, 12, 0, 12)}


def test_lineage(spark):
    inputs = table(spark, [(1, "seed"), (2, "a"), (3, "b"), (2, "late"), (1, "seed")], "task int, path string")
    outputs = table(spark, [(1, "a"), (2, "b"), (3, "late"), (4, "a")], "task int, path string")
    assert {tuple(r) for r in lineage.seeds(inputs, outputs).collect()} == {("seed", 1), ("late", 2)}
    assert [tuple(r) for r in lineage.double_producers(outputs).collect()] == [("a", 2)]
    assert [tuple(r) for r in lineage.overwritten_seeds(inputs, outputs).collect()] == [("late", 2, 3)]
    seed = table(spark, [("seed", H, 1)], "path string, sha256 string, size long")
    sealed = table(spark, [(1, "a", H, 2)], "task int, path string, sha256 string, size long")
    got = {(r.task, r.path): r.origin for r in lineage.expected_inputs(inputs.distinct(), outputs, seed, sealed).collect()}
    assert got == {(1, "seed"): "seed", (2, "a"): "output", (3, "b"): "producer not completed", (2, "late"): "produced later"}
    p = table(spark, [("a",), ("a/b",), ("ab/c",)], "path string")
    assert [tuple(r) for r in lineage.ancestor_conflicts(p).collect()] == [("a/b", "a")]


def test_evidence(spark):
    k = lambda *v: table(spark, [(x,) for x in v], "k int")
    assert {tuple(r) for r in evidence.exactness(k(1, 2), k(2, 3), "k").collect()} == {(1, "missing"), (3, "unexpected")}
    assert evidence.is_subset(k(1), k(1, 2), "k") and not evidence.is_subset(k(3), k(1), "k") and evidence.equal_sets(k(1, 1), k(1, 1)) and not evidence.equal_sets(k(1, 1), k(1))
    s = "path string, sha256 string, size long"
    sealed, now = table(spark, [("a", H, 1), ("b", H, 1)], s), table(spark, [("a", H, 1), ("b", H, 9)], s)
    r = evidence.verify(sealed, now).first()
    assert (r.n_match, r.n_drift, r.n_missing, r.n_extra, r.verified) == (1, 1, 0, 0, False)
    b = {r.run: r.bound for r in evidence.binding(k(1, 2).toDF("run"), k(1, 1).toDF("run"), k(1).toDF("run"), "run").collect()}
    assert b == {1: False, 2: False}


def test_decisions(spark):
    rows = [(True, None, True, "already-complete"), (True, "pending", True, None), (False, None, True, "seal-completed-run"), (False, None, False, None), (False, "failed", False, "recover-and-resume"), (False, "running", False, "recover-and-resume"), (False, "pending", False, "resume")]
    df = table(spark, rows, "b boolean, n string, c boolean, want string")
    assert df.filter(~decision.action(F.col("b"), F.col("n"), F.col("c")).eqNullSafe(F.col("want"))).count() == 0
    d = decision.with_digest(table(spark, [(1, None)], "b int, a string"), ["b", "a"]).first()
    assert d.decision_sha256 == hashlib.sha256(b'{"a":null,"b":1}\n').hexdigest()
    locks = [("dead", "dead", None, None, "t", "owner-dead"), ("dead", "alive", None, None, "t", "owner-observation-changed"), ("unknown", "alive", "t", "t", "t", "owner-liveness-unknown"), ("alive", "unknown", "t", "t", "t", "owner-liveness-unknown"), ("alive", "dead", "t", "t", "t", "owner-observation-changed"), ("alive", "alive", "t", "t", "t", "owner-alive"), ("alive", "alive", "t", "u", "t", "owner-observation-changed"), ("alive", "alive", "u", "u", "t", "owner-pid-reused"), ("alive", "alive", "", "u", "t", "owner-identity-unverifiable"), ("alive", "alive", "u", "u", None, "owner-identity-unverifiable")]
    df = table(spark, locks, "a string, b string, x string, y string, r string, want string")
    assert df.filter(decision.lock(*map(F.col, "abxyr"))["reason"] != F.col("want")).count() == 0


def test_ledger(spark):
    base = dict(id="EXT-2024-0001", kind="independent_user", subject="x", scope="s", relationship="independent", consent_to_list=True, source_commit="a" * 40, observed_date="2024-01-01", verified_date="2024-01-02", evidence_url="u", status="verified", retracted_date=None, retraction_reason=None, key="k")
    schema = ", ".join(f"{c} {'boolean' if c == 'consent_to_list' else 'string'}" for c in base)
    changes = [({}, []), ({"id": "EXT-2023-0001"}, ["id_year"]), ({"consent_to_list": False}, ["consent"]), ({"verified_date": "2023-12-31"}, ["verified_date"]), ({"verified_date": "2030-01-01"}, ["verified_date"]), ({"status": "retracted"}, ["retracted_date", "retraction_reason"]), ({"key": None}, ["evidence_url"]), ({"subject": " x"}, ["subject"]), ({"observed_date": "2024-13-01"}, ["observed_date", "verified_date"])]  # what cannot be compared fails closed
    df = table(spark, [tuple((base | c).values()) for c, _ in changes], schema)
    got = [r[0] for r in df.select(ledger.faults("2024-12-31", F.col("key"))).collect()]
    assert got == [w for _, w in changes]
    counted = table(spark, [("independent_user", "verified", "a"), ("independent_user", "verified", "a"), ("independent_user", "retracted", "b"), ("third_party_review", "verified", "c")], "kind string, status string, subject_key string")
    assert {tuple(r) for r in ledger.counts(counted).collect()} == {("independent_user", 2, 1), ("third_party_review", 1, 1)}
    assert [tuple(r) for r in ledger.doubles(counted, "subject_key").collect()] == [("a", 2, "subject_key")]


def test_control(spark):
    uid, h, run = "11111111-1111-4111-8111-111111111111", "a" * 64, "b" * 32
    rows = [("start", "completed", run, "", h, "", None), ("resume", "completed", run, h, h, "", None), ("resume", "completed", run, "", h, "", "decision"), ("verify", "completed", run, "", h, "", "outcome for action"), ("start", "awaiting_approval", run, h, "", "", None), ("verify", "verified", run, "", h, "", None), ("start", "blocked", "", "", "", "execution_failed", None), ("start", "blocked", "", "", "", "odd", "error code"), ("start", "odd", "", "", "", "", "outcome"), ("odd", "blocked", "", "", "", "execution_failed", "action")]
    df = table(spark, rows, "a string, o string, run string, d string, b string, e string, want string")
    fault = control.result_fault(F.col("a"), F.col("o"), F.lit(uid), F.lit(h), F.col("run"), F.col("d"), F.col("b"), F.col("e"))
    assert df.filter(~fault.eqNullSafe(F.col("want"))).count() == 0
    img = "r/x@sha256:" + h
    specs = [("pvc", "a/b.toml", h, img, 60, None), ("PVC", "a.toml", h, img, 60, "pvc"), ("pvc", "../a.toml", h, img, 60, "suite path"), ("pvc", "a/../b.toml", h, img, 60, "suite path"), ("pvc", "a.toml", "x", img, 60, "suite digest"), ("pvc", "a.toml", h, "r/x:latest", 60, "image not pinned"), ("pvc", "a.toml", h, img, 29, "deadline"), ("pvc", "a.toml", h, img, 1801, "deadline")]
    df = table(spark, specs, "p string, s string, h string, i string, d int, want string")
    assert df.filter(~control.spec_fault(*map(F.col, "pshid")).eqNullSafe(F.col("want"))).count() == 0
    results = table(spark, [(1, 1, "awaiting_approval"), (1, 2, "completed"), (1, 3, "verified"), (2, 1, "verified"), (2, 2, "completed"), (3, 1, "blocked"), (3, 2, "completed")], "run int, k int, o string")
    got = {(r.run, r.k): r.phase for r in control.phases(results, "run", "k", "o").collect()}
    assert got == {(1, 1): "AwaitingApproval", (1, 2): "Verifying", (1, 3): "Succeeded", (2, 1): "Blocked", (2, 2): "Blocked", (3, 1): "Blocked", (3, 2): "Blocked"}
    v = table(spark, [(1, 1, None, "x"), (1, 2, "x", "x"), (1, 3, "y", "x"), (2, 1, "z", "x")], "k int, o int, v string, p string")
    assert {(r.k, r.o, r.fault) for r in control.write_once(v, "k", "o", "v", "p").collect()} == {(1, 3, "changed"), (2, 1, "not as published")}
    lease = table(spark, [(1, 1, 5), (1, 2, 6), (1, 3, 8)], "k int, o int, n int")
    assert [r.o for r in control.lease_steps(lease, "k", "o", "n").collect()] == [3]


def test_strict_json(spark):
    from provena.operators import records

    rows = [('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}{}', False), ("{},{}", False), ("{}],[{}", False), ('{}},{"b":{}', False), ('{"a":1,"a":2}', False), (' {"a": [1]}\n', True), ("", False), ("1", True)]
    df = table(spark, rows, "t string, want boolean")
    assert df.filter(records.strict_json(F.col("t")).isNotNull() != F.col("want")).count() == 0


def test_records(spark):
    from provena.operators import records

    body = '{"action":"start","agent_run_uid":"","bundle_sha256":"","error_code":"","execution_spec_sha256":"","outcome":"","protocol":"","resume_decision_sha256":"","run_id":"r"}'
    df = table(spark, [(body, None), (body + " ", None), (body.replace('"r"', "1"), "not a text"), ("", "empty"), (None, "empty"), (body[:-1] + ',"x":""}', "fields")], "m string, want string")
    assert df.filter(~records.termination(F.col("m")).eqNullSafe(F.col("want"))).count() == 0
    assert df.select(records.termination_fields(F.col("m")).alias("f")).first().f.run_id == "r"
