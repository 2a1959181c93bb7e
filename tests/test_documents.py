"""Nodes of documents, shapes, seals and bindings; digests against the standard library."""

from __future__ import annotations

import hashlib
import json

import pytest

from provena.functions.flat import Nodes, digests, nodes
from provena.operators import documents as D


def canonical(value) -> str:
    return hashlib.sha256((json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n").encode()).hexdigest()


def at(value, pointer):
    for step in pointer.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        value = value[int(step)] if isinstance(value, list) else value[step]
    return value


def test_nodes_have_the_digests_of_their_subtrees():
    value = {"b~/": [1, -0.0, 1e300, 12345678901234567890123, {"x": None, "": True}], "é ": {"s": "q", "z": "\x07\U0001f600", "": 1, "\U00010000": 2}, "a": []}
    text = json.dumps(value, indent=2)
    found = nodes(text, frozenset(["/é "]), "s")
    assert len({n[0] for n in found}) == len(found) == 15
    for pointer, pattern, parent, above, key, kind, scalar, n, sha, body in found:
        own = at(value, pointer)
        assert sha == canonical(own) and n == (len(own) if isinstance(own, (dict, list)) else 0) and (scalar is None) == isinstance(own, (dict, list))
        assert kind == {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(own)]
        assert body == (canonical({k: v for k, v in own.items() if k != "s"}) if isinstance(own, dict) and "s" in own else None)
        assert parent is None or (pointer.startswith(f"{parent}/") and pattern.startswith(f"{above}/"))
    assert {n[1] for n in found} >= {"/b~0~1/*", "/é /*", "/b~0~1/*/x", "/a"}
    for bad in ('{"a":1,"a":2}', "[NaN]", "[" * 65 + "]" * 65, '"\\ud800"', "", "{} x", None):
        assert nodes(bad, frozenset(), "s") is None


H = "a" * 64
DESCRIPTOR = {"path": "c.json", "media_type": "m", "digest": f"sha256:{H}", "size": 1}
TASK = {"descriptor": DESCRIPTOR, "environment": {"inherit_parent": False, "static_variables": {"V": {"sha256": H, "utf8_size": 3}}, "runner_variables": ["A"]}, "executable": {"basename": "p", "path_sha256": H, "path_utf8_size": 1, "sha256": H, "size": 0}, "process_scope": {"mode": "m", "cooperative": True}}
TASK = {**TASK, "context_sha256": canonical(TASK)}
CONTEXT = {"descriptor": DESCRIPTOR, "tasks": {"t": TASK, "odd/name": TASK}}
CONTEXT = {**CONTEXT, "context_sha256": canonical(CONTEXT)}
TREE = {"tree_sha256": H, "directory_count": 0, "file_count": 1, "total_bytes": 7}
FILE = {"path": "s.toml", "sha256": H, "size": 2}
PLAN = {"run_id": "b" * 32, "schema_version": 3, "suite_file": FILE, "seed_inputs": {"in/x": {"sha256": H, "size": 1}}, "execution_context": CONTEXT, "workspace": {"policy": "p", "root": "w", "manifest": FILE, "baseline": TREE}, "suite": {"tasks": [{"id": "t", "outputs": ["o1", "o2"]}, {"id": "u", "outputs": ["o3"]}]}}
BUNDLE = {**{k: v for k, v in PLAN.items() if k != "suite"}, "kind": "bundle", "created_at": "t", "verified_outputs": [{"task_id": "t", "path": "o1", "sha256": H, "size": 1}, {"task_id": "u", "path": "o3", "sha256": H, "size": 1}], "run_artifacts": [FILE], "final_workspace": TREE}


def changed(**paths):
    out = json.loads(json.dumps(BUNDLE))
    for pointer, value in paths.items():
        *way, last = pointer.split("__")
        holder = out
        for step in way:
            holder = holder[int(step)] if isinstance(holder, list) else holder[step]
        if value is ...:
            del holder[last]
        else:
            holder[int(last) if isinstance(holder, list) else last] = value
    return out


CASES = [
    (BUNDLE, set()),
    (changed(seed_inputs={}), {("/seed_inputs", "seed_inputs")}),
    (changed(workspace=...), {("/workspace", "missing"), ("/workspace", "workspace")}),
    (changed(workspace__baseline__total_bytes=-1), {("/workspace/baseline/total_bytes", "value"), ("/workspace", "workspace")}),
    (changed(final_workspace__file_count=True), {("/final_workspace/file_count", "kind")}),
    (changed(final_workspace__more={"deep": [1]}), {("/final_workspace/more", "unexpected")}),
    (changed(run_artifacts=7), {("/run_artifacts", "kind")}),
    (changed(run_artifacts__0={"path": "a//b", "sha256": H.upper(), "size": 1.0}), {("/run_artifacts/0/path", "value"), ("/run_artifacts/0/sha256", "value"), ("/run_artifacts/0/size", "kind")}),
    (changed(verified_outputs__1__path="o1"), {("/verified_outputs/1", "undeclared")}),
    (changed(verified_outputs=[BUNDLE["verified_outputs"][0]] * 2), {("/verified_outputs/0", "sealed twice"), ("/verified_outputs/1", "sealed twice")}),
    (changed(execution_context__tasks__t__executable__size=1), {("/execution_context/tasks/t", "digest"), ("/execution_context", "digest"), ("/execution_context", "execution_context")}),
    (changed(execution_context__tasks__t__environment__inherit_parent=True), {("/execution_context/tasks/t/environment/inherit_parent", "value"), ("/execution_context/tasks/t", "digest"), ("/execution_context", "digest"), ("/execution_context", "execution_context")}),
]


def test_bundles_of_version_three(spark):
    rows = [(i, json.dumps(b, indent=i % 3), json.dumps(PLAN)) for i, (b, _) in enumerate(CASES)]
    bundles, plans = D.flat(spark.createDataFrame(rows, "run int, b string, p string"), "run", "b"), D.flat(spark.createDataFrame(rows, "run int, b string, p string"), "run", "p")
    found = D.shape_faults(bundles, "run", D.BUNDLES[3]).unionByName(D.seal_faults(bundles, "run")).unionByName(D.binding_faults(bundles, plans, "run")).unionByName(D.undeclared(bundles, plans, "run"))
    got: dict = {i: [] for i in range(len(CASES))}
    for r in found.collect():
        got[r.run].append((r.pointer, r.rule))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(want) for i, (_, want) in enumerate(CASES)}


def test_documents_without_a_partner_and_locks(spark):
    b = D.flat(spark.createDataFrame([(1, json.dumps(BUNDLE)), (2, "{"), (3, None)], "run int, t string"), "run", "t")
    assert [tuple(r) for r in D.binding_faults(b, b.limit(0), "run").collect()] == [(1, "", "unbound")]
    assert sorted((r.run, r.rule) for r in D.shape_faults(b, "run", D.BUNDLES[3]).collect()) == [(2, "json"), (3, "json")]
    lock = {"schema_version": 1, "kind": "k", "run_directory": "/r", "owner_pid": 1, "owner_process_start_token": None, "lock_nonce": "c" * 32}
    texts = [lock, {**lock, "owner_process_start_token": "x" * 512}, {**lock, "owner_process_start_token": "x" * 513}, {**lock, "owner_pid": 0}, {**lock, "host": "h"}, {k: v for k, v in lock.items() if k != "kind"}, [lock]]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(texts)], "run int, t string")
    got = sorted((r.run, r.pointer, r.rule) for r in D.shape_faults(D.flat(df, "run", "t"), "run", D.LOCK).collect())
    assert got == [(2, "/owner_process_start_token", "value"), (3, "/owner_pid", "value"), (4, "/host", "unexpected"), (5, "/kind", "missing"), (6, "", "kind")]


@pytest.mark.parametrize("shape", [*D.BUNDLES.values(), D.LOCK])
def test_shapes_are_tables(shape):
    assert len({x[0] for x in shape}) == len(shape) and all(x[2] in (*D.FORMS, "path") for x in shape)
    assert all(x[0] == "" or x[0].rsplit("/", 1)[0] in {y[0] for y in shape} for x in shape)


def test_texts_are_read_once_and_rules_of_one_document_move_nothing(spark):
    nodes_of = D.flat(spark.createDataFrame([(1, json.dumps(BUNDLE)), (2, "{")], "run int, t string"), "run", "t")
    plan = D.shape_faults(nodes_of, "run", D.BUNDLES[2]).unionByName(D.seal_faults(nodes_of, "run"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "hashpartitioning" not in plan
    root = next(r for r in nodes_of.collect() if r.pointer == "/execution_context")
    assert root.names == ["context_sha256", "descriptor", "tasks"] and root.seal == json.dumps(CONTEXT["context_sha256"])


def test_bundles_beside_their_plans_have_the_faults_of_the_parts(spark, data):
    plans = [json.dumps(PLAN)] * len(CASES) + [None, "{", '{"run_id":1,"run_id":1}', "[]", json.dumps({**PLAN, "suite": {"tasks": [7, [], {"id": 1, "outputs": [1.0, None]}]}})]
    bundles = [b for b, _ in CASES] + [BUNDLE] * 4 + [changed(verified_outputs=[{"task_id": 1, "path": 1.0}, {"size": 1}, {"size": 1}, {}, [1], {"task_id": "t", "path": [1]}])]
    texts = [json.dumps(b, indent=i % 3) for i, b in enumerate(bundles)] + ["{", None, '{"a":1, "a":1}', "7"]
    docs = spark.createDataFrame(list(enumerate(zip(texts, [*plans, *[json.dumps(PLAN)] * 4], strict=True))), "run int, d struct<b: string, p: string>").select("run", "d.*")
    b, p = D.flat(docs, "run", "b"), D.flat(docs.filter("p IS NOT NULL"), "run", "p")
    parts = D.shape_faults(b, "run", D.BUNDLES[3]).unionByName(D.seal_faults(b, "run")).unionByName(D.binding_faults(b, p, "run")).unionByName(D.undeclared(b, p, "run"))
    found = sorted(map(str, D.bundle_faults(docs, "run", "b", "p", D.BUNDLES[3]).collect()))
    assert found == sorted(map(str, parts.collect()))
    n = len(CASES)
    assert {(r.run, r.pointer) for r in parts.filter("rule = 'unbound'").collect()} == {(n + i, "") for i in range(3)}
    assert {r.pointer for r in parts.filter(f"run = {n + 4} AND rule = 'undeclared'").collect()} == {f"/verified_outputs/{i}" for i in (1, 2, 4, 5)}
    assert {r.run for r in parts.filter("rule = 'json'").collect()} == {n + 5, n + 6, n + 7}


def test_of_bundles_only_faults_and_outputs_without_a_declaration_are_written(spark, data):
    from provena.plans import documents as plans

    found = plans.bundle_documents(spark, data)
    written = spark.read.parquet(*found.inputFiles())
    assert found.count() <= written.count() < 2 * spark.read.parquet(f"{data}/orders.parquet").count()
    assert "/suite_file/path" in {r.pointer for r in found.select("pointer").distinct().collect()}


def test_documents_of_one_form_have_their_own_nodes():
    held = Nodes(frozenset(["/m"]), "s", frozenset(["", "/m"]))
    texts = ['{"m":{"%s":1,"b:":"%d"},"s":"x"}', '{"m":{"%s":"1","b:":[]},"s":"x"}', '{"m":{"%s":1,"%s":1},"s":"x"}', '{"m":{"%s":1,"b:":"y:"},"s":[1, {"s":null}]}', '{"m":1e999}', '{"s":"x","m":{"b:":"%d","%s":1}}', '{"\\u006d":1,"m":1}', '[{"%s":"\\u003a","b":":"}]']
    good = [x for i, x in enumerate(texts) if i not in (2, 4, 6)]
    for text in texts:
        assert (held.add(text) is not None) == (text in good) == (digests(text, ("/m", "", "/m/%s", "/0/b"), frozenset()) is not None)
        if text in good:
            value = json.loads(text)
            assert held.told_of == {"": canonical(value)} | ({"/m": canonical(value["m"])} if isinstance(value, dict) else {})
            want = [canonical(value["m"]), canonical(value), canonical(value["m"]["%s"]), None] if isinstance(value, dict) else [None, canonical(value), None, canonical(":")]
            assert digests(text, ("/m", "", "/m/%s", "/0/b"), frozenset())[0] == want
    columns = held.arrow(("pointer", "body_sha256", "seal", "names"))
    got = list(zip(*(columns[x].to_pylist() for x in ("pointer", "kind", "value", "body_sha256", "seal", "names")), strict=True))
    want = [n for text in good for n in nodes(text, frozenset(["/m"]), "s")]
    assert [(x[0], x[1], x[2], x[3]) for x in got] == [(n[0], n[5], n[6], n[9]) for n in want]
    assert [x[5] for x in got if x[0] == "/m"] == [["%s", "b:"]] * 4 and [x[4] for x in got if x[0] == "" and x[1] == "object"] == ['"x"', '"x"', None, '"x"']
