from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from provena.errors import BoundaryError, ConfigurationError, EvidenceError, TaskError
from provena.runner import Runner, Step
from provena.sources import readers, sinks

BROKEN = {"on": False}


def double(spark, tables):
    return {"features": tables["numbers"].withColumn("x", F.col("x") * 2)}


def total(spark, tables):
    if BROKEN["on"]:
        raise ValueError("once")
    return {"metrics": tables["features"].agg(F.count("*").alias("n"), F.sum("x").alias("s"))}


def steps():
    return [Step("prepare", double, ("numbers",), ("features",)), Step("evaluate", total, ("features",), ("metrics",))]


def runner(spark, tmp_path):
    return Runner(spark, f"file://{tmp_path}/run", steps(), {"numbers": spark.range(1, 5).select(F.col("id").alias("x"))})


def test_run_verify_and_repeat(spark, tmp_path):
    r = runner(spark, tmp_path)
    assert r.start() == {"tasks": 2, "outputs": 2, "attempts": 2, "events": 6}
    assert tuple(spark.read.parquet(f"{r.root}/data/metrics").first()) == (4, 20)
    assert r.inspect()["action"] == "already-complete" and r.resume() == r.verify()
    with pytest.raises(EvidenceError):
        r.start()


def test_recovery_skips_the_sealed_prefix(spark, tmp_path):
    r = runner(spark, tmp_path)
    BROKEN["on"] = True
    with pytest.raises(TaskError):
        r.start()
    BROKEN["on"] = False
    d = r.inspect()
    assert d["action"] == "recover-and-resume" and d["completed_prefix"] == ["prepare"] and d == r.inspect()
    with pytest.raises(EvidenceError):
        r.resume("0" * 64)
    assert d == r.inspect()
    assert r.resume(d["decision_sha256"])["attempts"] == 3


def test_drift_is_found(spark, tmp_path):
    r = runner(spark, tmp_path)
    r.start()
    spark.range(3).write.mode("overwrite").parquet(f"{r.root}/data/features")
    with pytest.raises(EvidenceError):
        r.verify()


def test_pending_event_is_reconciled(spark, tmp_path):
    r = runner(spark, tmp_path)
    BROKEN["on"] = True
    with pytest.raises(TaskError):
        r.start()
    BROKEN["on"] = False
    state = r._state()
    event = {"type": "run_resumed", "sequence": state["count"] + 1, "previous_sha256": state["log_sha256"], "run_id": state["run_id"], "details": {}}
    sinks.put_json(spark, f"{r.root}/state.json", state | {"pending": event}, replace=True)
    assert r.transition() == "pending_before_log"
    with pytest.raises(EvidenceError):
        r.inspect()
    assert r.reconcile() == "pending_before_log" and r.transition() == "stable"


def test_steps_are_checked(spark, tmp_path):
    with pytest.raises(ConfigurationError):
        Runner(spark, "x", [Step("a", total, ("features",), ("metrics",))])


SUITE = 'version = 1\nname = "n"\n[[task]]\nid = "a"\nargv = ["x"]\ninputs = ["i"]\noutputs = ["o"]\n'


@pytest.mark.parametrize("change,error", [("", None), ("extra = 1\n", ConfigurationError), ('[[task]]\nid = "a"\nargv = ["x"]\n', ConfigurationError), ('[[task]]\nid = "b"\nargv = ["x"]\noutputs = ["o"]\n', ConfigurationError), ('[[task]]\nid = "b"\nargv = ["x"]\ninputs = ["../x"]\n', BoundaryError), ('[[task]]\nid = "b"\nargv = ["x"]\ninputs = ["o/p"]\n', ConfigurationError)])
def test_suites(change, error):
    text = change + SUITE if change.startswith("extra") else SUITE + change
    if error is None:
        assert readers.parse_suite(text)["task"][0]["id"] == "a"
    else:
        with pytest.raises(error):
            readers.parse_suite(text)


def test_sinks_and_sources(spark, tmp_path):
    df = spark.range(5)
    root = f"file://{tmp_path}"
    first = sinks.publish(df, f"{root}/t")
    assert first == sinks.table_identity(df.repartition(3)) and first["n"] == 5
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.publish(df, f"{root}/t")
    assert sinks.append(spark.range(3), f"{root}/log", ["id"]) == 3 and sinks.append(spark.range(5), f"{root}/log", ["id"]) == 2
    assert sinks.quarantine(df, spark.range(2), ["id"], f"{root}/q").count() == 3
    sinks.replace(df, f"{root}/v")
    sinks.replace(spark.range(2), f"{root}/v")
    assert sinks.current(spark, f"{root}/v").count() == 2
    with pytest.raises(EvidenceError):
        sinks.message({"a": "b"})
    (tmp_path / "SUMS").write_text("a" * 64 + "  x.txt\nbad\n")
    assert [r.path for r in readers.checksum_list(spark.read.text(f"{root}/SUMS")).collect()] == ["x.txt", None]
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.txt", "hi")
    assert [(r.member, bytes(r.data)) for r in readers.archive_members(spark, f"{root}/a.zip").collect()] == [("m.txt", b"hi")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("large.txt", "x" * 100)
    assert [(r.member, r.size, r.data) for r in readers.archive_members(spark, f"{root}/b.zip", 99).collect()] == [("large.txt", 100, None)]


def test_torn_logs_and_limits(spark, tmp_path):
    (tmp_path / "whole.jsonl").write_bytes(b'{"a":1}\n{"a":"\xc3\xa9"}\r\n')
    (tmp_path / "torn.jsonl").write_bytes(b'{"a":1}\n{"a"')
    lines = readers.event_lines(spark, f"file://{tmp_path}/*.jsonl")
    assert [r.path.rsplit("/", 1)[1] for r in readers.torn(lines).collect()] == ["torn.jsonl"]
    assert {r.line for r in lines.filter("path like '%whole%'").collect()} == {'{"a":1}\n', '{"a":"é"}\r\n'}
    assert readers.files(spark, f"file://{tmp_path}", 25).count() == 2
    with pytest.raises(Exception, match="more than 10 bytes"):
        readers.files(spark, f"file://{tmp_path}", 10).collect()
    assert [r.path for r in readers.directories(spark.createDataFrame([("a/b/c",), ("a/d",)], "path string")).orderBy("path").collect()] == ["a", "a/b"]
    assert readers.over_limit(spark.range(5), 4) and not readers.over_limit(spark.range(5), 5)


def test_documents_bound_to_an_identity(spark, tmp_path):
    import hashlib

    from provena.functions.canonical import encode

    text = encode({"schema_version": 1, "kind": "tree", "entries": [{"kind": "file", "path": "a", "sha256": "0" * 64, "size": 1}]})
    (tmp_path / "m.json").write_text(text)
    where, sha = f"file://{tmp_path}/m.json", hashlib.sha256(text.encode()).hexdigest()
    assert [tuple(r) for r in readers.manifest_document(spark, where, sha, len(text)).collect()] == [("file", "a", "0" * 64, 1)]
    with pytest.raises(EvidenceError):
        readers.manifest_document(spark, where, "1" * 64, len(text))
    import json

    ledger = {"schema_version": 1, "as_of_date": "2024-01-01", "counts": {}, "records": [{"id": "EXT-2024-0001", "kind": "independent_user"}]}
    (tmp_path / "l.json").write_text(json.dumps(ledger, indent=2, sort_keys=True) + "\n")
    rest, rows = readers.ledger_document(spark, f"file://{tmp_path}/l.json")
    assert rest["as_of_date"] == "2024-01-01" and [r.id for r in rows.collect()] == ["EXT-2024-0001"]
    (tmp_path / "l2.json").write_text(json.dumps(ledger))
    with pytest.raises(EvidenceError):
        readers.ledger_document(spark, f"file://{tmp_path}/l2.json")


def test_one_writer_at_a_time(spark, tmp_path):
    r = runner(spark, tmp_path)
    r.start()
    sinks.put_text(spark, f"{r.root}/LOCK", "other")
    with pytest.raises(EvidenceError):
        r.resume()
    assert r.inspect_lock() == "other"
    with pytest.raises(EvidenceError):
        r.break_lock("wrong")
    r.break_lock("other")
    assert r.inspect_lock() is None and r.resume() == r.verify()


def test_published_rows_are_compared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "table_identity", lambda df: {"n": 0, "a": "0", "b": "0"})
    with pytest.raises(EvidenceError):
        sinks.publish(spark.range(3), f"file://{tmp_path}/t")
    sinks.put_text(spark, f"file://{tmp_path}/s", "a")
    sinks.put_text(spark, f"file://{tmp_path}/s", "b", replace=True)
    assert sinks.get_text(spark, f"file://{tmp_path}/s") == "b"
    with pytest.raises(EvidenceError):
        sinks.put_text(spark, f"file://{tmp_path}/s", "c")
    assert sinks.append(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), f"file://{tmp_path}/log", ["k"]) == 1
