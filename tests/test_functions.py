from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from provena.functions import canonical, paths, privacy, urls
from provena.functions import identity as I


def rows(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column).collect()]


def test_golden_digests(spark):
    v = F.col("v")
    assert rows(spark, [""], I.sha256(v)) == [I.EMPTY_SHA256]
    assert rows(spark, ['{"a":1}\n'], I.sha256(v)) == ["e346432021b04179518d9614f3560ccd71354a4ee101ddcb893d6959a9d6301c"]
    assert rows(spark, ["metrics.json"], I.quarantine_name(F.lit("evaluate"), F.lit(1), v)) == ["a00000001.45c84ff1f8a5050f7b60a1c98dbed83651847c0c087c117e15d5de52a2e077bb.artifact"]
    assert rows(spark, ["11111111-1111-4111-8111-111111111111"], I.job_name(v, F.lit("start"), F.lit("a" * 64))) == ["agentrun-start-7b6ae9ce04618f1c"]
    assert rows(spark, ["task"], I.log_name(v, F.lit(3), "stdout")) == ["logs/task/attempt-0003.stdout.log"]
    assert rows(spark, ["sha256:" + "a" * 64, "md5:x", None], I.bare_digest(v)) == ["a" * 64, None, None]


def test_same_identity(spark):
    df = spark.createDataFrame([("a", 1, "a", 1), ("a", 1, "a", 2), (None, None, None, None)], "s string, n int, t string, m int")
    assert [r[0] for r in df.select(I.same_identity(*map(F.col, "snt"[:2]), F.col("t"), F.col("m"))).collect()] == [True, False, False]


@pytest.mark.parametrize("text,fault", [('{"a":1}\n', None), ('{"a": 1}\n', "not canonical"), ('{"a":1,"a":2}', "duplicate key"), ("[NaN]", "NaN is not JSON"), ("{", "invalid"), ("[" * 70 + "]" * 70, "too complex"), ('{"b":1,"a":2}\n', "not canonical")])
def test_json_fault(spark, text, fault):
    assert rows(spark, [text], canonical.json_fault(F.col("v"))) == [fault]


def test_canonical_json(spark):
    values = ['{"b": [1, 2.5, "é"], "a": null}', "nope", None, '"\\u001f"']
    want = [json.dumps(json.loads(values[0]), ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n", None, None, '"\\u001f"\n']
    assert rows(spark, values, canonical.canonical_json(F.col("v"))) == want
    assert rows(spark, ['{"a":1}\n', '{"a": 1}\n', "x", None], canonical.native_is_canonical(F.col("v"))) == [True, False, False, False]


def test_paths(spark):
    good, bad = ["a", "a/b.txt", "é/ü", "x" * 1024], ["", "/a", "a/", "a//b", "../a", "a/.", "a\\b", "c:d", "x" * 1025, "a\0b", None]
    assert rows(spark, good + bad, paths.portable(F.col("v"))) == [True] * len(good) + [False] * len(bad)
    assert rows(spark, ["a/b/c", "a", "Straße/É", "STRASSE/E\u0301", "con.txt/x", "a./b"], paths.alias_key(F.col("v"))) == ["a/b/c", "a", "strasse/é", "strasse/é", None, None]
    assert rows(spark, ["a/b/c", "a"], paths.ancestors(F.col("v"))) == [["a", "a/b"], []]
    assert rows(spark, ["＠Ａｌｉｃｅ", "@alice"], paths.subject_key(F.col("v"))) == ["@alice", "@alice"]


def test_url_keys(spark):
    values = ["https://Example.ORG", "https://example.org:443/a#f", "https://example.org:8443/a", "http://example.org/", "https://u@example.org/", "https://example.org/?q=1", "https://localhost/", "https://10.0.0.1/", "https://8.8.8.8/", "https://bücher.example/", "https://a.internal/", "https://example.org:0/"]
    want = ["https://example.org/", "https://example.org/a", "https://example.org:8443/a", None, None, None, None, None, "https://8.8.8.8/", "https://xn--bcher-kva.example/", None, None]
    assert rows(spark, values, urls.url_key(F.col("v"))) == want
    native = rows(spark, values, urls.native_url_key(F.col("v")))
    assert [n for n, w, v in zip(native, want, values, strict=True) if "8.8.8" not in v and "ü" not in v] == [w for w, v in zip(want, values, strict=True) if "8.8.8" not in v and "ü" not in v]


def test_lines_and_dates(spark):
    assert rows(spark, ["ok", " x", "a\nb", "", "y" * 11, None], urls.bounded_line(F.col("v"), 10)) == [True, False, False, False, False, False]
    assert [str(x) if x else None for x in rows(spark, ["2024-02-29", "2023-02-29", "2024-2-9", "x", None], urls.iso_date(F.col("v")))] == ["2024-02-29", None, None, None, None]


def test_privacy_categories(spark):
    values = ["mail a.b@c.de", "éa@b.co", "/home/someone/x", "AKIA" + "A" * 16, "-----BEGIN " + "PRIVATE KEY-----", '"timezone": "Europe/Paris"', "at 2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00+00:00", '"platform_details": "Linux 6.1"', '"platform_details":"linux"', "10.1.2.3", "127.0.0.1 8.8.8.8 1.2.3.4.5 999.1.1.1", "100.64.0.1", "UTC+5", None, ""]
    want = [["non_noreply_email"], ["non_noreply_email"], ["absolute_user_home_path"], ["credential_token_shape"], ["private_key_material"], ["local_timezone_metadata"], ["local_timezone_metadata"], [], ["exact_host_platform_metadata"], [], ["private_or_cgnat_network_address"], [], ["private_or_cgnat_network_address"], ["local_timezone_metadata"], [], []]
    assert rows(spark, values, privacy.categories(F.col("v"))) == want
    assert rows(spark, ["a@b.co"], privacy.categories(F.col("v"), allowed_mail=r"@b\.co$")) == [[]]


def test_execution_spec_digest(spark):
    body = '{"schemaVersion":"v1","pvcName":"p","suitePath":"s.toml","suiteSHA256":"d","runnerImage":"i","activeDeadlineSeconds":60}'
    got = rows(spark, ["p"], I.execution_spec_sha("v1", F.col("v"), F.lit("s.toml"), F.lit("d"), F.lit("i"), F.lit(60)))
    assert got == [hashlib.sha256(body.encode()).hexdigest()]
