"""Importance resampling, license scans and fill-in-middle against brute force and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from provena.llm import licenses, middle, resample
from tests.llm.conftest import prose

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")


def words(text):
    return TOKEN.findall(lower(text))


def groups(salt, key):
    digest = hashlib.sha256(f"{salt}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(rows, want):
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


# fill-in-middle


def brute_middle(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h, n = groups(1, key), len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not units or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (key, n, "plain", None, None, sha(text), sha(text))
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{mid}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{mid}"
    return (key, n, form, len(prefix), len(mid), sha(out), sha(text))


def test_middle_against_brute_force(spark, folder, texts):
    got = middle.op13_middle(spark, folder).collect()
    same(got, [brute_middle(r[0], r[1]) for r in texts])
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_middle_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["<", "P", "S", "M", ">", "a", " ", "é", "😀", "\n", "\\", "$1"]) for _ in range(rng.randint(0, 30)))) for i in range(2000)]
    out = middle.arranged(spark.createDataFrame(rows, "doc_id int, text string"), rate=100, spm=50)
    got = {r.doc_id: r for r in out.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()}
    assert all(got[i].back == x for i, x in rows)
    assert all((got[i].form == "plain") == (not x or bool(re.search("<[PSM]>", x))) for i, x in rows)


def test_middle_refuses_what_cannot_be_parsed(spark):
    forms = [("<P>a<S>b<M>c", "psm"), ("<P>a<S>b", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c<M>", "psm"), ("<S>b<P>a<M>c", "spm"), ("<P>a<S>b<M>c", "spm"), ("<P>", "plain"), (None, "psm")]
    df = spark.createDataFrame(forms, "o string, f string").select(middle.restored(F.col("o"), F.col("f")))
    assert [r[0] for r in df.collect()] == ["acb", None, None, None, "acb", None, "<P>", None]
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<S>", ""), ("<P<", "<S>", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            middle.restored(F.col("o"), F.col("f"), bad)


def test_middle_edges(spark, docs, none):
    assert middle.arranged(none).count() == 0
    clash = docs.withColumns({"form": F.lit(1), "_units": F.lit(2), "_row": F.lit(3), "output": F.lit("z"), "n": F.lit(0)})
    out = middle.arranged(clash)
    assert out.columns == ["doc_id", "text", "source", "lang", "n_chars", "_text", "item", "_units", "_row", "n", "form", "output", "prefix_chars", "middle_chars"]
    assert out.filter("_row = 3").count() == docs.count() and out.filter("text IS NULL AND output != ''").count() == 0
    long = spark.createDataFrame([(2, "word, é " * 400_000)], "doc_id int, text string")
    row = middle.arranged(long, rate=100).withColumn("back", middle.restored(F.col("output"), F.col("form")) == F.col("text")).first()
    assert row.back and row.n == 2_000_000


# importance resampling


def brute_resample(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for total, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in features(text):
                total[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    out = []
    for key, text in rows:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        noise = math.floor(-1000 * math.log(-math.log((groups(2024, key)[0] + 0.5) / 4294967296)))
        out.append([key, len(f), weight, weight + noise, None, len(words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def test_resample_against_brute_force(spark, folder, texts):
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = brute_resample([(r[0], r[1]) for r in texts], target)
    got = resample.op11_resample(spark, folder).collect()
    same(got, want)
    assert max(r["rank"] or 0 for r in got) == 10 * sum(len(words(r[1])) >= 20 for r in texts) // 100 > 5


def test_resample_runs_and_ties(spark, texts):
    rows = [(r[0], r[1]) for r in texts] + [(500, texts[0][1])] * 40 + [(None, texts[5][1])] * 3
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(texts[2][1],), (None,)], "body string")
    gain = resample.gains(resample.bucket_totals(docs, "text", 3, 97), resample.bucket_totals(target, "body", 3, 97))
    got = resample.ranked(resample.scored(docs, gain, longest=3), percent=70, least_words=2).select("doc_id", "n_features", "weight", "score", "rank").collect()
    same(got, brute_resample(rows, [texts[2][1]], 3, 97, 2, 70))
    drawn = resample.resampled(docs, target, target_text="body", longest=3, buckets=97, percent=70, least_words=2)
    assert sorted((r.doc_id or -1, r["rank"]) for r in drawn.collect()) == sorted((r.doc_id or -1, r["rank"]) for r in got if r["rank"])


def test_resampling_moves_towards_the_target(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue"] if i % 4 else ["one", "two", "three"]) for _ in range(30))) for i in range(2000)]
    target = spark.createDataFrame([("one two three one three two " * 20,)], "text string")
    drawn = resample.resampled(spark.createDataFrame(rows, "doc_id int, text string"), target)
    near = [r.doc_id % 4 == 0 for r in drawn.select("doc_id").collect()]
    assert len(near) == 200 and sum(near) > 150


def test_resample_edges(spark, docs, none):
    zero = resample.bucket_totals(none, "text", 1, 50)
    assert zero == [0] * 50 and set(resample.gains(zero, zero)) == {0}
    assert resample.ranked(resample.scored(none, [0] * 50)).count() == 0
    clash = docs.withColumns({"score": F.lit("x"), "rank": F.lit("y"), "_words": F.lit("z")}).drop("rank")
    out = resample.ranked(resample.scored(clash, [1] * 50))
    assert out.columns[-5:] == ["n_words", "n_features", "weight", "score", "rank"] and "_words" in out.columns and out.count() == docs.count()
    few = resample.ranked(resample.scored(docs.limit(3), [1] * 50))
    assert few.filter("rank IS NOT NULL").count() == 0


def test_gains_are_a_literal(spark, docs):
    plan = resample.scored(docs, [7] * 10_000)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "Exchange" not in plan and "Generate" not in plan


# license scans


def brute_phrases(text):
    w, out = words(text), []
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    places = [i for i, _ in out]
    return (len(w), len(out), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in out})))


def license_rows():
    rng = random.Random(11)
    body = {t.label: " ".join(t.text.split()) for t in licenses.BODIES}
    edited = body["mit"].split(" ")
    edited[20:20] = ["my", "own"]
    edited[60] = "fork"
    del edited[66:72]
    half = " ".join(body["mit"].split(" ")[:30])
    rows = [
        "Released under the MIT License. CC-BY-NC, cc by nc; CC by NC cc by nc. Apache License, Version 2.0",
        "under the mit  license under the mit license under\nthe MIT\tlicense",
        "under the mitt license, apache licence version 2, cc by nd",
        f"{prose(rng, 80)} {' '.join(edited)} {prose(rng, 60)}",
        f"{prose(rng, 80)} {half} {prose(rng, 60)}",
        f"{prose(rng, 20)}\n{body['apache-2']}\n{prose(rng, 20)}\n{body['bsd']}",
        "licensed under the GNU General Public License, version 3.",
        "licensed under the GNU General Public License, version 30. of the software of the software of the software",
        " ".join([body["mit"]] * 5),
        "of the software and to permit persons to whom the software is " * 300,
        None, "", "cc by", "cc by nc", "É MIT license", prose(rng, 500),
    ]
    return [(i, x) for i, x in enumerate(rows)] + [(0, rows[0]), (None, rows[1])]


def test_license_phrases_against_brute_force(spark, texts):
    rows = license_rows() + [(r[0], r[1]) for r in texts]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    same(got, [(i, *brute_phrases(x)) for i, x in rows])


def test_license_bodies(spark, monkeypatch):
    docs = spark.createDataFrame(license_rows(), "doc_id long, text string")
    for most in (100_000, 0):  # broadcast, then joined by shuffle
        monkeypatch.setattr(licenses, "MOST_RUNS", most)
        monkeypatch.setattr(licenses, "MOST_FOUND", most)
        got = {r.doc_id: (r.labels, round(r.score, 2)) for r in licenses.scanned(docs).filter("doc_id IS NOT NULL").collect()}
        assert got[3][0] == "mit" and 0.85 < got[3][1] < 1 and got[4] == ("", 0.0)
        assert got[5] == ("apache-2,bsd", 1.0) and got[6] == ("gpl-3", 1.0) and got[7] == ("", 0.0) and got[8] == ("mit", 1.0)
        assert all(got[i] == ("", 0.0) for i in (2, 9, 10, 11, 12, 14, 15)) and got[0][0] == "apache-2,cc-by-nc,mit"


def test_license_spans(spark):
    docs = spark.createDataFrame(license_rows(), "doc_id long, text string").filter("doc_id IN (3, 8)")
    got = sorted(licenses.spans(docs, ["doc_id"]).select("doc_id", "label", "first", "last").collect())
    n = len(words(licenses.BODIES[0].text))
    assert [tuple(r) for r in got if r.doc_id == 8] == [(8, "mit", i * n, i * n + n - 1) for i in range(5)]
    (edited,) = [r for r in got if r.doc_id == 3]  # one span across the diagonals of what was put in and left out
    text = words(license_rows()[3][1])
    assert text[edited["first"]] == "permission" and text[edited["last"]] == "software" and edited["last"] - edited["first"] == n - 5


def test_licenses_edges(spark, docs, none):
    assert licenses.scanned(none).count() == 0
    out = licenses.scanned(docs.withColumns({"labels": F.lit(1), "_hs": F.lit(2), "base": F.lit(3), "template": F.lit(4)}))
    assert out.count() == docs.count() and out.columns[7:10] == ["_hs", "base", "template"] and out.columns[-1] == "score"
    with pytest.raises(ValueError):
        licenses.scanned(docs, templates=(licenses.Template("x", "two words"),))
