"""Texts of megabytes through every operator: nothing is cut, and no operator needs more than time in proportion."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from provena.llm import bpe, decontaminate, html, jaccard, pii, pitmanyor, quality, repeats, sharding, tokencount

BPE, RANKS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


@pytest.fixture(scope="module")
def long(spark):
    """A text of 2 MB without white space, one of 3 MB of words, which ends with a passage of a short one, and its near copy."""
    rng = random.Random(8)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(380_000)]
    words = [" ".join(words[i : i + 14]) for i in range(0, len(words), 14)]
    prose = "\n".join(words)
    rows = [(0, "x" * 2_000_000), (1, f"{prose}\n{PASSAGE}"), (2, f"{prose}\nmore {PASSAGE}"), (3, f"{PASSAGE} and the end")]
    return spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string").repartition(4)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_long_texts_free(long):
    texts = {i: r.text for i, r in by_id(long).items()}
    assert {i: r.size for i, r in by_id(sharding.sharded(long)).items()} == {i: len(t) + 1 for i, t in texts.items()}
    assert {i: r.component_id for i, r in by_id(jaccard.joined(long)).items()} == {0: 0, 1: 1, 2: 1, 3: 3}
    got = by_id(repeats.cleaned(long))
    assert got[0].n_removed == 2_000_000 and got[3].n_removed == len(PASSAGE) and got[1].n_bytes == len(texts[1]) and got[1].n_removed >= len(texts[1]) - 1
    scores = by_id(pitmanyor.scored(long))
    assert scores[0].n_tokens == 2 and scores[1].n_tokens == 380_000 + 61
    coded = by_id(bpe.coded(long.select("doc_id", "text"), BPE))
    assert all(coded[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items())
    assert all(r.n_tokens >= r.n_pretokens > 0 for r in tokencount.counted(long, RANKS).collect())


def test_long_texts_native(spark, long):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    got = by_id(decontaminate.judged(long, items))
    assert {i: r.n_hit for i, r in got.items()} == {0: 0, 1: 60, 2: 60, 3: 60} and [got[i].contaminated for i in range(4)] == [False, False, False, True]
    kept = by_id(quality.quality(long))
    assert kept[1].n_words == 380_000 + 60 and kept[1].kept and not kept[0].kept
    masked = by_id(pii.pseudonymised(long, "key"))
    assert len(masked[0].text) == 2_000_000 and masked[1].n_values == 0


def test_long_page():
    body = "<p>" + "Words of an article that goes on. " * 100_000 + "</p>"
    assert len(html.main_text(f"<body><nav><a href=x>x</a></nav><article>{body}</article></body>")) == 34 * 100_000 - 1
    assert html.main_text("<div>" * 300_000) == "" and html.main_text("<" * 300_000) == "<" * 300_000


def test_operators_of_empty_tables(spark, none, tmp_path):
    assert sharding.sharded(none).count() == 0 and repeats.cleaned(none).count() == 0 and quality.quality(none).count() == 0
    assert html.extracted(none.select("doc_id", F.col("text").alias("html"))).count() == 0
    assert decontaminate.judged(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_clashing_columns(spark, long):
    """Columns named as what operators add or use inside: none is lost, and none changes a result."""
    docs = long.filter("doc_id = 3").select("*", *[F.lit(7).alias(c) for c in ("_text", "_id", "_found", "_new", "_words", "_row", "n_chars", "regions", "cls", "tid")])
    assert by_id(pii.pseudonymised(docs, "key"))[3]._found == 7 and by_id(quality.quality(docs))[3]._words == 7
    assert by_id(jaccard.joined(docs))[3].component_id == 3 and by_id(repeats.cleaned(docs))[3].n_bytes > 0 and by_id(sharding.sharded(docs))[3].slot == 0
    judged = decontaminate.judged(docs.withColumn("items", F.lit(1)), spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")).first()
    assert judged._text == 7 and judged.items == ["1"] and judged.contaminated
    out = corpus_pipeline.pseudonyms(spark, docs, "")
    assert out.columns == docs.columns and out.first()._row == 7
