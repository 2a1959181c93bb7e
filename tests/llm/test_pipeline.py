from __future__ import annotations

import collections
import random
import re

import corpus_pipeline
from tests.llm.conftest import prose


def test_stages_on_the_smallest_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        path = f"{corpus_pipeline.written(out).provena_path}"
        docs = spark.read.parquet(path)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > seen[0] // 2
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert ids.count() == seen[-1] and all(r.n_tokens == len(r.ids) for r in ids.limit(5).collect())


def test_near_duplicates_keep_one_of_each_group(spark, docs, data):
    out = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()]
    assert 0 in out and not {36 + 1, 36 + 2} & set(out) and len(out) == len(set(out))


def test_empty_documents(spark, none, data):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).count() == 0


def test_copies_do_not_make_their_own_lines_boilerplate(spark, data):
    rng = random.Random(3)
    copy, spread = prose(rng, 90), prose(rng, 90)
    rows = [(i, copy if i < 31 else prose(rng, 90), "h") for i in range(300)]
    rows += [(1000 + i, spread if i % 3 == 0 else prose(rng, 90), f"s{i % 2}") for i in range(240)]
    docs = spark.createDataFrame([(i, x, h, "en", len(x)) for i, x, h in rows], "doc_id long, text string, source string, lang string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, data).collect()}
    assert kept >= set(range(31)) | set(range(1000, 1240, 3)) and len(kept) > 500


def test_boilerplate_lines_do_not_go_on(spark, data):
    rng = random.Random(5)
    texts = [prose(rng, 90) for _ in range(45)]
    rows = [(i, f"All rights, reserved.\n\n{x}\nall RIGHTS reserved\n", "h", "en", 0) for i, x in enumerate(texts)] + [(100, texts[0] + "\nAll rights, reserved.", None, "en", -1), (101, None, "h", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int")
    got = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, docs, data).collect()}
    assert {i: r.text for i, r in got.items()} == {i: f"\n{x}\n" for i, x in enumerate(texts)} | {100: rows[45][1]}
    assert all(got[i].n_chars == len(x) + 2 for i, x in enumerate(texts)) and got[100].n_chars == -1


def test_near_duplicates_drop_by_id_and_text(spark, data):
    rng = random.Random(11)
    a, b, c, d, e, f = (prose(rng, 120) for _ in range(6))
    near = lambda x, k: f"{x} w{k}"
    rows = [(1, a), (None, near(a, 1)), (None, b), (None, near(b, 1)), (None, c), (None, c), (3, d), (5, near(d, 1)), (5, e), (9, near(e, 1)), (7, f), (7, f)]
    docs = spark.createDataFrame([(i, x, "h", "en", len(x)) for i, x in rows], "doc_id long, text string, source string, lang string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()]
    lone = next(x for i, x in got if i is None and x.startswith(b))  # one of two near copies without an id
    assert sorted(got, key=str) == sorted([(1, a), (None, lone), (None, c), (3, d), (5, e), (7, f)], key=str)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_quality(rows):
    """Base rules of each text, then lines over their host's limit by distinct texts, then what is left."""
    texts = collections.defaultdict(set)
    for r in rows:
        texts[r["source"]].add(r["text"] or "")
    normal = lambda line: re.sub(r"[\W_]+", " ", line.lower()).strip()
    hot = {}
    for host, own in texts.items():
        n = collections.Counter(x for t in own for x in {normal(line) for line in t.split("\n")} - {""})
        hot[host] = {x for x, k in n.items() if k > max(20, 0.1 * len(own))}
    out = []
    for r in rows:
        ws = words(r["text"])
        grams = collections.defaultdict(list)
        for i in range(len(ws) - 2):
            grams[tuple(ws[i : i + 3])].append(i)
        again = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(3)}
        if len(ws) < 50 or 100 * len(again) > 50 * len(ws):
            continue
        lines = [(line, normal(line)) for line in r["text"].split("\n")]
        gone = sum(len(n) for _, n in lines if n in hot[r["source"]])
        if not gone:
            out.append(r)
        elif 1 - gone / sum(len(n) for _, n in lines) >= 0.3:
            text = "\n".join(line for line, n in lines if n not in hot[r["source"]])
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def brute_near(rows):
    sets = []
    for r in rows:
        ws = words(low(r["text"]))
        sets.append(frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else []))
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, s in enumerate(sets):
        for j, common in collections.Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * common >= 80 * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i]["doc_id"]):
        first.setdefault(find(i), i)
    return [r for i, r in enumerate(rows) if not sets[i] or first[find(i)] == i]


def brute_clean(rows, items):
    cut = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for _, text in items:
        ws = cut.findall(low(text))
        windows |= {tuple(ws[i : i + 13]) for i in range(max(1, len(ws) - 12)) if ws}
    sizes, out = {len(w) for w in windows}, []
    for r in rows:
        ws = cut.findall(low(r["text"]))
        hit = {i + j for n in sizes for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(ws):
            out.append(r)
    return out


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages_against_brute_force(spark, data):
    """Quality rules, near duplicates and decontamination by their definitions; pseudonyms by their inverse; ids by the library."""
    from tokenizers import Tokenizer

    import public_tokenizers
    from provena.llm import pii

    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    steps = [brute_quality, brute_near, lambda rows: brute_clean(rows, items)]
    rows = [r.asDict() for r in docs.collect()]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:3], steps, strict=True):
        docs = corpus_pipeline.written(stage(spark, docs, data))
        rows = brute(rows)
        got = {r.doc_id: r.asDict() for r in docs.collect()}
        assert got == {r["doc_id"]: r for r in rows} and len(got) == len(rows), name
    masked = corpus_pipeline.written(corpus_pipeline.pseudonyms(spark, docs, data))
    back = {r.doc_id: r.text for r in pii.pseudonymised(masked, pii.DEMO_KEY, inverse=True).collect()}
    assert back == {r["doc_id"]: r["text"] for r in rows}
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = {r.doc_id: r.text for r in masked.collect()}
    for r in corpus_pipeline.token_ids(spark, masked, data).collect():
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
