"""Operators 2 and 4 to 9: brute force, exact round trips, held-out accuracy and edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
import xxhash

import public_tokenizers
from provena.llm import bpe, html, jaccard, pitmanyor, repeats, sharding, suffix, tokencount

BPE, RANKS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_shards(spark, folder, texts):
    got = sharding.op2_shards(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in texts)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))
    of = collections.defaultdict(set)
    for r in got:
        of[r.text_crc32, r.size].add(r.shard)
    assert all(len(v) == 1 for v in of.values())


def test_shards_against_brute_force(spark, data):
    """Groups and bundles placed one by one, in plain Python; the shards' bytes are near equal."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows, grain, shards = [(r.doc_id, r.text or "") for r in docs.collect()], 64, 8
    got = {r.doc_id: r.shard for r in sharding.sharded(docs, grain=grain).collect()}
    group = collections.defaultdict(lambda: [0, 0, 0])
    name = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    for i, t in rows:
        for k, x in enumerate((len(t.encode()) + 1, len(re.findall("[^\x20\x09-\x0d]+", t)), 1)):
            group[name[i]][k] += x
    total = [sum(g[k] for g in group.values()) for k in range(3)]

    def unit(h):
        if group[h][0] > total[0] / grain:
            return h
        x = xxhash.xxh64_intdigest(h.encode(), seed=42)
        return f"b{(x - (1 << 64) if x >> 63 else x) % grain}"

    units = collections.defaultdict(lambda: [0, 0, 0])
    for h, v in group.items():
        units[unit(h)] = [a + b for a, b in zip(units[unit(h)], v, strict=True)]
    need = {u: [x * shards / t for x, t in zip(v, total, strict=True)] for u, v in units.items()}
    room, where = [[1.0] * 3 for _ in range(shards)], {}
    for u in sorted(sorted(need), key=lambda u: -max(need[u])):
        fits = [s for s in range(shards) if room[s][0] >= need[u][0]]
        best = max(fits, key=lambda s: (round(sum(a * b for a, b in zip(room[s], need[u], strict=True)), 12), -s)) if fits else max(range(shards), key=lambda s: (room[s][0], -s))
        where[u] = best
        room[best] = [a - b for a, b in zip(room[best], need[u], strict=True)]
    assert got == {i: where[unit(name[i])] for i, _ in rows}
    sizes = collections.Counter()
    for r in sharding.sharded(docs).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8 + max(len(t) for _, t in rows)


def test_bin_packing_is_near_equal():
    rng = np.random.default_rng(1)
    v = np.column_stack([rng.lognormal(7, 1, 3000), rng.lognormal(5, 1, 3000), np.ones(3000)])
    where = sharding.place(v, 8)
    sums = np.array([v[where == s].sum(axis=0) for s in range(8)])
    assert (sums.max(axis=0) / sums.mean(axis=0) < 1.02).all()
    assert len(sharding.place(np.zeros((0, 3)), 8)) == 0


def brute_repeats(rows, n=200):
    count = collections.Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for d, b in data:
        m = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                m[i : i + n] = b"\1" * n
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out.append((d, len(b), sum(m), sum(1 for i, y in enumerate(m) if y and (i == 0 or not m[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("most", [repeats.MOST, 1])
def test_repeats_against_brute_force(spark, folder, texts, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST", most)
    got = sorted((tuple(r) for r in repeats.op4_repeats(spark, folder).collect()), key=key)
    assert got == brute_repeats([(r[0], r[1]) for r in texts])


def test_repeats_of_nothing(none):
    assert repeats.cleaned(none).count() == 0


def test_suffix_order_and_prefixes(monkeypatch, tmp_path):
    rng = random.Random(3)
    for k in range(120):
        depth = rng.choice([8, 16, 200])
        letters = rng.choice([b"ab", b"abcd", b"the quick", bytes(range(1, 256))])
        t = bytes(rng.choice(letters) for _ in range(rng.randint(1, 200)))
        t += t[: rng.randint(0, len(t))]
        monkeypatch.setattr(suffix, "IN_MEMORY", 64 if k % 3 == 0 else 4 << 20)
        order, prefix = suffix.ordered(np.frombuffer(t, np.uint8), depth, f"file://{tmp_path}/q")
        assert sorted(order.tolist()) == list(range(len(t)))
        heads = [t[p : p + depth] for p in order]
        assert all(a <= b for a, b in itertools.pairwise(heads))
        want = [0] + [next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for a, b in itertools.pairwise(heads)]
        assert prefix.tolist() == want
    assert not list((tmp_path / "q").iterdir())


def test_queues_of_a_shard_larger_than_memory(monkeypatch, tmp_path):
    """A shard of a hundred times the memory that queues may take: most tuples pass the disk, and the order is the same."""
    rng, spilled, held = random.Random(9), [], []
    t = np.frombuffer("".join(rng.choice(["the ", "of ", "and ", "ing ", "xyz "]) for _ in range(60_000)).encode(), np.uint8)
    want = suffix.ordered(t)
    spill, push = suffix.Queues._spill, suffix.Queues.push

    def spied(self):
        spilled.append(self.held)
        spill(self)

    def watched(self, *args):
        push(self, *args)
        held.append(self.held)

    monkeypatch.setattr(suffix.Queues, "_spill", spied)
    monkeypatch.setattr(suffix.Queues, "push", watched)
    monkeypatch.setattr(suffix, "IN_MEMORY", len(t) // 100)
    got = suffix.ordered(t, folder=f"file://{tmp_path}/q")
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and sum(spilled) > 2 * len(t) and max(held) <= suffix.IN_MEMORY
    assert not list((tmp_path / "q").iterdir())


def test_language_model(spark, folder, texts):
    got = pitmanyor.op5_scores(spark, folder).collect()
    token = {i: [*re.findall("[^\x20\x09-\x0d]+", low(t)), None] for i, (_, t, *_) in enumerate(texts)}
    held = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for i, (d, *_) in enumerate(texts)}
    c = collections.Counter(w for i, ws in token.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((texts[i][0], held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in token.items())
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_of_nothing(spark, none):
    assert pitmanyor.scored(none).count() == 0
    lone = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = pitmanyor.scored(lone).first()
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score)


def test_sweeps_see_the_totals_of_the_sweep_before(docs, monkeypatch):
    seen, after = [], pitmanyor.after_sweep

    def spied(found, t, k):
        out = after(found, t, k)
        seen.append((k, int(t["tables"].sum()), t["of_root"], t["root"], int(out["tables"].sum()), out["of_root"]))
        return out

    monkeypatch.setattr(pitmanyor, "after_sweep", spied)
    assert pitmanyor.scored(docs).count() == docs.count()
    assert [x[0] for x in seen] == list(range(pitmanyor.BURN + pitmanyor.SAMPLES)) and all(a == b and c == d for _, a, b, _, c, d in seen)
    assert all(x[4] == y[1] for x, y in itertools.pairwise(seen)) and seen[1][1] > seen[0][1] and len({x[1] for x in seen}) > 2 and seen[1][3] > seen[0][3]


def restaurants(count, row, context, n, wide, frequent=()):
    """Totals before the first sweep, with one table per pair; ``frequent`` rows are shared."""
    f = np.array(frequent, np.int64)
    return {
        "tables": np.bincount(context, minlength=wide), "customers": np.bincount(context, count, minlength=wide), "discount": 0.7, "strength": 3.0, "root": n, "of_root": len(row), "uniform": 1 / (n + 1), "n": int(count.sum()), "v": n, "n_contexts": wide,
        "f_words": f.astype(np.uint64), "f_seen": np.bincount(row, count, minlength=n)[f].astype(np.int64), "f_of_root": np.bincount(row, minlength=n)[f], "f_root": np.ones(len(f), np.int64),
    }


@pytest.mark.parametrize("frequent", [(), (3, 7)])
def test_probabilities_sum_to_one(frequent):
    rng = np.random.default_rng(1)
    row, context = np.repeat(np.arange(50), 4), np.tile(np.arange(4), 50)
    count = rng.integers(1, 30, 200)
    shared = np.full(50, -1)
    shared[list(frequent)] = np.arange(len(frequent))
    sampler = pitmanyor.Sampler(shared, row, context, count, restaurants(count, row, context, 50, 4, frequent), 0)
    totals = sampler.run()
    unknown = pitmanyor.root_back(totals) / (10.0 + totals["of_root"])
    assert abs(pitmanyor.Sampler(shared, row, context, count, totals, 0, (sampler.of_root, sampler.root, 0, [], [])).parent().sum() + unknown - 1) < 1e-9
    words, *pairs, (_, _, mean, customers, roots) = pitmanyor._loaded(sampler.saved(np.arange(50).astype(np.uint64)))
    assert all((a == b).all() for a, b in zip(pairs, (row, context, count), strict=True)) and np.allclose(mean, sampler.mean)
    scorer = pitmanyor.Scorer(words, *pairs, mean, customers, roots, totals)
    for u in range(4):
        p, _, known = scorer.score(np.append(words, np.uint64(99)), np.full(51, u))
        assert known[:50].all() and not known[50]
        assert abs((10.0**p).sum() - 1) < 1e-6


def plain_sampler(train, sweeps, rng, discount, strength):
    """Customer by customer, table by table: seats of every restaurant as lists of table sizes; mean log10 probability of a text's tokens."""
    words = sorted({w for ws in train for w in ws})
    pairs = [(u, w) for ws in train for u, w in zip(["<s>", *ws], ws, strict=False)]
    seats, root = {}, {}
    total, dishes = collections.Counter(), collections.Counter()
    d0, s0 = pitmanyor.ROOT_DISCOUNT, pitmanyor.ROOT_STRENGTH

    def base(w):
        n, t = sum(root.get(w, [])), len(root.get(w, []))
        return (n - d0 * t + (s0 + d0 * total["root tables"]) / (len(words) + 1)) / (s0 + total["root"])

    def join(tables, weights_new, d):
        weights = [n - d for n in tables] + [weights_new]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return tables[k] == 1

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def seat(u, w):
        if join(seats.setdefault((u, w), []), (strength + discount * dishes[u]) * base(w), discount):
            dishes[u] += 1
            if join(root.setdefault(w, []), (s0 + d0 * total["root tables"]) / (len(words) + 1), d0):
                total["root tables"] += 1
            total["root"] += 1

    def rise(u, w):
        if leave(seats[u, w]):
            dishes[u] -= 1
            total["root"] -= 1
            if leave(root[w]):
                total["root tables"] -= 1

    customers = collections.Counter(u for u, _ in pairs)
    for u, w in pairs:
        seat(u, w)
    out = collections.Counter()
    for k in range(sweeps):
        for u, w in pairs:
            rise(u, w)
            seat(u, w)
        if k >= sweeps // 2:
            for u, w in set(pairs):
                own = seats[u, w]
                out[u, w] += (sum(own) - discount * len(own) + (strength + discount * dishes[u]) * base(w)) / (strength + customers[u]) / (sweeps - sweeps // 2)
    return out, pairs


def test_scores_against_a_plain_sampler(spark, monkeypatch):
    """Probabilities of seen pairs on a small corpus: near those of a sampler that moves single customers between tables."""
    monkeypatch.setattr(pitmanyor, "LEAST", 1)
    rng = random.Random(5)
    texts = [[rng.choice("aabbbcdefgh") * rng.choice([1, 1, 2]) for _ in range(rng.randint(8, 25))] for _ in range(60)]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(texts)]
    got = {r.doc_id: r for r in pitmanyor.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [[*ws, "</s>"] for i, ws in enumerate(texts) if not got[i].held_out]
    seen, pairs = collections.Counter(), [(u, w) for ws in train for u, w in zip(["<s>", *ws], ws, strict=False)]
    count = collections.Counter(pairs)
    singles, doubles = sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
    discount = min(0.95, max(0.1, singles / max(1, singles + 2 * doubles)))
    tables, customers = collections.Counter(u for u, _ in count), collections.Counter(u for u, _ in pairs)
    strength = pitmanyor._strength(np.array([tables[u] for u in tables]), np.array([customers[u] for u in tables]), discount)
    p, _ = plain_sampler(train, 60, random.Random(1), discount, strength)
    for i, ws in enumerate(texts):
        if not got[i].held_out:
            want = sum(math.log10(p[pair]) for pair in zip(["<s>", *ws], [*ws, "</s>"], strict=True))
            seen[i] = abs(got[i].score - want) / abs(want)
    assert len(seen) > 40 and max(seen.values()) < 0.05 and sum(seen.values()) / len(seen) < 0.02


def test_more_words_have_their_own_context_in_a_larger_corpus(spark, monkeypatch):
    sizes, contexts = [], pitmanyor.Contexts

    def spied(often, own):
        sizes.append(len(own))
        return contexts(often, own)

    monkeypatch.setattr(pitmanyor, "Contexts", spied)
    for n in (20, 200):
        rng = random.Random(n)
        rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(60))) for i in range(n)]
        assert pitmanyor.scored(spark.createDataFrame(rows, "doc_id long, text string")).count() == n
    assert max(sizes[: len(sizes) // 2]) * 2 < max(sizes)


def test_bpe_is_the_library(texts):
    from tokenizers import Tokenizer

    ours, theirs = bpe.Encoder(bpe.vocabulary(BPE)), Tokenizer.from_file(BPE)
    rng = random.Random(5)
    letters = ["a", " ", "  ", "\n", "é", "0", "12", "'s", "<|endoftext|>", "the", "ing", ".", "\t", "😀", "中", "\x1c", " ", "AAAA", "!!"]
    many = [t or "" for _, t, *_ in texts] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t, e in zip(many, theirs.encode_batch(many, add_special_tokens=False), strict=True):
        ids = ours.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert ours.decode(ids) == theirs.decode(e.ids, skip_special_tokens=False) == t


def test_bpe_query(spark, folder, texts, none):
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.op6_bpe(spark, folder).collect()}
    assert {(d, h) for d, _, h in got} == {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in texts}
    assert bpe.coded(none, BPE).count() == 0
    row = bpe.coded(none.sparkSession.createDataFrame([(1, "the")], "doc_id long, text string"), BPE, digests=False).first()
    assert (row.n_tokens, row.decoded) == (len(row.ids), "the")


def brute_links(rows, k, percent):
    sets, ids = {}, collections.defaultdict(list)
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        s = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        ids[s].append(d)
        sets[s] = s
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in itertools.combinations([s for s in sets if s], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for s, own in ids.items():
        least[find(s)] += own
    name = {s: min((d for d in least[find(s)] if d is not None), default=None) for s in sets}
    return sorted(((d, len(s), name[s] if s else d) for s, own in ids.items() for d in own), key=key)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join_against_brute_force(docs, texts, k, percent):
    got = sorted((tuple(r) for r in jaccard.joined(docs, k=k, percent=percent).drop("stays").collect()), key=key)
    assert got == brute_links([(r[0], r[1]) for r in texts], k, percent)


def near_groups(n, seed=3):
    """Two texts and many copies of each with words put in, taken out or changed: some linked, most not, none of them with unique edits."""
    rng = random.Random(seed)
    rows = []
    for g in range(2):
        base = [rng.choice("abcdefghij") + rng.choice("klmnopqr") + str(rng.randint(0, 9)) for _ in range(120)] + ["shared", "end", "of", "all"] * 4
        for _ in range(n):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [rng.choice(["xx", "yy"])] * rng.randint(0, 2)
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("k,percent,small,dense,depth", [(3, 90, 8, 32, 4), (3, 90, 1, 0, 2), (5, 80, 1, 0, 1), (5, 80, 1, 10**6, 4)])
def test_jaccard_join_of_near_groups(spark, k, percent, small, dense, depth, monkeypatch):
    for name, value in {"SMALL": small, "DENSE": dense, "DEPTH": depth, "PIVOTS": 2, "PACK": 3000, "FEW_EDGES": 0 if depth == 1 else 10**6}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_groups(50)
    got = sorted((tuple(r) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent).drop("stays").collect()), key=key)
    assert got == brute_links(rows, k, percent)


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW_EDGES", few)
    rng = random.Random(few)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 190), rng.randint(100, 190)) for _ in range(60)] + [(7, 7)]
    got = {r.cls: r.comp for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    # a node that is the least of its component may be left out
    assert {x: got.get(x, x) for x in want} == want


def test_reach_of_deviations():
    """Any two linked sets, one of them not linked with the pivot, share one of the first elements of their deviations."""
    rng = random.Random(1)
    seen = 0
    for _ in range(30_000):
        percent = rng.choice([50, 80, 90])
        p = frozenset(rng.sample(range(60), rng.randint(5, 40)))

        def near(s, n):
            return s ^ frozenset(rng.sample(range(60), rng.randint(0, n)))

        x = near(p, 16)
        y = near(x, 5)
        if x and y and x != y and 100 * len(x & y) >= percent * len(x | y) and 100 * len(x & p) < percent * len(x | p) and y != p:
            seen += 1
            dx, dy = ([*sorted(s - p), *sorted(p - s)] for s in (x, y))
            lx, ly = jaccard.reach(len(dx), len(x), len(p), percent)[0], jaccard.reach(len(dy), len(y), len(p), percent)[1]
            common = (len(dx) + len(dy) - (100 - percent) * (len(x) + len(y)) // (100 + percent) + 1) // 2
            assert set(dx[: min(lx, len(dx) - common + 1)]) & set(dy[: min(ly, len(dy) - common + 1)])
    assert seen > 500


def test_regions_of_two_classes_or_more():
    rng = np.random.default_rng(2)
    r, c = rng.integers(0, 40, 300).astype(np.uint64), np.zeros(300, jaccard.OWNER)
    c["cls"] = rng.integers(0, 12, 300)
    state, got = jaccard.Shared(), set()
    for a in range(0, 300, 37):
        found = state.found(r[a : a + 37], c[a : a + 37], np.zeros(len(r[a : a + 37]), bool))
        got |= set(zip(found[0].tolist(), found[1]["cls"].tolist(), strict=True))
    kinds = collections.defaultdict(set)
    for x, y in zip(r.tolist(), c["cls"].tolist(), strict=True):
        kinds[x].add(y)
    assert got == {(x, y) for x, ys in kinds.items() if len(ys) > 1 for y in ys} and len(state.r) == len(kinds)


def test_linked_sets_share_the_regions_they_need():
    rng = np.random.default_rng(3)
    seen = 0
    for _ in range(1500):
        percent, cache = int(rng.choice([50, 80, 90])), {}
        x = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 120)).astype(np.uint64))
        gone = x[rng.random(len(x)) < rng.random() * 0.3]
        y = np.unique(np.concatenate([np.setdiff1d(x, gone), rng.integers(0, 1 << 60, rng.integers(0, 1 + len(x) // 6)).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if len(y) and 100 * common >= percent * (len(x) + len(y) - common):
            seen += 1
            a, b = ({n: (need, r) for n, need, r in jaccard.regions_of(z, percent, cache)} for z in (x, y))
            assert any(len(np.intersect1d(a[n][1], b[n][1])) >= max(a[n][0], b[n][0]) for n in a.keys() & b.keys())
    assert seen > 300


def test_jaccard_join_of_nothing(none):
    assert jaccard.joined(none).count() == 0


def brute_count(w, vocab, longest):
    best = [(0.0, 0)]
    for i in range(1, len(w) + 1):
        best.append(max((best[j][0] + vocab[w[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if w[j:i] in vocab))
    return -best[-1][1]


def test_token_counts_against_brute_force(monkeypatch):
    vocab = tokencount.scores(RANKS)
    counter = tokencount.Counter(vocab)
    rng = random.Random(2)
    for n in [rng.randint(1, 12) for _ in range(800)] + [200, 500, 900]:
        w = "".join(rng.choice(["th", "e", "er", " ", "tion", "é", "x", "ing", "9", "的"]) for _ in range(n)).encode()
        assert counter.walk(w) == brute_count(w, vocab, counter.longest)
    assert counter.of("") == (0, 0)
    nodes = len(counter.best)
    assert counter.walk(b"abcde" * 200_000) > 0 and len(counter.best) <= nodes + counter.depth
    monkeypatch.setattr(tokencount, "AT_ONCE", 50)
    text = "some words and 12345 more, " * 40
    assert counter.of(text) == tokencount.Counter(vocab).of(text)


def test_token_count_query(spark, folder, texts, none):
    got = sorted((tuple(r) for r in tokencount.op8_tokens(spark, folder).collect()), key=key)
    vocab, cut = tokencount.scores(RANKS), regex.compile(bpe.PATTERN)
    longest = max(map(len, vocab))
    words = [cut.findall(r[1] or "") for r in texts]
    want = [(r[0], len(ws), sum(brute_count(w.encode(), vocab, longest) for w in ws)) for r, ws in zip(texts, words, strict=True)]
    assert got == sorted(want, key=key)
    assert tokencount.counted(none, RANKS).count() == 0


PAGES = [
    ("<html><head><title>t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>A</a></li></ul></nav><!-- c --><div class=\"ad\">buy</div><article><h1>T &amp; U</h1><p><b>One  two<br><p>Three\n four</p><p></p></article><footer>f</footer></body></html>", "T & U\n\nOne two\n\nThree four"),
    ("<body><header><h1>Site</h1></header><div class=menu><a href=x>A</a></div><div id=content><h1>Title</h1><p>Hello <i>world</i>.<p>Second<form><input><p>no</p></form></div><div class='comments'><p>bad</p></div>", "Title\n\nHello world.\n\nSecond"),
    ("a < b and <p>c", "a < b and\n\nc"), ("<p" * 20, ""), ("", ""), (None, ""), ("<script>x", ""), ("<nav><a>b</a></nav>", ""),
    ("<article><header><h1>H</h1></header><p>x</p><section class='related-posts'><p>no</p></section><aside>no</aside><p>y</p></article>", "H\n\nx\n\ny"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("state", ["content has-sidebar", "no-sidebar", "post comments-open", "social-enabled", "ad", "main-nav", "widget"])
def test_marked_wrappers_do_not_lose_the_article(state):
    body = "<p>" + "Some words of an article. " * 20 + "</p>"
    want = ("Some words of an article. " * 20).strip()
    assert html.main_text(f"<body><div class='{state}'><article><h1>T</h1>{body}</article></div><footer>f</footer></body>") == f"T\n\n{want}"
    assert html.main_text(f"<body><div class='{state}'>{body}</div><p><a href=x>more</a></p></body>") == want


def test_marked_elements_beside_the_article_stay_out():
    body = "<p>" + "Some words of an article. " * 20 + "</p>"
    want = ("Some words of an article. " * 20).strip()
    card = "<div class='related-posts'><article><p>teaser</p></article><p>after</p></div>"
    assert html.main_text(f"<body><article>{body}</article>{card}</body>") == want
    for mark in ("comments-area", "cookie-banner", "site-footer", "ad-slot-1", "social share"):
        assert html.main_text(f"<body><div>{body}</div><div class='{mark}'><p>no</p></div></body>") == want
    assert html.main_text(f"<body><div>{body}</div><div id='comments'>{body * 3}</div></body>") == want
    assert html.main_text("<div class=ad>" * 300 + body) == want


def test_line_blocks_of_pages_without_semantic_tags():
    lines = ["The first words of a paragraph of this article, and some more of them. " * k for k in (3, 4, 2, 5)]
    paras = [x.strip() for x in lines]
    items = [f"item {i}" for i in range(8)]
    before = "".join(f"<div class=x>{x}</div>" for x in ("Example Daily", "Your news", "Mild, 12 degrees", "Edition of today"))
    after = "".join(f"<div class=y>{x}</div>" for x in ("© 2024 Example Media", "Also of interest: a teaser", "Prices with tax", "Made with care"))
    div = lambda xs: "".join(f"<div>{x}</div>" for x in xs)
    page = f"<body>{before}<h1>Title</h1><div>By A. Writer</div><div>Monday</div><div>3 minutes</div>{div(paras[:2])}{div(items)}{div(paras[2:])}{after}</body>"
    assert html.main_text(page).split("\n\n") == ["Title", "By A. Writer", "Monday", "3 minutes", *paras[:2], *items, *paras[2:]]
    long = "A line far longer than all the others. " * 400
    assert html.main_text(f"<body>{div([*paras, long, *paras])}{after}</body>").split("\n\n") == [*paras, long.strip(), *paras]
    assert html.main_text(f"<body>{div(items)}</body>").split("\n\n") == items


def test_line_blocks_inside_a_named_article():
    links = "".join(f"<li><a href=/{i}>page {i}</a></li>" for i in range(4))
    two = "<p><a href=x>one</a></p><p><a href=y>two</a></p>"
    assert html.main_text(f"<article><h1>T</h1><p>First.</p><ul>{links}</ul><p>Second.</p>{two}</article>").split("\n\n") == ["T", "First.", "Second.", "one", "two"]
    assert html.main_text(f"<article><ul>{links}</ul></article>").split("\n\n") == [f"page {i}" for i in range(4)]
    rng = random.Random(4)
    for _ in range(300):
        size = [rng.choice([0, 0, 0, 1, 50]) for _ in range(rng.randint(0, 12))]
        dives = {j for i in range(len(size)) for j in range(i, i + html.WINDOW) if i + html.WINDOW <= len(size) and not any(size[i : i + html.WINDOW])}
        assert html.between(size) == [j not in dives or len(dives) == len(size) for j in range(len(size))]


ARTICLE = "Article text that goes on for a while, with more than a few words in it. " * 4


@pytest.mark.parametrize("page", [
    "<ul><li class='nav-item'><a href=a>A</a><li class='nav-item'><a href=b>B</a></ul><div id=content><p>{}</p></div>",
    "<a name=top><p>{}</p>",
    "<div class=share><a href=f>F</a><div id=content><p>{}</p></div>",
    "<div><p>{}</p></div><div>We use cookies.</div><div>OK</div><div>Copyright 2020 ACME</div>",
    "<div>{}</div>",
])
def test_pages_with_sloppy_markup(page):
    got = html.main_text("<body>" + page.format(ARTICLE) + "</body>")
    assert got.startswith(ARTICLE.strip()) or got == ARTICLE.strip()


COMMENT = "<article class='{}'><p>I do not agree with a word of what is written here, and neither does my neighbour.</p></article>"
CARD = "<article class=card><h3><a href=/{0}>Another story {0}</a></h3><p>A teaser of it.</p></article>"


def test_the_heaviest_body_is_the_article():
    body = "".join(f"<p>{ARTICLE}</p>" for _ in range(3))
    want = "\n\n".join([ARTICLE.strip()] * 3)
    for kind in ("comment-body", "comment", "x"):
        for holder in ("id='comments'", "class='comments-area'"):
            assert html.main_text(f"<body><div class='entry-content'>{body}</div><div {holder}>{COMMENT.format(kind) * 4}</div></body>") == want
    assert html.main_text(f"<body><div class='entry-content'>{body}</div>{COMMENT.format('comment-body') * 4}</body>") == want
    cards = "".join(CARD.format(i) for i in range(5))
    assert html.main_text(f"<body><div>{body}</div><div class=more>{cards}</div></body>") == want
    assert html.main_text(f"<body><article>{body}</article><div>{COMMENT.format('comment-body')}</div></body>") == want
    short = "<article><h1>News</h1><p>A short article, but the markup names it.</p></article>"
    assert html.main_text(f"<body>{short}<div>Weather: mild.</div><div>Prices with tax.</div></body>") == "News\n\nA short article, but the markup names it."


def test_what_an_article_keeps_and_what_is_a_notice():
    refs = "".join(f"<li><a href=/{i}>A study of the {i}. kind, in: Proceedings of its workshop</a></li>" for i in range(3))
    page = f"<body><article><h1>T</h1><p>Press <label>Enter</label> now. {ARTICLE}</p><p>Advertisement</p><ol>{refs}</ol><p>We use cookies on this site.</p><p>Copyright 2020 ACME</p></article></body>"
    assert html.main_text(page).split("\n\n") == ["T", f"Press Enter now. {ARTICLE.strip()}", *(f"A study of the {i}. kind, in: Proceedings of its workshop" for i in range(3))]
    assert html.main_text(f"<div><p>{ARTICLE}</p></div><div>Copyright 2020 ACME</div>") == ARTICLE.strip()
    assert html.main_text("<article><p>Copyright law was made in 1710 and changed very often after that, as the next pages of this book will tell.</p></article>").startswith("Copyright law")


def test_parts_between_link_lines_both_stay():
    links = "".join(f"<p><a href=/{i}>page {i}</a></p>" for i in range(4))
    got = html.main_text(f"<body><div><p>{ARTICLE}</p>{links}<p>Part two. {ARTICLE}</p></div></body>")
    assert got.startswith(ARTICLE.strip()) and got.endswith(("Part two. " + ARTICLE).strip())


def test_columns_of_the_result_replace_those_of_the_pages(spark):
    out = html.extracted(spark.createDataFrame([(1, "<p>a</p>", "old", 9)], "page_id long, html string, text string, n_chars int"))
    assert out.columns == ["page_id", "text", "n_chars"] and tuple(out.first()) == (1, "a", 1)


def test_surges():
    assert html.surges([0, 0, 0, 9, 9, 0, 9, 0, 0, 0, 0, 5]) == [(3, 7), (11, 12)]
    assert html.surges([]) == [] and html.surges([0, 0]) == []


def test_pages_query(spark, tmp_path):
    spark.createDataFrame([(i, f"u{i}", p, 1) for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text int").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in html.op9_html(spark, str(tmp_path)).collect()}
    assert [got[i].text for i in range(len(PAGES))] == [w for _, w in PAGES] and all(r.n_chars == len(r.text) for r in got.values())


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_long_words_of_two_letters_are_told_apart(spark, n):
    """Words that any polynomial modulo 2^64 takes for each other."""
    a, b = thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    hashes, _ = jaccard.word_hashes(raw, np.array([0, len(raw)]))
    assert hashes[0] == hashes[2] != hashes[1]
    rows = [(1, a), (2, b), (3, a), (11, f"{a} x"), (12, f"{b} x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: r.component_id for r in jaccard.joined(docs, k=3, percent=90).collect()} == {1: 1, 2: 2, 3: 1, 11: 11, 12: 12}
    assert sorted((tuple(r) for r in repeats.cleaned(docs).collect()), key=key) == brute_repeats(rows)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    kept = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    got = {r[0]: r.n_known for r in pitmanyor.scored(spark.createDataFrame([(kept, a), (held, b)], "doc_id long, text string")).collect()}
    assert got == {kept: 2, held: 1}
