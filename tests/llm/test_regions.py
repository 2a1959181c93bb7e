"""Near copies that share regions by chance: compared in the cells of central pivots, with no link lost."""

from __future__ import annotations

import random

from provena.llm import jaccard
from provena.llm.jaccard import joined


def test_variants_of_one_text_are_members_of_few_cells(spark, monkeypatch):
    rng, base = random.Random(5), [f"w{i}" for i in range(600)]
    texts = [base]
    for v in range(70):
        own = list(base if v < 50 else texts[1 + v % 10])
        for _ in range(rng.choice([2, 8, 16, 28])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(40)}"
        texts.append(own)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    least = list(range(len(texts)))
    while True:
        after = [min(least[j] for j in range(len(sets)) if i == j or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in range(len(sets))]
        if after == least:
            break
        least = after
    assert len(set(least)) > 5
    compared, asked = jaccard.compared, []

    def counted(pairs, *more):
        asked.append(pairs.count())
        return compared(pairs, *more)

    monkeypatch.setattr(jaccard, "compared", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in joined(docs).collect()} == dict(enumerate(least))
    assert sum(asked) < 1800, asked


def test_cells_within_a_cell_of_a_more_central_pivot_are_left_out(spark):
    pivot = {"p": 9.0, "q": 8.0, "r": 7.0, "s": 6.0}
    members = {"p": "pqxyz", "q": "qxy", "r": "rxq", "s": "sr"}  # q is in p; r and s are not, as r is in no other
    cells = spark.createDataFrame([((pivot[c], ord(c)), ord(m)) for c, ms in members.items() for m in ms], "p struct<score: double, cls: long>, cls long")
    left = {}
    for row in jaccard.uncovered(cells).collect():
        left.setdefault(chr(row.p.cls), set()).add(chr(row.cls))
    assert left == {c: set(members[c]) for c in "prs"}
    chain = {"p": "pqrxy", "q": "qrxy", "r": "rx"}
    cells = spark.createDataFrame([((pivot[c], ord(c)), ord(m)) for c, ms in chain.items() for m in ms], "p struct<score: double, cls: long>, cls long")
    assert {(row.p.cls, row.cls) for row in jaccard.uncovered(cells).collect()} == {(ord("p"), ord(m)) for m in "pqrxy"}


def _exploded(spark, monkeypatch, n):
    """Memberships of cells whose deviations are looked at, of a group of n variants of a text of which half are linked with nothing; the components are checked."""
    rng, base = random.Random(7), [f"w{i}" for i in range(400)]
    edits = [(rng.randrange(400), f"x{i}") for i in range(60)]
    texts = [base]
    for v in range(n):
        own = list(base)
        for at, word in rng.sample(edits, rng.choice([3, 4, 16, 20])):
            own[at] = word
        texts.append(own)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    linked = [[j for j in range(len(sets)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(sets))]
    least = list(range(len(texts)))
    while (after := [min(least[j] for j in linked[i]) for i in range(len(sets))]) != least:
        least = after
    assert len(set(least)) > n // 4
    deviations, seen = jaccard.deviations, []

    def counted(members, *more):
        seen.append(members.count())
        return deviations(members, *more)

    monkeypatch.setattr(jaccard, "deviations", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in joined(docs).collect()} == dict(enumerate(least))
    monkeypatch.setattr(jaccard, "deviations", deviations)
    return sum(seen)


def test_memberships_of_outliers_grow_no_faster_than_their_group(spark, monkeypatch):
    few, many = _exploded(spark, monkeypatch, 60), _exploded(spark, monkeypatch, 240)
    assert many <= 4.5 * max(few, 60), (few, many)
