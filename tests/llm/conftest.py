from __future__ import annotations

import random

import pytest

WORDS = "the of and anet thin or ere ling ista quor vel nam tion ble rin osten park lume dro sib".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "a", "er", "ing", "o"]) + rng.choice(["", "", "", ".", ","]))
        if i % 17 == 16:
            out.append("\n")
    return " ".join(out).replace(" \n ", "\n")


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, _text long, item string"


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """Nulls, empty and wordless texts, copies, near copies, repeats inside a text, a hot line, one long text, a repeated row, a null id."""
    rng = random.Random(7)
    body = [prose(rng, rng.randint(60, 160)) for _ in range(30)]
    rows = [*body, None, "", " \n\t ", "One", "Two words", "É É É", "x" * 3000, body[0], body[0], body[1].replace("the", "thy", 1), prose(rng, 4000), "la la la " * 80, body[2] + "\n" + body[2]]
    near = body[3].split(" ")
    for k in range(6):
        copy = list(near)
        copy[5 + 9 * k] = f"w{k}"
        rows.append(" ".join(copy))
    rows += [f"All rights reserved here.\n{prose(rng, 60)}" for _ in range(30)]
    rows += ["All rights reserved here.\n" * 3 + "All rights reserved here.\n"] * 2
    rows += ["a <|endoftext|> b  c\t\tÀé 中文 123 it's 😀"]
    out = [(i, x, f"src{i % 2}", "en", len(x or ""), 0, "q") for i, x in enumerate(rows)]
    return [*out, out[4], (None, body[5], None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """The given texts as tables of a scale."""
    root = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{root}/documents.parquet")
    items = [(0, docs.filter("doc_id = 2").first().text), (1, "Two words"), (2, None), (3, ""), (4, docs.filter("doc_id = 2").first().text[:200]), (4, "zzz yyy " * 20)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)
