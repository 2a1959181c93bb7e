"""Ordered lines in many splits, checksum lists, and trees as a data source."""

from __future__ import annotations

import hashlib
import os
import random

import pytest

from provena.sources import lines, packages, trees


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="module")
def split(spark):
    """A session that reads text in splits of about 1 kB."""
    new = spark.newSession()
    new.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    new.conf.set("spark.sql.files.openCostInBytes", "0")
    return new


def test_lines_of_many_splits(spark, split, tmp_path):
    rng = random.Random(5)
    bodies = {
        "a.log": b"".join(rng.choice([b"", b"x" * rng.randint(0, 90), "é\r".encode(), b"\xff\xfe", b"y" * 3000]) + b"\n" for _ in range(400)),
        "b.log": b"one\n\ntorn", "c.log": b"", "d.log": b"\n", "e.log": b"z" * 5000,
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = lines.numbered_lines(split, f"file://{tmp_path}/*.log").selectExpr("path", "number", "start", "cast(line AS binary) AS line", "ended", "spark_partition_id() AS p").collect()
    assert len({r.p for r in got}) >= 4
    by_file: dict = {}
    for r in sorted(got, key=lambda r: r.number):
        by_file.setdefault(r.path.rsplit("/", 1)[1], []).append((r.number, r.start, bytes(r.line), r.ended))
    for name, body in bodies.items():
        pieces, at, want = body.split(b"\n"), 0, []
        for i, piece in enumerate(pieces):
            if i < len(pieces) - 1 or piece:
                want.append((i + 1, at, piece, i < len(pieces) - 1))
                at += len(piece) + 1
        assert by_file.get(name, []) == want
    whole = lines.numbered_lines(spark, f"file://{tmp_path}/*.log").collect()
    assert sorted((r.path, r.number, r.start, r.ended) for r in whole) == sorted((r.path, r.number, r.start, r.ended) for r in got)


def test_checksum_rules(split, tmp_path):
    h = "a" * 64
    rows = [f"{h}  a", f"{h}  b", f"{h}  b", f"{h}  a/x", f"{h.upper()}  c", f"{h} c", f"{h}  ../d", f"{h}  e\r", f"{h}  f", f"{h}  g"]
    (tmp_path / "SUMS").write_text("\n".join(rows), newline="")
    got = [(r.number, r.faults) for r in lines.checksum_rows(lines.numbered_lines(split, f"file://{tmp_path}/SUMS")).orderBy("number").collect()]
    assert got == [(1, []), (2, []), (3, ["order"]), (4, ["order"]), (5, ["form"]), (6, ["form"]), (7, ["path"]), (8, ["ending"]), (9, []), (10, ["ending"])]


def test_a_swap_is_found_at_any_seam(split, tmp_path):
    names = [f"f{i:05d}" for i in range(300)]
    for at in (13, 14, 157):
        swapped = names[:at] + [names[at + 1], names[at]] + names[at + 2 :]
        (tmp_path / f"S{at}").write_text("".join(f"{'b' * 64}  {x}\n" for x in swapped))
        rows = lines.checksum_rows(lines.numbered_lines(split, f"file://{tmp_path}/S{at}"))
        assert [(r.number, r.file) for r in rows.filter("size(faults) > 0").collect()] == [(at + 2, names[at])]


def test_checksum_diff(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("c", "2"), (None, None), ("d", "1")], "file string, sha256 string")
    there = spark.createDataFrame([("a", "1"), ("b", "2"), ("e", "1"), ("c", "1")], "path string, sha256 string")
    assert dict(lines.checksum_diff(rows, there).collect()) == {"a": "match", "b": "drift", "c": "listed twice", "d": "missing", "e": "extra"}


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "tree é"
    for folder in ("a/b/c", "empty", "d/deep/er/still"):
        (top / folder).mkdir(parents=True)
    for name, body in (("a/x", b"1"), ("a/b/y.txt", b""), ("d/deep/er/still/z", b"zz" * 700_000), ("top", b"t"), ("d/%41", b"p")):
        (top / name).write_bytes(body)
    return top


def entries(root):
    out = {}
    for base, folders, files in os.walk(root):
        for name in folders:
            out[os.path.relpath(os.path.join(base, name), root)] = ("directory", None, None)
        for name in files:
            body = open(os.path.join(base, name), "rb").read()
            out[os.path.relpath(os.path.join(base, name), root)] = ("file", len(body), sha(body))
    return out


def test_tree(spark, root):
    want = entries(root)
    for parts in (1, 2, 50):
        assert {r.path: (r.kind, r["size"], r["sha256"]) for r in trees.tree(spark, str(root), parts=parts).collect()} == want
    assert {r.path: (r.kind, r["size"], r["sha256"]) for r in trees.observed(spark, root.as_uri()).collect()} == want
    assert all(r["sha256"] is None for r in trees.tree(spark, str(root), digest=False).collect())


def test_tree_filters_are_pushed(spark, root):
    (root / "a/b/unreadable").symlink_to("nowhere")
    big = root / "d/deep/er/still/z"
    df = trees.tree(spark, str(root), most_bytes=1000, parts=50)
    with pytest.raises(Exception, match="has more than 1000 bytes"):
        df.collect()
    assert big.stat().st_size > 1000 and sorted(r.path for r in df.filter("startswith(path, 'a/b')").collect()) == ["a/b", "a/b/c", "a/b/unreadable", "a/b/y.txt"]
    assert [(r.path, r["sha256"]) for r in df.filter("path = 'a/x'").collect()] == [("a/x", sha(b"1"))]
    assert df.filter("path = 'a/x' AND startswith(path, 'd')").count() == 0


def test_tree_refusals(spark, root, tmp_path):
    with pytest.raises(Exception, match="has more than 3 entries"):
        trees.tree(spark, str(root), most=3, parts=1).collect()
    with pytest.raises(Exception, match="has more than 3 entries"):
        trees.tree(spark, str(root), most=3, parts=50).collect()
    (root / "link").symlink_to("top")
    assert [r.kind for r in trees.tree(spark, str(root)).filter("path = 'link'").collect()] == ["link"]
    with pytest.raises(Exception, match="links or special files"):
        trees.observed(spark, str(root))
    (root / "link").unlink()
    os.link(root / "top", root / "second name")
    with pytest.raises(Exception, match="links or special files"):
        trees.observed(spark, str(root))
    (tmp_path / "none").mkdir()
    assert trees.tree(spark, str(tmp_path / "none")).count() == 0


def test_a_tree_that_changes_is_refused(spark, root, monkeypatch):
    scans = []

    def scan(spark, where, **options):
        if scans:
            (root / "top").write_bytes(b"T")
        scans.append(where)
        return trees_tree(spark, where, **options)

    trees_tree = trees.tree
    monkeypatch.setattr(trees, "tree", scan)
    with pytest.raises(Exception, match="changed between two scans"):
        trees.observed(spark, str(root))


def test_package(spark, tmp_path):
    files = spark.createDataFrame([(f"d/{i}", f"body {i % 7}".encode()) for i in range(40)] + [("é x", b""), ("big", b"z" * 100_000)], "name string, content binary").repartition(5)
    root = f"{tmp_path}/p"
    packages.publish(files, root)
    got = {r.name: (r["sha256"], r["size"], r.status) for r in packages.verified(spark, root).collect()}
    assert got == {r.name: (sha(bytes(r.content)), len(r.content), "match") for r in files.collect()}
    with pytest.raises(Exception, match="exists"):
        packages.publish(files, root)
    assert packages.verified(spark, root).count() == 42
    victim = next((tmp_path / "p/objects").glob(f"*/{sha(b'body 3')}"))
    victim.write_bytes(b"other")
    assert {r.status for r in packages.verified(spark, root).collect() if r["sha256"] == sha(b"body 3")} == {"drift"}
    victim.unlink()
    assert {r.status for r in packages.verified(spark, root).collect() if r["sha256"] == sha(b"body 3")} == {"missing"}
    part = next((tmp_path / "p/sums").iterdir())
    part.write_bytes(part.read_bytes() + b"\n")
    with pytest.raises(Exception, match="missing, changed"):
        packages.listed(spark, root).collect()
    (tmp_path / "p/SHA256SUMS").write_bytes(b"")
    with pytest.raises(Exception, match="marker"):
        packages.listed(spark, root)


def test_a_failed_task_leaves_no_package(spark, tmp_path):
    good = [(f"n{i}", b"x") for i in range(20)]
    for bad in ((None, b"x"), ("a\nb", b"x"), ("c", None), ("", b"x")):
        root = f"{tmp_path}/{len(os.listdir(tmp_path))}"
        with pytest.raises(Exception, match="no name or content"):
            packages.publish(spark.createDataFrame([*good, bad], "name string, content binary").repartition(3), root)
        assert not os.path.exists(root)
    (tmp_path / "half/objects/aa").mkdir(parents=True)  # as a driver that died leaves it
    with pytest.raises(Exception, match="is no package"):
        packages.listed(spark, f"{tmp_path}/half")


def test_packages_of_nothing_and_of_doubles(spark, tmp_path):
    none = spark.createDataFrame([], "name string, content string")
    packages.publish(none, f"{tmp_path}/none")
    assert packages.listed(spark, f"{tmp_path}/none").count() == 0
    packages.publish(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "name string, content string").coalesce(1), f"{tmp_path}/two")
    assert sorted((r.name, r.status) for r in packages.verified(spark, f"{tmp_path}/two").collect()) == [("a", "listed twice"), ("a", "listed twice"), ("b", "match")]
