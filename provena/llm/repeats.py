"""Suffix-array dedup: bytes of repeated substrings are cut, wherever in the corpus a string of ``length`` bytes starts twice.

Shards of the corpus are put in suffix order by external induced sorting (provena.llm.suffix); a string of ``length`` bytes
is repeated if its suffix shares that much with a neighbour. Strings that cannot meet an equal one never reach a shard:

1. Every string has an anchor, its byte gram of least hash. Strings in a row with the same anchor are a run; equal strings
   lie at the same place of runs with equal anchors. A run is described by the hash of its anchor and the hash of all of
   its bytes; both are counted over the corpus, summed per batch before the shuffle. Equal runs are cut under these hashes, with
   no byte compared: runs around one anchor are told apart by 62 bits of all of their bytes, of which an anchor would need about a billion
   distinct ones to err, and runs around different anchors by those of the anchor as well.
2. Runs whose bytes recur as a whole are repeated entirely: their strings need no comparison. Runs whose anchor no other
   bytes share are unique. What is left, one run for each distinct content, goes to the shard of its anchor.
3. A shard is sorted in blocks of whole anchors. An anchor with over MOST distinct runs would make a block that grows with
   the corpus: its strings are instead counted one by one by a 128-bit hash, summed before the shuffle, which is exact too.

Spans of a text are joined to it by id and text hash, united, and cut. Documents are joined where they lie; a copied text
costs its bytes once per copy and no pairs. Shuffle files of a finished phase are let go before the next.

Edge cases: null is the empty text; texts under ``length`` bytes have no strings and stay; equal rows are separate documents
and repeat each other; there are no ties, as all equal strings go, the first one too; of grams of equal least hash the left one is
the anchor; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import dropped, importable, let_go, released, scratch, table, written
from provena.llm.jaccard import _mixed, byte_hashes, slices
from provena.llm.suffix import ordered

GRAM = 50
#: Distinct runs of an anchor that a shard sorts; bytes of a block, and of the runs of a task.
MOST, BLOCK, TASK = 20_000, 3_000_000, 12_000_000
PLACE = 32


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hashes of all grams: sums of bytes by powers of an odd number modulo 2^64, doubling the width; short ones are told apart well by these."""
    out, base, width, rest = None, 0x9E3779B97F4A7C15, 1, raw.astype(np.uint64) + np.uint64(1)
    done = 0
    for bit in range(GRAM.bit_length()):  # rest[i] covers ``width`` bytes from i on
        if GRAM >> bit & 1:
            out = rest if out is None else out[: len(rest) - done] * np.uint64(pow(base, width, 1 << 64)) + rest[done : done + len(out[: len(rest) - done])]
            done += width
        if GRAM >> bit + 1:
            rest, width = rest[:-width] * np.uint64(pow(base, width, 1 << 64)) + rest[width:], 2 * width
    return _mixed(out[: len(raw) - GRAM + 1])


def runs_of(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: text number, start, end (of the last string), place of the anchor in it, hashes of anchor and bytes."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    n, wide = len(raw), length - GRAM + 1
    if n < length:
        return none
    hashed, m, grams = byte_hashes(raw), n - GRAM + 1, _grams(raw)
    low = np.uint64((1 << PLACE) - 1)
    least, width = (grams & ~low) | np.arange(m, dtype=np.uint64), 1
    while width * 2 <= wide:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    rest = wide - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    anchor = (least & low).astype(np.int64)
    valid = np.zeros(len(anchor) + length, np.int32)
    size = np.diff(offsets)
    long = size >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(valid)[: len(anchor)] > 0)
    if not len(s):
        return none
    at = anchor[s]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
    fresh[np.searchsorted(s, offsets[:-1][long])] = True
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(s)) - 1
    start, end, at = s[first], s[last] + length, at[first]
    whole = hashed(start, end) ^ ((at - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    doc = np.searchsorted(offsets, start, "right") - 1
    return doc, start - offsets[doc], end - offsets[doc], at - start, grams[at].astype(np.int64), whole.astype(np.int64)


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("tid"), body.alias("body"))


def _runs(keyed: DataFrame, length: int) -> DataFrame:
    kind = keyed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in slices(batch.column(2)):
                doc, start, end, at, anchor, whole = runs_of(raw, offsets, length)
                if len(doc):
                    rows = pa.array(doc + first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(at, pa.int32()), pa.array(anchor), pa.array(whole)],
                        names=["id", "tid", "s", "e", "at", "anchor", "whole"],
                    )

    return keyed.mapInArrow(released(run), f"id {kind}, tid long, s int, e int, at int, anchor long, whole long")


def _cut(keyed: DataFrame, wanted: DataFrame, schema: str, names: list[str], rows) -> DataFrame:
    """The texts with runs to compare, handed to ``rows`` (body, its runs), which yields columns."""
    per_text = wanted.groupBy("id", "tid").agg(F.collect_list(F.struct("s", "e", "at", "anchor", "n")).alias("runs"))
    per_text = per_text.select(F.col("id").alias("_id"), F.col("tid").alias("_tid"), "runs")
    both = keyed.join(per_text, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tid") == F.col("_tid"))).select("id", "tid", "body", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = rows(batch.column(2)[i].as_py(), batch.column(3)[i].values)
                if len(columns[0]):
                    k = pa.array(np.full(len(columns[0]), i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(k), batch.column(1).take(k), *columns], names=["id", "tid", *names])

    return both.mapInArrow(released(run), schema)


def _struct(runs: pa.StructArray, name: str) -> np.ndarray:
    return runs.field(name).to_numpy(zero_copy_only=False)


def repeated_starts(parts: list[bytes], strings: np.ndarray, length: int, folder: str | None = None) -> list[np.ndarray]:
    """Of some byte runs, each with its first so many strings of ``length`` bytes: the starts of strings that occur twice or more."""
    sizes = np.array([len(p) + 1 for p in parts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    places, prefix = ordered(text, length, folder)
    which = np.searchsorted(begin, places, "right") - 1
    inside = places - begin[which]
    starts = inside < strings[which]
    group = np.cumsum(prefix < length)
    often = np.bincount(group[starts], minlength=int(group[-1]) + 1) > 1
    hit = starts & often[group]
    which, inside = which[hit], inside[hit]
    order = np.lexsort((inside, which))
    which, inside = which[order], inside[order]
    cuts = np.searchsorted(which, np.arange(len(parts) + 1))
    return [inside[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of strings, in order, as united spans."""
    if not len(starts):
        return starts, starts
    head = np.concatenate([[True], np.diff(starts) > length])
    first = np.flatnonzero(head)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1] + length


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """Spans of repeated strings: id, tid (text hash), s, e. They may overlap."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text)
    kind = keyed.schema["id"].dataType.simpleString()
    runs = written(_runs(keyed, length))
    one = F.struct("id", "tid", "s", "e", "at")
    counts = runs.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(one).alias("one"))
    found = written(counts.filter("n > 1").select("anchor", "whole"))
    let_go(spark)
    shared = counts.select("anchor", "whole").groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    compare = written(counts.join(shared, "anchor").select("anchor", "n", "one.*", "kinds"))
    let_go(spark)
    whole = written(runs.join(found, ["anchor", "whole"], "left_semi").select("id", "tid", "s", "e"))
    dropped(runs)
    dropped(found)
    let_go(spark)
    usual, crowded = compare.filter(F.col("kinds") <= MOST), compare.filter(F.col("kinds") > MOST)

    def bytes_of(body: bytes, own: pa.StructArray) -> list[pa.Array]:
        s, e = _struct(own, "s"), _struct(own, "e")
        parts = pa.array([body[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())
        return [pa.array(s, pa.int32()), pa.array(_struct(own, "anchor"), pa.int64()), pa.array(_struct(own, "n"), pa.int64()), parts]

    size = usual.agg(F.sum(F.col("e") - F.col("s")).alias("b")).first()["b"] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK + 1)
    parts = _cut(keyed, usual, f"id {kind}, tid long, s int, anchor long, n long, part binary", ["s", "anchor", "n", "part"], bytes_of)
    parts = parts.repartition(tasks, "anchor").sortWithinPartitions("anchor")

    folder = scratch(spark)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list) -> Iterator[pa.RecordBatch]:
            strings = np.array([len(r[5]) - length + 1 for r in rows])
            out = [[], [], [], []]
            for r, starts in zip(rows, repeated_starts([r[5] for r in rows], strings, length, folder), strict=True):
                if r[4] == 1:  # others are repeated as a whole
                    for a, b in zip(*_spans(starts, length), strict=True):
                        for column, value in zip(out, (r[0], r[1], r[2] + int(a), r[2] + int(b)), strict=True):
                            column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], id_type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["id", "tid", "s", "e"])

        rows, held, id_type = [], 0, pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held >= BLOCK and row[3] != rows[-1][3]:
                    yield from block(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[5])
        if rows:
            yield from block(rows)

    sorted_spans = written(parts.mapInArrow(released(sort), f"id {kind}, tid long, s int, e int"))
    let_go(spark)
    out = whole.unionByName(sorted_spans)
    if not crowded.isEmpty():

        def each_string(body: bytes, own: pa.StructArray) -> list[pa.Array]:
            at = [a + i for a, b in zip(_struct(own, "s").tolist(), _struct(own, "e").tolist(), strict=True) for i in range(b - a - length + 1)]
            digests = [hashlib.blake2b(body[i : i + length], digest_size=16).digest() for i in at]
            n = [k for a, b, k in zip(_struct(own, "s").tolist(), _struct(own, "e").tolist(), _struct(own, "n").tolist(), strict=True) for _ in range(b - a - length + 1)]
            return [pa.array(at, pa.int32()), pa.array(n, pa.int64()), pa.array(digests, pa.binary())]

        strings = written(_cut(keyed, crowded, f"id {kind}, tid long, s int, n long, digest binary", ["s", "n", "digest"], each_string))
        often = strings.groupBy("digest").agg(F.sum("n").alias("all")).filter("all > 1").select("digest")
        out = out.unionByName(strings.join(often, "digest", "left_semi").select("id", "tid", "s", (F.col("s") + length).cast("int").alias("e")))
    return out


def cleaned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200, digests: bool = True) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, and the digest of the bytes kept, or else these (binary)."""
    importable(docs.sparkSession)
    keyed = _keyed(docs, id_col, text)
    kind = keyed.schema["id"].dataType.simpleString()
    found = repeats(docs, id_col, text, length)
    per_text = found.groupBy("id", "tid").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans")).select(F.col("id").alias("_id"), F.col("tid").alias("_tid"), "spans")
    both = keyed.join(per_text, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tid") == F.col("_tid")), "left").select("id", "body", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, count, kept = [], [], [], []
            for body, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = body.as_py()
                left, at, gone, k = [], 0, 0, 0
                if spans.is_valid:
                    end = -1
                    for a, b in zip(_struct(spans.values, "s").tolist(), _struct(spans.values, "e").tolist(), strict=True):
                        if a > end:
                            k += 1
                        if a > at:
                            left.append(raw[at:a])
                        gone += max(0, b - max(a, at))
                        at, end = max(at, b), max(end, b)
                left.append(raw[at:])
                whole = b"".join(left)
                n.append(len(raw))
                removed.append(gone)
                count.append(k)
                kept.append(hashlib.sha256(whole).hexdigest() if digests else whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string() if digests else pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"])

    out = both.mapInArrow(released(run), f"id {kind}, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digests else 'kept binary'}")
    return out.withColumnRenamed("id", id_col)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents", "doc_id", "text"))
