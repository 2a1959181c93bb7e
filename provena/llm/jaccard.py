"""N-gram Jaccard join in metric space: regions around pivots, windows by the triangle inequality, exact recursion.

A document is its set of distinct word shingles; documents of equal sets are one class, and one class is one point.

1. *Regions.* Unrelated texts all lie at a distance near 1 from each other, so windows around pivots that are documents would
   replicate every class to every region. The first level therefore measures distance on projections: the shingles are dealt
   by hash into m parts, m being a quarter more than the largest symmetric difference that a linked pair of that size may have. Two
   linked sets then agree wholly in a fifth of the parts at least, at distance 0 there, so each class goes into one region per part, and
   into those of smaller size ranges if its size lies in their windows. A linked pair meets in as many regions as its sizes
   demand (``need``), so a class that meets others in fewer is out, and with it the regions it leaves to one class alone.
   What crosses the shuffle is packed, one entry per region and class of a pack, and a region that a pack has twice or more sends one
   entry only; a region of one class ends where the entries meet. Of the rest each class leaves out as many as a linked pair has beyond
   one, the same way round for all: regions of the most central pivots come first, so chance meetings of near copies go (``first_met``).
2. *Pivots and cells.* The pivot of a region is its most central class, the one that meets most others in its regions.
   Regions of one pivot are one cell; one whose classes are all in another cell of a more central pivot is left out, as their pairs
   meet there (``uncovered``): outliers of a group share regions of many other outliers, the more the larger it is. Every member is compared with the pivot (a star, not all pairs); its symmetric difference from
   the pivot is its deviation. Who is linked with the pivot, directly or over others, is settled.
3. *Windows.* A member is open while it is in another component than its pivot. If an open x is linked with any member y, then
   |dev(x)| - |dev(y)| is within their largest symmetric difference (the triangle inequality), and as x lies farther from the pivot
   than a link reaches, the deviations share an element: at least half of |dev(x)| + |dev(y)| less that difference. In small
   cells the windows alone select pairs. In others x and y must also share one of the first elements of their deviations, those outside
   the pivot first, and the bitmaps of both parts of their deviations must differ in no more bits than the sets may in elements. So edits that
   members do not have in common never make a pair, however large a group of near copies is.
4. *Recursion.* A cell in which that still leaves too many pairs (a dense group away from the pivot) is split: its most central open
   members become pivots, every member gets its distance from each, goes to the Voronoi cell of the nearest, and as a guest into
   every other cell whose pivot is at most two link distances farther. Pairs with one who is at home meet there; and so on
   from 2. The last level joins whatever is left, so nothing is lost at any depth.

Components, not all links, are the result; copies of a class are not compared. Everything is a DataFrame job; joins on a hot
pivot are ones that adaptive execution can split, and nothing of the corpus reaches the driver. Tables of a level are written
to the shared folder and deleted when the next stands.

Edge cases: null, empty and wordless texts have an empty set, and are linked with nothing; a text shorter than a shingle
is one shingle; repeated rows are one class; a null id is its own class member and never names a component if another can;
an empty table gives no rows; other columns, whatever their names, are not read. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.llm.common import dropped, importable, let_go, released, small, table, written

#: Members of a cell whose pairs in the window are compared without looking at deviations.
SMALL = 8
#: Pairs for each member from which a cell is split; pivots it is split by; depth at which no cell is split any more.
DENSE, PIVOTS, DEPTH = 32, 4, 4
#: Entries of a pack, and of a task that looks for regions of two classes.
PACK, IN_TASK = 1_000_000, 2_000_000
#: Edges of a graph that one task takes at most.
FEW_EDGES = 1_000_000
#: Rows of representatives that are broadcast at most.
MOST_KEYS = 1_000_000
#: Ratio of the sizes of a range; parts beyond the least number, as a share of it and at least.
RANGE, SHARE, SPARE = 1.35, 4, 4
#: Longs of a bitmap.
MAPS = 2
#: Times that classes with too few shared regions are taken out at most; share of what was there from which on too much is left for another.
PEELS, LITTLE = 2, 0.9
#: Bytes of text that are hashed at a time.
SLICE = 500_000

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Two primes below 2^31 and a base for each: sums of bytes times powers are exact in 64 bits over PIECE bytes.
MODULI, BASES, PIECE = (2147483647, 2147483629), (1103515245, 1566083941), 1 << 22


def _powers_of(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo its prime, n of each at least."""
    p = np.uint64(MODULI[m])
    if m not in _powers or len(_powers[m][0]) < n:
        both = []
        for base in (BASES[m], pow(BASES[m], -1, MODULI[m])):
            out = np.ones(1, np.uint64)
            while len(out) < max(n, SLICE + 1):
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), MODULI[m])) % p])
            both.append(out)
        _powers[m] = both[0], both[1]
    return _powers[m]


def byte_hashes(raw: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that hashes the bytes from starts to ends, 62 bits under two primes mixed with their number: polynomials modulo a power of
    two would take some long words of two letters for each other, whatever their base."""
    sums = []
    for m, p in enumerate(map(np.uint64, MODULI)):
        up, down = _powers_of(m, len(raw) + 1)
        total, carry = np.zeros(len(raw) + 1, np.uint64), np.uint64(0)
        for at in range(0, len(raw), PIECE):
            piece = raw[at : at + PIECE]
            total[at + 1 : at + 1 + len(piece)] = np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[at : at + len(piece)]) + carry
            carry = total[at + len(piece)] % p
            total[at + len(piece)] = carry
        sums.append((total, down, p))

    def hashed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = ((total[end] % p + p - total[start] % p) % p * down[start] % p for total, down, p in sums)
        return _mixed(_mixed(a << np.uint64(31) | b) + (end - start).astype(np.uint64))

    return hashed


def word_hashes(raw: np.ndarray, offsets: np.ndarray, last: bool = False) -> tuple[np.ndarray, ...]:
    """Of concatenated texts (bytes, A-Z in lower case) the hashes of all words, the number of words of each text, and the words' last bytes if asked for."""
    word = ~_BLANK[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = word[heads]
    end = word.copy()
    end[:-1] &= ~word[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[tails] = word[tails]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = byte_hashes(raw)(s, e)
    n = np.searchsorted(s, offsets[1:]) - np.searchsorted(s, offsets[:-1])
    return (hashes, n, raw[e - 1]) if last else (hashes, n)


def lowered(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of rows of about SLICE bytes; null is empty."""
    filled = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(filled):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    for _, raw, offsets in slices(column):
        words, n = word_hashes(lowered(raw), offsets)
        at = np.concatenate([[0], np.cumsum(n)])
        grams = reduce(lambda x, j: _mixed(x * np.uint64(31) + words[j : len(words) - k + 1 + j]), range(1, k), words[: max(0, len(words) - k + 1)]) if len(words) >= k else words[:0]
        for i, m in enumerate(n.tolist()):
            if m >= k:
                yield np.unique(grams[at[i] : at[i] + m - k + 1])
            elif m:
                yield reduce(lambda x, y: _mixed(x * np.uint64(31) + y), words[at[i] + 1 : at[i + 1]], words[at[i] : at[i] + 1] ^ np.uint64(m))
            else:
                yield words[:0]


def _most_apart(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of at most a and b elements."""
    return (100 - percent) * (a + b) // (100 + percent)


def _ranges(n: int, percent: int) -> list[tuple[int, int, int]]:
    """The size ranges (number, parts, spare parts) in which a set of n elements takes part: its own, and those below in which a linked set may lie."""
    out, low, number = [], 1, 0
    while True:
        high = max(low, int(low * RANGE))
        if n * percent <= high * 100 and n >= low:
            least = _most_apart(high, high * 100 // percent, percent)
            spare = max(SPARE, least // SHARE)
            out.append((number, least + 1 + spare, spare))
        if n <= high:
            return out
        low, number = high + 1, number + 1


def regions_of(s: np.ndarray, percent: int, cache: dict) -> list[tuple[int, int, np.ndarray]]:
    """The regions of a set: for each range its number, how many regions a linked set shares at least, and for each part a hash of the range, the part and what the set has in it."""
    out = []
    n = len(s)
    if n not in cache:
        cache[n] = _ranges(n, percent)
    part_hash = _mixed(s ^ np.uint64(0xA5A5A5A5DEADBEEF))
    for number, parts, spare in cache[n]:
        part = (part_hash % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        used, first = np.unique(part[order], return_index=True)
        sums = np.add.reduceat(_mixed(s)[order], first) if n else s
        need = 1 + spare - (parts - len(used))  # of the parts that agree so many may be empty ones
        if need < 1:  # too many empty parts to be sure of a common one that is not
            empty = np.setdiff1d(np.arange(parts), used)
            used, sums, need = np.concatenate([used, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)]), 1
        out.append((number, need, _mixed(_mixed(sums + np.uint64(number + 1)) ^ (used.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))))
    return out


def _class_of(s: np.ndarray) -> int:
    whole = (int(_mixed(s).sum(dtype=np.uint64)) * 0xC2B2AE3D27D4EB4F + len(s)) % (1 << 64)
    return whole - (1 << 64) if whole >> 63 else whole


def _n_regions(n: int, percent: int, cache: dict) -> int:
    if n not in cache:
        cache[n] = sum(parts for _, parts, _ in _ranges(n, percent)) if n else 0
    return cache[n]


def described(docs: DataFrame, id_col: str, text: str, k: int, percent: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, tid (text hash), the columns named in ``also``, n_shingles, n_regions and cls (the class of its set)."""
    source = docs.select(F.col(id_col).alias("id"), _text_hash(text).alias("tid"), F.col(text).alias("text"), *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            n, cls = [], []
            for s in shingle_sets(batch.column(2), k):
                n.append(len(s))
                cls.append(_class_of(s))
            regions = [_n_regions(x, percent, cache) for x in n]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], pa.array(n, pa.int64()), pa.array(regions, pa.int64()), pa.array(cls, pa.int64())], names=["id", "tid", *also, "n_shingles", "n_regions", "cls"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ("id", "tid", *also))
    return source.mapInArrow(released(run), f"{kinds}, n_shingles long, n_regions long, cls long")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


#: A class in a range: the class, the number of the range, and how many regions it must share.
OWNER = np.dtype([("cls", "<i8"), ("number", "u1"), ("need", "<u2")])
#: Bytes of a region within its bucket; the bucket tells the rest.
OF_REGION = 6


def _packed(regions: np.ndarray, owner: np.ndarray, owners: np.ndarray, places: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
    """Rows of a pack, by bucket: its single regions with their owners, its shared ones, which are known to be, and, without owners, one entry for each of these."""
    buckets = len(places)
    bucket = ((regions >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((regions, bucket))
    regions, owner, bucket = regions[order], owner[order], bucket[order]
    low = np.ascontiguousarray(regions).view(np.uint8).reshape(-1, 8)[:, :OF_REGION]
    head = np.concatenate([[True], regions[1:] != regions[:-1]])
    size = np.diff(np.append(np.flatnonzero(head), len(regions)))
    shared = np.repeat(size > 1, size)
    rows = []
    for kind, wanted in ((0, ~shared), (1, shared), (2, shared & head)):
        at = np.flatnonzero(wanted)
        cuts = np.searchsorted(bucket[at], np.arange(buckets + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            own = at[cuts[b] : cuts[b + 1]]
            used, index = np.unique(owner[own], return_inverse=True)
            names, own_places = (b"", b"") if kind == 2 else (owners[used].tobytes(), index.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes())
            # what is known to be shared may be unpacked anywhere
            rows.append((b, -1 - (number * buckets + b) % 1_000_003 if kind == 1 else int(places[b]), low[own].tobytes(), names, own_places))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    for a in range(0, len(rows), 64):
        part = rows[a : a + 64]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], kind) for i, kind in enumerate(kinds)], names=["bucket", "place", "r", "c", "i"])


def _unpacked(bucket: int, r: bytes, c: bytes, i: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Regions and owners of a row; no owners if it has none."""
    low = np.zeros((len(r) // OF_REGION, 8), np.uint8)
    low[:, :OF_REGION] = np.frombuffer(r, np.uint8).reshape(-1, OF_REGION)
    regions = low.view(np.uint64).ravel() + _mixed(np.array([bucket + 1], np.uint64))
    if not c:
        return regions, np.zeros(len(regions), OWNER)
    index = np.frombuffer(i, np.uint16 if len(i) == 2 * len(regions) else np.uint32)
    return regions, np.frombuffer(c, OWNER)[index]


class Shared:
    """Finds regions of two classes or more in a stream of entries; holds one entry of each region, however many classes one has."""

    def __init__(self):
        self.r, self.c, self.f = np.zeros(0, np.uint64), np.zeros(0, OWNER), np.zeros(0, bool)

    def found(self, r: np.ndarray, c: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From more entries (region, owner, whether the region is known to be shared, the owner then being none) the memberships that are now known to matter."""
        r, c, f = np.concatenate([self.r, r]), np.concatenate([self.c, c]), np.concatenate([self.f, f])
        order = np.argsort(r, kind="stable")
        r, c, f = r[order], c[order], f[order]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
        if not len(first):
            return r, c
        least = np.minimum.reduceat(np.where(f, np.iinfo(np.int64).max, c["cls"]), first)
        most = np.maximum.reduceat(np.where(f, np.iinfo(np.int64).min, c["cls"]), first)
        shared = np.logical_or.reduceat(f, first) | (most > least)
        self.r, self.c, self.f = r[first], c[first], shared
        out = np.repeat(shared, np.diff(np.append(first, len(r)))) & ~f
        return r[out], c[out]


def _places(spark: SparkSession, tasks: int) -> np.ndarray:
    """For each of so many buckets a number by which repartition() deals it to a partition of its own."""
    rows = spark.range(40 * tasks).select(F.col("id").cast("int").alias("i")).groupBy(F.pmod(F.hash("i"), F.lit(tasks)).alias("p")).agg(F.min("i").alias("i")).collect()
    known = {r["p"]: r["i"] for r in rows}
    return np.array([known.get(b, b) for b in range(tasks)])


def met(docs: DataFrame, text: str, k: int, percent: int, tasks: int) -> DataFrame:
    """(region, cls, number, need) of all regions that two classes or more have."""
    source, places = docs.select(F.col(text).alias("text")), _places(docs.sparkSession, tasks)

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        number, size, parts, owners, classes = 0, 0, [], [], set()

        def pack() -> Iterator[pa.RecordBatch]:
            owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            return _packed(np.concatenate(parts), owner, np.array(owners, OWNER), places, number)

        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                if not len(s) or (cls := _class_of(s)) in classes:
                    continue
                classes.add(cls)
                for n, need, own in regions_of(s, percent, cache):
                    parts.append(own)
                    owners.append((cls, n, min(need, 65535)))
                    size += len(own)
                if size >= PACK:
                    yield from pack()
                    number, size, parts, owners, classes = number + 1, 0, [], [], set()
        if parts:
            yield from pack()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, size = Shared(), [], 0

        def rows(r: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(r), 100_000):
                part = c[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(r[a : a + 100_000].astype(np.int64)), *(pa.array(part[x].astype(np.int64 if x == "cls" else np.int32)) for x in OWNER.names)], names=["region", *OWNER.names])

        for batch in batches:
            for bucket, place, r, c, i in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
                r, owner = _unpacked(bucket, r, c, i)
                if place < 0:
                    yield from rows(r, owner)
                    continue
                held.append((r, owner, np.full(len(r), not c)))
                size += len(r)
                if size >= 400_000:
                    yield from rows(*state.found(*(np.concatenate(x) for x in zip(*held, strict=True))))
                    held, size = [], 0
        if held:
            yield from rows(*state.found(*(np.concatenate(x) for x in zip(*held, strict=True))))

    packs = source.mapInArrow(released(regions), "bucket int, place int, r binary, c binary, i binary")
    return packs.repartition(tasks, "place").mapInArrow(released(merged), "region long, cls long, number int, need int").distinct()


def peeled(shared: DataFrame) -> DataFrame:
    """``shared`` without classes that meet others in fewer regions of a range than a linked one would, and without regions of one class."""
    own, before = Window.partitionBy("cls", "number"), shared.count()
    for _ in range(PEELS):
        left = shared.withColumn("n", F.count("*").over(own)).withColumn("least", F.max("need").over(own)).filter("n >= least").drop("n", "least")
        still = left.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1").select("region")
        after = written(left.join(still, "region", "left_semi"))
        dropped(shared)
        shared, count = after, after.count()
        if count > LITTLE * before:  # another time would take out even less
            break
        before = count
    return shared


def first_met(shared: DataFrame, score: DataFrame) -> DataFrame:
    """(p, cls): the cells by score and class of their pivots, each class being in those of its regions without the last ``need - 1`` of a range in the order of pivots, the most central first.

    The first region that a linked pair shares in that order is followed by ``need - 1`` more of both, so it is left to both."""
    pivots = shared.join(small(score.select("cls", "score"), MOST_KEYS), "cls").groupBy("region").agg(F.max(F.struct("score", "cls")).alias("p"))
    own = Window.partitionBy("cls", "number")
    ranked = shared.join(pivots, "region").withColumn("i", F.row_number().over(own.orderBy(F.col("p").desc(), "region"))).withColumn("n", F.count("*").over(own))
    left = written(ranked.filter(F.col("i") <= F.col("n") - F.col("need") + 1).select("region", "p", "cls"))
    cells = written(left.join(left.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1").select("region"), "region", "left_semi").select("p", "cls").distinct())
    dropped(left)
    return cells


def uncovered(cells: DataFrame) -> DataFrame:
    """``cells`` (p, cls) without those whose classes are all in one cell of a more central pivot, where each pair of them meets.

    That cell may be left out likewise, but then for one that has its classes and is more central still; the last of these stays."""
    homes = cells.groupBy("cls").agg(F.max("p").alias("home"))
    over = cells.join(homes, "cls").groupBy("p").agg(F.min("home").alias("over"), F.count("*").alias("n")).filter("over > p")
    inside = cells.join(over, "p").join(cells.select(F.col("p").alias("over"), "cls"), ["over", "cls"], "left_semi")
    covered = inside.groupBy("p", "n").agg(F.count("*").alias("inside")).filter("inside = n").select("p")
    return cells.join(covered, "p", "left_anti")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """The sets of the wanted classes (cls, and id and tid of one text that has it), as bytes."""
    wanted = small(wanted.select(F.col("cls").alias("_cls"), F.col("rep.id").alias("_rep"), F.col("rep.tid").alias("_tid")), MOST_KEYS)
    source = docs.select(F.col(id_col).alias("id"), _text_hash(text).alias("tid"), F.col(text).alias("text"))
    source = source.join(wanted, F.col("id").eqNullSafe(F.col("_rep")) & (F.col("tid") == F.col("_tid"))).select("_cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                cls, raw = [], []
                for c, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), k), strict=True):
                    if _class_of(s) == c:
                        cls.append(c)
                        raw.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(raw, pa.binary())], names=["cls", "raw"])

    return source.mapInArrow(released(run), "cls long, raw binary").dropDuplicates(["cls"])


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b and more) with the sets of a and b, last."""
    left = sets.select(F.col("cls").alias("a"), F.col("raw").alias("ra"))
    right = sets.select(F.col("cls").alias("b"), F.col("raw").alias("rb"))
    return pairs.join(right, "b").join(left, "a").select(*pairs.columns, "ra", "rb")


def _only(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the classes a and b of ``pairs``."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    return sets.join(small(wanted, MOST_KEYS), "cls", "left_semi")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with linked, apart (the size of the symmetric difference) and the sizes na and nb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, apart, na, nb = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - common
                linked.append(100 * common >= percent * union)
                apart.append(union - common)
                na.append(len(p))
                nb.append(len(q))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(linked, pa.bool_()), *(pa.array(x, pa.int64()) for x in (apart, na, nb))], names=["a", "b", "linked", "apart", "na", "nb"])

    return _both(pairs.select("a", "b"), sets).mapInArrow(released(run), "a long, b long, linked boolean, apart long, na long, nb long")


def reach(m: int, n: int, n_pivot: int, percent: int) -> tuple[int, int]:
    """How many first elements of a deviation of m (of a set of n, from a pivot of n_pivot) count: those of an open member, and those
    by which an open one finds this one."""
    least = max(1, -((100 - percent) * n // percent - m))
    half = (m * (100 + percent) + (100 - percent) * (n_pivot - n)) // (2 * (100 + percent))
    return m - least + 1, m - half


def _bitmaps(elements: np.ndarray) -> list[int]:
    """MAPS longs with the bits of the elements' hashes: those of two sets differ in no more bits than the sets in elements."""
    bit = _mixed(elements + np.uint64(0x5BD1E995)) % np.uint64(64 * MAPS)
    out = np.zeros(MAPS, np.uint64)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64).tolist()


def deviations(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``members`` (cell, a, b, comp, open, apart, na, nb) with the first elements of their deviations, lx and ly of them, and the bitmaps of both parts."""
    source = _both(members.select("cell", "a", "b", "comp", "open", "apart", "na", "nb"), _only(sets, members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lx, ly, elements, maps = [], [], [], []
            columns = [batch.column(i).to_pylist() for i in (4, 5, 6, 7)]
            for is_open, m, n_pivot, n, x, y in zip(*columns, batch.column(8), batch.column(9), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                own, other = reach(m, n, n_pivot, percent)
                lx.append(own if is_open else 0)
                ly.append(other)
                new, gone = np.setdiff1d(q, p, assume_unique=True), np.setdiff1d(p, q, assume_unique=True)
                maps.append(_bitmaps(new) + _bitmaps(gone))
                dev = np.concatenate([new, gone])
                elements.append(dev[: max(lx[-1], other)].astype(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in elements])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(elements) if elements else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:6], batch.column(7), pa.array(lx, pa.int64()), pa.array(ly, pa.int64()), lists, pa.array(maps, pa.list_(pa.int64()))], names=["cell", "b", "comp", "open", "apart", "nb", "lx", "ly", "dev", "maps"])

    return source.mapInArrow(released(run), "cell long, b long, comp long, open boolean, apart long, nb long, lx long, ly long, dev array<long>, maps array<long>")


def _least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges the nodes, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        for side in (a, b):
            np.minimum.at(after, label[side], least)
            np.minimum.at(after, side, least)
        after = after[after]
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b) the least node that each node reaches: (cls, comp). Large and small stars in turn until stable, or until so
    few edges are left that one task finishes them."""
    edges = written(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if parts:
            nodes, least = _least_reached(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["cls", "comp"])

    before = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen["n"] <= FEW_EDGES:
            return written(edges.coalesce(1).mapInArrow(released(finished), "cls long, comp long"))
        if seen == before:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("comp"))
        before = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        top = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(top, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        after = written(small_star)
        dropped(edges)
        edges = after


def _roles(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Open members as x, all members as y."""
    names = {"b": "{}", "comp": "c{}", "apart": "m{}", "nb": "n{}"}
    x, y = ([F.col(c).alias(form.format(role)) for c, form in names.items()] for role in "xy")
    return rows.filter("open").select("cell", *x, *more), rows.select("cell", *y, F.col("open").alias("oy"), *more)


def _window(percent: int) -> tuple[Column, Column]:
    """The largest symmetric difference of linked x and y, and whether their distances from the pivot allow a link that is still wanted."""
    most = F.floor((100 - percent) * (F.col("nx") + F.col("ny")) / (100 + percent))
    once = ~F.col("oy") | (F.col("x") < F.col("y"))  # of two open members one looks for the other
    near = F.abs(F.col("mx") - F.col("my")) <= most
    return most, near & (F.col("cx") != F.col("cy")) & (F.abs(F.col("nx") - F.col("ny")) <= most) & once


def _candidates(members: DataFrame, sets: DataFrame, percent: int, split: bool) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) to compare; the cells with too many, which are left out if they are to be split."""
    most, wanted = _window(percent)
    x, y = _roles(members.filter(F.col("n") <= SMALL))
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    out = x.join(y, "cell").filter(wanted).select(*pair)
    large = members.filter(F.col("n") > SMALL)
    if large.isEmpty():
        return out.distinct(), None
    dev = written(deviations(large, sets, percent))
    x, y = _roles(dev, "lx", "ly", "dev", "maps")
    x = x.select("*", F.posexplode(F.slice("dev", F.lit(1), F.col("lx").cast("int"))).alias("i", "e")).drop("lx", "ly", "dev")
    y = y.select("*", F.posexplode(F.slice("dev", F.lit(1), F.col("ly").cast("int"))).alias("j", "e")).drop("lx", "ly", "dev").withColumnRenamed("maps", "other")
    # both deviations begin early enough for as many common elements as a link needs
    common = F.floor((F.col("mx") + F.col("my") - most + 1) / 2)
    early = (F.col("i") <= F.col("mx") - common) & (F.col("j") <= F.col("my") - common)
    differ = sum((F.bit_count(F.get("maps", F.lit(k)).bitwiseXOR(F.get("other", F.lit(k)))) for k in range(2 * MAPS)), F.lit(0))
    found = written(x.join(y, ["cell", "e"]).filter(wanted & early & (differ <= most)).select("cell", *pair).distinct())
    dropped(dev)
    if not split:
        return out.unionByName(found.drop("cell")).distinct(), None
    dense = found.groupBy("cell").agg(F.count("*").alias("pairs")).join(large.groupBy("cell").agg(F.count("*").alias("n")), "cell")
    dense = written(dense.filter(F.col("pairs") > DENSE * F.col("n")).select("cell"))
    return out.unionByName(found.join(dense, "cell", "left_anti").drop("cell")).distinct(), dense


def _split(members: DataFrame, dense: DataFrame, score: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The Voronoi cells that dense ones fall into: as cells of the first level, with linked."""
    inside = members.join(dense, "cell", "left_semi").select("cell", "b", "home", "open")
    ranked = Window.partitionBy("cell").orderBy(F.col("score").desc(), "b")
    pivots = inside.filter("open").join(score.withColumnRenamed("cls", "b"), "b").withColumn("k", F.row_number().over(ranked)).filter(F.col("k") <= PIVOTS)
    pivots = written(pivots.select("cell", F.col("b").alias("a")))
    pairs = written(inside.join(pivots, "cell").filter("a != b").select("cell", "a", "b", "home"))
    known = compared(pairs.select("a", "b").distinct(), sets, percent)
    placed = pairs.join(known, ["a", "b"]).withColumn("d", 2 * F.col("apart") / (F.col("na") + F.col("nb") + F.col("apart")))
    nearest = placed.groupBy("cell", "b").agg(F.min("d").alias("least"))
    placed = placed.join(nearest, ["cell", "b"]).join(pivots.withColumnRenamed("a", "b"), ["cell", "b"], "left_anti")
    inside = placed.filter(F.col("d") <= F.col("least") + 2 * (100 - percent) / 100 + 1e-9)
    home = F.col("home") & (F.col("d") <= F.col("least") + 1e-12)
    # pivots have met all others: they are no members, but their links count
    links = pairs.select("a", "b").distinct().join(known.filter("linked"), ["a", "b"])
    return written(inside.select(F.xxhash64("cell", "a").alias("cell"), "a", "b", home.alias("home"), "linked", "apart", "na", "nb").unionByName(
        links.select(F.lit(None).cast("long").alias("cell"), "a", "b", F.lit(False).alias("home"), "linked", "apart", "na", "nb")))


def _components_with(links: list[DataFrame]) -> DataFrame:
    return components(reduce(DataFrame.unionByName, links))


def joined(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, also: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: id, the columns named in ``also``, n_shingles, component_id, the least id reachable by links of Jaccard similarity of ``percent`` or more, and
    stays, true for the row of that id (a null one if there is no other; of equal ids that of the least text hash) and for rows with an empty set."""
    importable(docs.sparkSession)
    spark = docs.sparkSession
    rows = written(described(docs, id_col, text, k, percent, also))
    classes = rows.filter("n_shingles > 0").groupBy("cls").agg(F.min(F.struct("id", "tid")).alias("rep"), F.first("n_regions").alias("n_regions"))
    entries = classes.agg(F.sum("n_regions")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // IN_TASK + 1)
    shared = written(met(docs, text, k, percent, tasks))
    let_go(spark)
    shared = peeled(shared)
    # the more others a class meets in its regions, the nearer it is to the middle of them
    sizes = shared.groupBy("region").agg((F.count("*") - 1).alias("others"))
    score = shared.join(sizes, "region").groupBy("cls").agg(F.sum("others").alias("others"))
    score = written(score.join(classes, "cls").select("cls", "rep", (F.col("others") / F.col("n_regions")).alias("score")))
    sets = written(_sets(docs, score, id_col, text, k))
    let_go(spark)
    of_pivots = first_met(shared, score)
    pairs = written(uncovered(of_pivots).select(F.col("p.cls").alias("a"), F.col("cls").alias("b")).filter("a != b"))
    dropped(of_pivots)
    dropped(shared)
    let_go(spark)
    cells = written(compared(pairs, sets, percent).select(F.col("a").alias("cell"), "a", "b", F.lit(True).alias("home"), "linked", "apart", "na", "nb"))
    links = [written(cells.filter("linked").select("a", "b"))]
    comps = _components_with(links)
    for level in range(DEPTH + 1):
        let_go(spark)
        own = comps.select(F.col("cls").alias("b"), "comp")
        now = cells.filter("cell is not null").join(own, "b", "left").join(comps.select(F.col("cls").alias("a"), F.col("comp").alias("of_pivot")), "a", "left")
        now = now.withColumn("comp", F.coalesce("comp", "b")).withColumn("open", F.col("home") & (F.col("comp") != F.coalesce("of_pivot", "a")))
        busy = now.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("open").alias("n_open")).filter("n > 1 and n_open > 0").select("cell", "n")
        members = written(now.join(busy, "cell").select("cell", "a", "b", "home", "comp", "open", "apart", "na", "nb", "n"))
        dropped(cells)
        found, dense = _candidates(members, sets, percent, split=level < DEPTH)
        found = written(found)
        found = written(compared(found, _only(sets, found), percent).filter("linked").select("a", "b"))
        links.append(found)
        if dense is None or dense.isEmpty():
            comps = _components_with(links) if not found.isEmpty() else comps
            break
        cells = _split(members, dense, score, sets, percent)
        links.append(written(cells.filter("linked").select("a", "b")))
        comps = _components_with(links)
    dropped(sets)
    return _named(rows, comps, id_col, also)


def _named(rows: DataFrame, comps: DataFrame, id_col: str, also: tuple[str, ...]) -> DataFrame:
    """The rows with the least id of their component; a class in none is one of its own."""
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tid"))
    least = rows.filter("n_shingles > 0").groupBy("cls").agg(best.alias("least")).join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = least.groupBy("comp").agg(F.min("least").alias("first"))
    of_class = least.join(named, "comp").select("cls", F.col("first.id").alias("component_id"), F.col("first.tid").alias("_first"))
    out = rows.withColumn("cls", F.when(F.col("n_shingles") > 0, F.col("cls"))).join(of_class, "cls", "left")
    stays = F.col("_first").isNull() | (F.col("id").eqNullSafe(F.col("component_id")) & (F.col("tid") == F.col("_first")))
    return out.select(F.col("id").alias(id_col), *also, "n_shingles", F.coalesce("component_id", "id").alias("component_id"), stays.alias("stays"))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents", "doc_id", "text"), k=3, percent=90).drop("stays")
