"""Suffix order with common-prefix values by external induced sorting, to a bounded depth.

A suffix is S if it is less than the next one, else L; an S suffix after an L one is a seed. Seeds are ordered first.
Scanning all suffixes upwards induces the L ones: whoever is taken from a bucket pushes the suffix one to its left into
the bucket of that suffix's first byte. Scanning downwards induces the S ones likewise. Buckets are queues of (place,
common prefix with the one before) tuples that live on disk once they exceed their share of memory. What two neighbours in a bucket have in common is one more than the least common prefix
between the tuples that pushed them, which is carried along.

Depth is bounded: neighbours that agree in ``depth`` bytes count as equal, in any order. That is why seeds need no further
recursion: they are ordered by radix on words of eight bytes, of which depth / 8 rounds suffice, each over those still tied.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs

#: Bytes that the queues of one scan keep in memory before they go to disk.
IN_MEMORY = 4 << 20
TUPLE = np.dtype([("place", "<i4"), ("prefix", "u1")])


class Queues:
    """One queue of (place, prefix) tuples per first byte, served in byte order; what exceeds the memory goes to the shared folder.

    A spill is one file with the tuples of all queues, one after the other, and an index that stays in memory. A queue is read
    from its part of each spill, in the order of pushes. Without a folder that this process can open, all stays in memory; blocks are
    bounded, and so are their queues. Files are removed as soon as the scan is over, and by the job's driver if a task was lost."""

    def __init__(self, folder: str | None = None, most: int | None = None):
        self.most, self.held, self.spills = most or IN_MEMORY, 0, []
        self.parts: list[list[np.ndarray]] = [[] for _ in range(256)]
        self.store = None
        if folder:
            try:
                self.store, self.folder = fs.FileSystem.from_uri(folder)
            except (OSError, ValueError, NotImplementedError):
                self.store = None

    def push(self, bucket: int, place: np.ndarray, prefix: np.ndarray) -> None:
        tuples = np.empty(len(place), TUPLE)
        tuples["place"], tuples["prefix"] = place, prefix
        self.parts[bucket].append(tuples)
        self.held += tuples.nbytes
        if self.store is not None and self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        path, index, at = f"{self.folder}/{uuid.uuid4().hex}", {}, 0
        self.store.create_dir(self.folder, recursive=True)
        with self.store.open_output_stream(path) as f:
            for bucket, parts in enumerate(self.parts):
                if parts:
                    index[bucket] = at, sum(map(len, parts))
                    for x in parts:
                        f.write(x.tobytes())
                        at += x.nbytes
                    parts.clear()
        self.spills.append((path, index))
        self.held = 0

    def pop(self, bucket: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a bucket in the order of their pushes; the queue is empty then."""
        out = []
        for path, index in self.spills:
            if bucket in index:
                at, n = index.pop(bucket)
                with self.store.open_input_file(path) as f:
                    out.append(np.frombuffer(f.read_at(n * TUPLE.itemsize, at), TUPLE))
        parts, self.parts[bucket] = self.parts[bucket], []
        self.held -= sum(x.nbytes for x in parts)
        return [(np.ascontiguousarray(x["place"]), np.ascontiguousarray(x["prefix"])) for x in out + parts]

    def close(self) -> None:
        for path, _ in self.spills:
            self.store.delete_file(path)
        self.spills = []


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a..b] for each pair, ends included, by a sparse table."""
    span = b - a + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(a), values.dtype)
    row, k = values, 0
    top = int(level.max()) if len(level) else 0
    while True:
        here = level == k
        if here.any():
            out[here] = np.minimum(row[a[here]], row[b[here] - (1 << k) + 1])
        if k == top:
            return out
        row = np.minimum(row[: len(row) - (1 << k)], row[1 << k :])
        k += 1


def _common(text: np.ndarray, p: int, q: int, depth: int) -> int:
    n = min(depth, len(text) - max(p, q))
    apart = np.flatnonzero(text[p : p + n] != text[q : q + n])
    return int(apart[0]) if len(apart) else n


def _seeds(text: np.ndarray, seeds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds in order, and what each has in common with the one before."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    n = len(text) + depth + 8
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j : j + n]
    order = seeds[np.argsort(words[seeds], kind="stable")]
    prefix = np.full(len(order), depth, np.uint8)
    if len(order):
        prefix[0] = 0
    tied = np.arange(len(order))
    group = np.zeros(len(order), np.int64)
    for r in range(0, depth, 8):
        if r:
            key = words[order[tied] + r]
            resort = np.lexsort((key, group))
            order[tied] = order[tied][resort]
        key = words[order[tied] + r]
        apart = key[1:] ^ key[:-1]
        split = (group[1:] == group[:-1]) & (apart != 0)
        lead = (63 - np.frexp((apart[split] >> np.uint64(11)).astype(np.float64))[1] + 1) - 11
        big = apart[split] < np.uint64(1 << 11)
        lead = np.where(big, 64 - np.frexp(apart[split].astype(np.float64))[1], lead)
        prefix[tied[1:][split]] = np.minimum(depth, r + lead // 8)
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (apart != 0)
        ids = np.cumsum(fresh)
        sizes = np.bincount(ids)
        keep = sizes[ids] > 1
        tied, group = tied[keep], ids[keep]
        if not len(tied):
            break
    prefix[1:] = np.minimum(prefix[1:], len(text) - np.maximum(order[1:], order[:-1]))  # not what lies beyond the end
    return order, prefix


def _pushed(queues: Queues, text: np.ndarray, place: np.ndarray, prefix: np.ndarray, run: np.ndarray, wanted: np.ndarray, own: int, depth: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pushes the left neighbours of those wanted; ``run`` has, for each bucket, the least prefix since its last push.

    What falls into the bucket ``own`` itself is returned."""
    at = np.flatnonzero(wanted)
    total = int(prefix.min()) if len(prefix) else 255
    if not len(at):
        np.minimum(run, total, out=run)
        return None
    left = place[at] - 1
    first = text[left]
    order = np.argsort(first, kind="stable")
    at, left, first = at[order], left[order], first[order]
    heads = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    from_ = np.empty(len(at), np.int64)
    from_[1:] = at[:-1] + 1
    from_[heads] = 0
    shared = _least(prefix, from_, at).astype(np.int64)
    shared[heads] = np.minimum(shared[heads], run[first[heads]])
    made = np.minimum(shared + 1, depth).astype(np.uint8)
    ends = np.concatenate([heads[1:], [len(at)]])
    np.minimum(run, total, out=run)
    last = at[ends - 1]
    tails = np.where(last + 1 < len(prefix), _least(prefix, np.minimum(last + 1, len(prefix) - 1), np.full(len(last), len(prefix) - 1)), 255)
    run[first[heads]] = tails
    back = None
    for h, e in zip(heads, ends, strict=True):
        bucket = int(first[h])
        if bucket == own:
            back = (left[h:e], made[h:e])
        else:
            queues.push(bucket, left[h:e], made[h:e])
    return back


def ordered(text: np.ndarray, depth: int = 200, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of a text (uint8) in order, and what each has in common with the one before, both up to ``depth`` (< 255).

    Queues spill below ``folder``."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    # the type of a place is that of the next place with another byte, by comparison with it; the end is less than all
    change = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    small = np.concatenate([text[change[:-1]] < text[change[:-1] + 1], [False]])
    is_s = np.repeat(small, np.diff(np.concatenate([[-1], change])))
    seeds = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + np.int32(1)
    order, prefix = _seeds(text, seeds, depth)
    bounds = np.searchsorted(text[order], np.arange(257))
    queues = Queues(folder)
    upper: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(256)]
    # the end of the text comes first and pushes the last place
    queues.push(int(text[-1]), np.array([n - 1], np.int32), np.zeros(1, np.uint8))
    try:
        for c in range(256):
            run = np.zeros(256, np.int64)
            last = -1
            pending = queues.pop(c)
            first_of_bucket = True
            while pending:
                place = np.concatenate([a for a, _ in pending])
                shared = np.concatenate([b for _, b in pending])
                if first_of_bucket:
                    shared[0] = 0
                    first_of_bucket = False
                upper[c].append((place, shared))
                last = int(place[-1])
                back = _pushed(queues, text, place, shared, run, (place > 0) & (text[place - 1] >= c), c, depth)
                pending = [back] if back else []
            a, b = bounds[c], bounds[c + 1]
            if b > a:
                place, shared = order[a:b], prefix[a:b].copy()
                shared[0] = _common(text, last, int(place[0]), depth) if last >= 0 else 0
                _pushed(queues, text, place, shared, run, (place > 0) & (text[place - 1] > c), c, depth)
        queues.close()
        # downwards: a tuple's prefix is what it has in common with the one after it (the one pushed before it)
        queues = Queues(folder)
        lower: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(256)]
        for c in range(255, -1, -1):
            run = np.zeros(256, np.int64)
            last = -1
            pending = queues.pop(c)
            first_of_bucket = True
            while pending:
                place = np.concatenate([a for a, _ in pending])
                shared = np.concatenate([b for _, b in pending])
                if first_of_bucket:
                    shared[0] = 0
                    first_of_bucket = False
                lower[c].append((place, shared))
                last = int(place[-1])
                back = _pushed(queues, text, place, shared, run, (place > 0) & (text[place - 1] <= c) & is_s[place - 1], c, depth)
                pending = [back] if back else []
            if upper[c]:
                place = np.concatenate([a for a, _ in upper[c]])[::-1]
                up = np.concatenate([b for _, b in upper[c]])
                shared = np.concatenate([[0], up[::-1][:-1]]).astype(np.uint8)
                shared[0] = _common(text, int(place[0]), last, depth) if last >= 0 else 0
                _pushed(queues, text, place, shared, run, (place > 0) & (text[place - 1] < c), c, depth)
    finally:
        queues.close()
    places, prefixes = [], []
    for c in range(256):
        if upper[c]:
            places += [a for a, _ in upper[c]]
            prefixes += [b for _, b in upper[c]]
        if lower[c]:
            down = np.concatenate([a for a, _ in lower[c]])
            shared = np.concatenate([b for _, b in lower[c]])
            up = np.concatenate([[0], shared[::-1][:-1]]).astype(np.uint8)
            up[0] = _common(text, int(places[-1][-1]), int(down[-1]), depth) if upper[c] else 0
            places.append(down[::-1])
            prefixes.append(up)
    return np.concatenate(places), np.concatenate(prefixes)
