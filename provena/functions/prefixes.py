"""SHA-256 that can be stored midway and go on, for many messages side by side.

The library's digest objects cannot be stored, so a chain over all bytes of a log could not cross batches of a stream. Here the
state of a message is its midstate (eight words), the bytes behind its last whole block, and its size. Blocks of one message follow each other,
but messages don't: they are lanes of NumPy arrays, as are all the paddings that finish a digest. Few lanes are faster as plain numbers."""

from __future__ import annotations

from math import isqrt
from typing import NamedTuple

import numpy as np

BLOCK, FEW, LANES, MASK = 64, 24, 1 << 14, 0xFFFFFFFF


def _root_bits(n: int, k: int) -> int:
    """The first 32 bits behind the point of the k-th root of n (k is 2 or 3), found in whole numbers."""
    if k == 2:
        return isqrt(n << 64) & MASK
    low, high = 0, 1 << 40
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**3 <= n << 96 else (low, mid)
    return low & MASK


PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, isqrt(n) + 1))]
FIRST, ADDED = [_root_bits(p, 2) for p in PRIMES[:8]], [_root_bits(p, 3) for p in PRIMES[:64]]


class Prefix(NamedTuple):
    """A message so far: midstate (32 bytes), what is left of the last block, and bytes in all."""

    midstate: bytes
    rest: bytes
    size: int


EMPTY = Prefix(np.array(FIRST, ">u4").tobytes(), b"", 0)


def _turn(x, n: int):
    return (x >> n | x << (32 - n)) & MASK


def compressed(state: list, block: list) -> list:
    """The eight words after a block of sixteen; words are numbers, or arrays with a lane for each message."""
    w, (a, b, c, d, e, f, g, h) = list(block), state
    for i in range(64):
        if i > 15:
            x, y = w[i - 15], w[i - 2]
            w.append((w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> 3) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ y >> 10)) & MASK)
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (e & f ^ (e ^ MASK) & g) + ADDED[i] + w[i]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, h = (one + two) & MASK, a, b, c, (d + one) & MASK, e, f, g
    return [(x + y) & MASK for x, y in zip(state, (a, b, c, d, e, f, g, h), strict=True)]


def _lanes(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """``states`` (n, 8) after ``blocks`` (n, 64 bytes); both results and words are 64 bits wide, so that sums don't overflow."""
    words = blocks.view(">u4").astype(np.uint64)
    if len(states) < FEW:
        return np.array([compressed(list(map(int, s)), list(map(int, w))) for s, w in zip(states, words, strict=True)], np.uint64).reshape(-1, 8)
    return np.stack(compressed(list(states.T), list(words.T)), 1)


def _finished(midstates: np.ndarray, rests: list[bytes], sizes: list[int]) -> list[str]:
    """Digests of messages from their last midstates, in slices of bounded size."""
    out: list[str] = []
    for at in range(0, len(rests), LANES):
        some, long = midstates[at : at + LANES].copy(), [len(r) > 55 for r in rests[at : at + LANES]]
        padded = [r + b"\x80" + bytes((119 if two else 55) - len(r)) + (8 * n).to_bytes(8, "big") for r, n, two in zip(rests[at : at + LANES], sizes[at : at + LANES], long, strict=True)]
        two = np.flatnonzero(long)
        if len(two):
            some[two] = _lanes(some[two], np.frombuffer(b"".join(padded[i][:BLOCK] for i in two), np.uint8).reshape(-1, BLOCK))
        some = _lanes(some, np.frombuffer(b"".join(p[-BLOCK:] for p in padded), np.uint8).reshape(-1, BLOCK))
        out += [row.astype(">u4").tobytes().hex() for row in some]
    return out


def advanced(prefixes: list[Prefix], pieces: list[list[bytes]]) -> tuple[list[list[str]], list[Prefix]]:
    """Per message the digests before its first piece and after each, and the message with all of them."""
    wholes = [p.rest + b"".join(more) for p, more in zip(prefixes, pieces, strict=True)]
    ends = [np.cumsum([len(p.rest), *map(len, more)]) for p, more in zip(prefixes, pieces, strict=True)]
    order = sorted(range(len(wholes)), key=lambda i: -len(wholes[i]))  # lanes that have ended are at the end
    states = np.array([np.frombuffer(prefixes[i].midstate, ">u4") for i in order], np.uint64).reshape(-1, 8)
    blocks = [len(wholes[i]) // BLOCK for i in order]
    needed = [set((ends[i] // BLOCK).tolist()) for i in order]
    kept: list[dict[int, np.ndarray]] = [{0: states[k].copy()} for k in range(len(order))]
    active = len(order)
    for n in range(max(blocks, default=0)):
        while active and blocks[active - 1] <= n:
            active -= 1
        data = np.frombuffer(b"".join(wholes[order[k]][n * BLOCK : (n + 1) * BLOCK] for k in range(active)), np.uint8).reshape(-1, BLOCK)
        states[:active] = _lanes(states[:active], data)
        for k in range(active):
            if n + 1 in needed[k]:
                kept[k][n + 1] = states[k].copy()
    at = {i: k for k, i in enumerate(order)}
    midstates, rests, sizes = [], [], []
    for i, (p, whole) in enumerate(zip(prefixes, wholes, strict=True)):
        for end in ends[i].tolist():
            midstates.append(kept[at[i]][end // BLOCK])
            rests.append(whole[end // BLOCK * BLOCK : end])
            sizes.append(p.size - len(p.rest) + end)
    digests, out, first = _finished(np.array(midstates, np.uint64).reshape(-1, 8), rests, sizes), [], 0
    for e in ends:
        out.append(digests[first : first + len(e)])
        first += len(e)
    last = [Prefix(states[at[i]].astype(">u4").tobytes(), whole[len(whole) // BLOCK * BLOCK :], p.size + len(whole) - len(p.rest)) for i, (p, whole) in enumerate(zip(prefixes, wholes, strict=True))]
    return out, last
