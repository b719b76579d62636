"""Anchors: places picked by content alone, so that equal strings are picked at equal places.

A place is an anchor if the hash of the `GRAM` bytes there is the least of some stretch of
`STRETCH` places. Any string of `MATCH` bytes holds a whole stretch, hence an anchor, and
whatever string equals it has its anchor at the same offset.

A string may hold several anchors. It belongs to the first of those with the least hash, which
its own bytes decide, so every string belongs to one anchor and equal strings to equal ones.
"""

from __future__ import annotations

import numpy as np
import xxhash

MATCH = 200
GRAM = 100
STRETCH = MATCH - GRAM + 1
#: Most bytes of context before and behind an anchor's gram: its strings contain the gram.
SIDE = MATCH - GRAM
#: Bytes hashed at a time, so that memory does not grow with the text.
PART = 1 << 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every window, by doubling."""
    done, size = values, 1
    while size * 2 <= width:
        done = np.minimum(done[:-size], done[size:])
        size *= 2
    rest = width - size
    return np.minimum(done[:len(done) - rest], done[rest:]) if rest else done


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every gram, by doubling from single bytes."""
    h = data.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < GRAM:
        step = min(size, GRAM - size)
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ (h[step:] >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        size += step
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def find(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of the anchors of a text; none in texts shorter than a match."""
    if len(data) < MATCH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    raw, at, found = np.frombuffer(data, dtype=np.uint8), 0, []
    while True:
        # Parts overlap so that every stretch, and both sides of it, lie in one part.
        part = raw[at:at + PART + 2 * STRETCH + GRAM]
        h = gram_hashes(part)
        least = _least(h, STRETCH)
        # A place is picked if the largest of the minima around it is its own hash.
        most = np.zeros(len(h) + STRETCH - 1, dtype=np.uint64)
        most[STRETCH - 1:STRETCH - 1 + len(least)] = least
        most = ~_least(~most, STRETCH)
        picked = np.nonzero(most == h)[0]
        last = at + len(part) >= len(raw)
        lo, hi = (STRETCH if at else 0), (len(h) if last else PART + STRETCH)
        picked = picked[(picked >= lo) & (picked < hi)]
        found.append((picked + at, h[picked]))
        if last:
            return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        at += PART


def claims(at: np.ndarray, h: np.ndarray, begin: np.ndarray, last: np.ndarray) -> tuple:
    """(lo, hi): an anchor's strings are those that start at lo to hi; none if lo > hi.

    at, h: offsets and hashes of all anchors in order, of one text or of several laid behind
    one another; begin, last: where the first and the last string of an anchor's text start.
    """
    lo, hi = np.maximum(at - SIDE, begin), np.minimum(at, last)
    todo, k = np.arange(len(at)), 1
    while len(todo):  # up to the nearest anchor before whose hash is not greater
        todo = todo[todo >= k]
        other = todo - k
        near = at[other] >= lo[todo]
        todo, other = todo[near], other[near]
        ends = h[other] <= h[todo]
        lo[todo[ends]] = at[other[ends]] + 1
        todo, k = todo[~ends], k + 1
    todo, k = np.arange(len(at)), 1
    while len(todo):  # and to the nearest one behind whose hash is less
        todo = todo[todo < len(at) - k]
        other = todo + k
        near = at[other] - STRETCH < hi[todo]
        todo, other = todo[near], other[near]
        ends = h[other] < h[todo]
        hi[todo[ends]] = at[other[ends]] - STRETCH
        todo, k = todo[~ends], k + 1
    return lo, hi


def context_hash(data: memoryview, begin: int, end: int, at: int) -> int:
    """Of the context from `begin` to `end` and the anchor's offset in it."""
    return xxhash.xxh3_64_intdigest(data[begin:end], at - begin)
