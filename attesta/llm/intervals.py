"""Strings that share a long prefix with another place, from a Burrows-Wheeler transform.

Intervals of the suffix array are expanded breadth first: the intervals of all strings of one
length are extended backwards by every symbol to those of the next length. The place behind
an interval is where the common prefix of neighbours ends, so common prefixes come out in
increasing order, each once. The expansion stops at the least length: neighbours not parted
until then have a common prefix of that length or more.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by doubling; no two suffixes may be equal.

    `bits` is the width of a symbol. A key and its place are sorted as one number, which is
    much faster than sorting places by key.
    """
    n = len(symbols)
    place_bits = int(n).bit_length()
    if 3 * place_bits > 62:
        raise ValueError("too much text for one piece")
    packed = max(1, (62 - place_bits) // bits)
    key = np.zeros(n, dtype=np.int64)
    wide = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(packed, dtype=np.int64)])
    for i in range(packed):
        key = (key << bits) | wide[i:i + n]
    size, places = packed, np.arange(n, dtype=np.int64)
    rank = np.empty(n, dtype=np.int64)
    while True:
        ordered = np.sort((key << place_bits) | places)
        order = ordered & ((1 << place_bits) - 1)
        ordered >>= place_bits
        rank_at = np.zeros(n, dtype=np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=rank_at[1:])
        rank[order] = rank_at
        if rank_at[-1] == n - 1:
            return order, rank
        key = (rank << place_bits)
        if size < n:
            key[:n - size] |= rank[size:] + 1
        size *= 2


def common_prefixes(strings: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array over the strings, each behind a separator of its own; `parted`: whether
    the common prefix with the suffix before is shorter than `least`)."""
    m = len(strings)
    raw = np.frombuffer(b"".join(strings), dtype=np.uint8)
    present = np.unique(raw)
    code = np.zeros(256, dtype=np.int64)
    code[present] = np.arange(len(present))
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=m)
    n = len(raw) + m
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.empty(n, dtype=np.int64)
    is_end = np.zeros(n, dtype=bool)
    is_end[ends] = True
    symbols[is_end] = np.arange(m)
    symbols[~is_end] = code[raw] + m
    order, rank = suffix_array(symbols, int(m + len(present) + 1).bit_length())

    before = np.where(order == 0, n - 1, order - 1)
    back = rank[before]
    last = symbols[before]
    sigma = len(present)
    # seen[i, c]: how often symbol c stands in the transform before row i.
    # Small numbers for small pieces: the table is what the caches have to hold.
    by_symbol = np.zeros((sigma, n + 1), dtype=np.int16 if n < 1 << 15 else np.int32)
    plain = np.nonzero(last >= m)[0]
    by_symbol[last[plain] - m, plain + 1] = 1
    np.cumsum(by_symbol, axis=1, dtype=by_symbol.dtype, out=by_symbol)
    seen = np.ascontiguousarray(by_symbol.T)
    first = m + np.concatenate([[0], np.cumsum(seen[n])])

    parted = np.zeros(n + 1, dtype=bool)
    parted[0] = parted[n] = True
    single = np.arange(m)
    low, high = first[:-1], first[1:]
    lone = high - low == 1
    single = np.concatenate([single, low[lone]])
    low, high = low[~lone], high[~lone]
    parted[single + 1] = True
    parted[high] = True
    for _ in range(least - 1):
        if not len(single) and not len(low):
            break
        # A string found once is found once with any symbol before it.
        single = back[single]
        single = single[~parted[single + 1]]
        if len(low):
            begin, count = seen[low], seen[high]
            count -= begin
            row, c = np.nonzero(count)
            low = first[c] + begin[row, c]
            high = low + count[row, c]
            fresh = ~parted[high]
            low, high = low[fresh], high[fresh]
            lone = high - low == 1
            single = np.concatenate([single, low[lone]])
            parted[high] = True
            low, high = low[~lone], high[~lone]
        parted[single + 1] = True
    return order, parted[:n]


def repeated_starts(strings: list[bytes], places: np.ndarray, often: np.ndarray,
                    least: int) -> list[np.ndarray]:
    """Per string, the offsets where a string of `least` bytes begins that begins elsewhere too.

    places: a number per string; offset i of a string is the place `places + i`, and equal
    places are one place. often: strings that stand for more than one place.
    """
    order, parted = common_prefixes(strings, least)
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    owner = np.repeat(np.arange(len(strings)), lengths + 1)[order]
    offset = order - begins[owner]
    runs = np.nonzero(parted)[0]
    place = places[owner] + offset
    shared = ((np.minimum.reduceat(place, runs) != np.maximum.reduceat(place, runs))
              | np.logical_or.reduceat(often[owner], runs))
    of_row = np.cumsum(parted) - 1
    hit = shared[of_row] & (offset + least <= lengths[owner])
    owner, offset = owner[hit], offset[hit]
    by = np.lexsort((offset, owner))
    owner, offset = owner[by], offset[by]
    return np.split(offset, np.searchsorted(owner, np.arange(1, len(strings))))
