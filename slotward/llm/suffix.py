"""Suffix arrays of byte strings by induced sorting, and permuted common prefixes, in numpy.

Induction runs bucket by bucket: the entries of a bucket are read in blocks, and what a block induces is dealt
to its buckets by one stable sort, so the work is linear and the loop is over buckets, not bytes. The reduced
string of leftmost-smaller substrings has too many letters for that; its suffixes are ranked by doubling.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF  # never a byte of UTF-8


def classified(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix is larger than the empty one."""
    step = np.zeros(len(text), dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _deal(found: np.ndarray, text: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append positions to the buckets of their letters, in order."""
    if not len(found):
        return
    letters = text[found]
    order = np.argsort(letters, kind="stable")
    found, letters = found[order], letters[order]
    cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    for part in np.split(found, cuts):
        buckets[text[part[0]]].append(part)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def induced(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(lms, text, seeds)
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[text[-1]].append(np.array([len(text) - 1]))
    for c in range(256):
        taken = 0
        while taken < len(large[c]):  # a block may induce into its own bucket
            block = _joined(large[c][taken:])
            taken = len(large[c])
            _induce(block, text, ~smaller, large)
        _induce(_joined(seeds[c]), text, ~smaller, large)
    small: list[list[np.ndarray]] = [[] for _ in range(256)]  # from the end of each bucket
    for c in range(255, -1, -1):
        taken = 0
        while taken < len(small[c]):
            block = _joined(small[c][taken:])
            taken = len(small[c])
            _induce(block, text, smaller, small)
        _induce(_joined(large[c])[::-1], text, smaller, small)
    return _joined([x for c in range(256) for x in (_joined(large[c]), _joined(small[c])[::-1])])


def _induce(block: np.ndarray, text: np.ndarray, kind: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    before = block[block > 0] - 1
    _deal(before[kind[before]], text, buckets)


def ranked(names: np.ndarray) -> np.ndarray:
    """Suffixes of a string of integers in order, by doubling."""
    rank, width = names.astype(np.int64), 1
    while True:
        beyond = np.zeros(len(rank), dtype=np.int64)
        beyond[:-width] = rank[width:] + 1 if width < len(rank) else 0
        key = rank * (int(rank.max()) + 2) + beyond
        order = np.argsort(key, kind="stable")
        new = np.r_[False, key[order][1:] != key[order][:-1]]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == len(rank) - 1 or width >= len(rank):
            return order
        width *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a uint8 array in order."""
    if len(text) < 2:
        return np.arange(len(text))
    smaller = classified(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return induced(text, smaller, lms)
    first = induced(text, smaller, lms)  # sorts the leftmost-smaller substrings
    is_lms = np.zeros(len(text), dtype=bool)
    is_lms[lms] = True
    sorted_lms = first[is_lms[first]]
    number = np.empty(len(text), dtype=np.int64)
    number[lms] = np.arange(len(lms))
    ends = np.append(lms[1:] + 1, len(text))  # a substring runs to the next one's first letter
    size = (ends - lms)[number[sorted_lms]]
    new = np.ones(len(lms), dtype=bool)
    same = np.flatnonzero(size[1:] == size[:-1]) + 1
    new[same] = ~_equal(text, sorted_lms[same - 1], sorted_lms[same], size[same])
    last = len(lms) - 1
    new |= number[sorted_lms] == last  # the last one ends with the text
    new[1:] |= number[sorted_lms[:-1]] == last
    names = np.empty(len(lms), dtype=np.int64)
    names[number[sorted_lms]] = np.cumsum(new) - 1
    order = np.argsort(names, kind="stable") if new.all() else ranked(names)
    return induced(text, smaller, lms[order])


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether text[a:a+size] equals text[b:b+size], item by item."""
    alike, live, k = np.ones(len(a), dtype=bool), np.arange(len(a)), 0
    while len(live):
        ok = text[a[live] + k] == text[b[live] + k]
        alike[live[~ok]] = False
        k += 1
        live = live[ok]
        live = live[size[live] > k]
    return alike


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix that order[i] shares with order[i-1] (0 first), by permuted common prefixes.

    In text order a value falls by one from position to position unless the letters before the two suffixes
    differ; only those irreducible values are compared, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    paired = before >= 0
    reducible = paired & (at > 0) & (before > 0)
    reducible[reducible] = text[at[reducible] - 1] == text[before[reducible] - 1]
    first = np.flatnonzero(paired & ~reducible)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
    length = np.zeros(n, dtype=np.int64)
    live = first
    while len(live):
        a, b = live + length[live], before[live] + length[live]
        inside = np.maximum(a, b) + 8 <= n
        equal = np.zeros(len(live), dtype=bool)
        equal[inside] = (wide[a[inside]] == wide[b[inside]]).all(axis=1)
        length[live[equal]] += 8
        rest = live[~equal]
        for _ in range(7):
            a, b = rest + length[rest], before[rest] + length[rest]
            fits = np.maximum(a, b) < n
            rest, a, b = rest[fits], a[fits], b[fits]
            rest = rest[text[a] == text[b]]
            length[rest] += 1
        live = live[equal]
    anchor = np.maximum.accumulate(np.where(reducible, -1, at))
    length = np.where(reducible, np.maximum(length[anchor] - (at - anchor), 0), length)
    return length[order]
