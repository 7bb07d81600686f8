"""Suffix arrays by induced sorting, and permuted common prefixes, vectorised in numpy.

Induction is a scan over the array in which each suffix places the one before it. Here the scan moves in batches: all slots
up to the first that isn't filled yet are final, and what they place lies behind them, so a batch is a few array operations.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _ranks_in_runs(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by character, each element's rank within its character, and the characters with their counts."""
    order = np.argsort(chars, kind="stable")
    held = chars[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    counts = np.diff(np.append(first, len(held)))
    return order, np.arange(len(held)) - np.repeat(first, counts), held[first], counts


def _first(flags_of, at: int, end: int, step: int = 4096) -> int:
    """The first index from at on where the flags hold, else end."""
    while at < end:
        flags = flags_of(at, min(at + step, end))
        k = int(flags.argmax())
        if flags[k]:
            return at + k
        at += step
    return end


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, starts: np.ndarray, n_large: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost smaller suffixes."""
    n, k = len(s), len(n_large)
    sa = np.full(n, -1, np.int32)
    if len(lms):
        order, rank, chars, counts = _ranks_in_runs(s[lms])
        ends = starts[chars.astype(np.int64) + 1] - counts
        sa[np.repeat(ends, counts) + rank] = lms[order]
    filled = np.zeros(k, np.int64)
    sa[starts[s[-1]]] = n - 1  # what the empty suffix places
    filled[s[-1]] = 1
    at, bucket = 0, 0
    while at < n:
        bucket = _first(lambda a, b: filled[a:b] < n_large[a:b], bucket, k)
        end = n if bucket == k else int(starts[bucket] + filled[bucket])
        held = sa[at:end]
        before = held[held > 0] - 1
        before = before[~small[before]]
        if len(before):
            order, rank, chars, counts = _ranks_in_runs(s[before])
            chars = chars.astype(np.int64)
            sa[np.repeat(starts[chars] + filled[chars], counts) + rank] = before[order]
            filled[chars] += counts
        at = end
    n_small = np.diff(starts) - n_large
    small_from = starts[:-1] + n_large
    slots = np.repeat(small_from, n_small) + np.arange(int(n_small.sum())) - np.repeat(np.cumsum(n_small) - n_small, n_small)
    sa[slots] = -1
    filled = np.zeros(k, np.int64)
    at, bucket = n, k
    while at > 0:
        bucket = k - _first(lambda a, b: (filled[k - b : k - a] < n_small[k - b : k - a])[::-1], k - bucket, k)
        end = 0 if bucket == 0 else int(starts[bucket] - filled[bucket - 1])
        held = sa[end:at][::-1]
        before = held[held > 0] - 1
        before = before[small[before]]
        if len(before):
            order, rank, chars, counts = _ranks_in_runs(s[before])
            chars = chars.astype(np.int64)
            sa[np.repeat(starts[chars + 1] - 1 - filled[chars], counts) - rank] = before[order]
            filled[chars] += counts
        at = end
    return sa


def suffix_array(s: np.ndarray, k: int = 256) -> np.ndarray:
    """Starts of the suffixes of s in their order; characters are below k, and a shorter suffix precedes those it begins."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    # a suffix is small if it precedes the one behind it: so its first change of character decides
    change = np.flatnonzero(s[1:] != s[:-1])
    small = np.zeros(n, bool)
    if len(change):
        up = s[change + 1] > s[change]
        small[: change[-1] + 1] = np.repeat(up, np.diff(np.append(-1, change)))
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    counts = np.bincount(s, minlength=k)
    starts = np.concatenate([[0], np.cumsum(counts)])
    n_large = np.bincount(s[~small], minlength=k)
    sa = _induce(s, small, lms, starts, n_large)
    if len(lms) < 2:
        return sa
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # equal substrings, up to the next leftmost smaller position and with it, get equal names
    scale = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum((s.astype(np.uint64) + np.uint64(1)) * scale)])
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    unscale = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]))
    ends = np.minimum(np.append(lms[1:], n) + 1, n)
    lengths = np.append(lms[1:], n + 1) + 1 - lms
    number = np.zeros(n, np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    at = number[order]
    told = ((total[ends] - total[lms]) * unscale[lms])[at]
    differs = np.concatenate([[False], (told[1:] != told[:-1]) | (lengths[at][1:] != lengths[at][:-1])])
    names = np.cumsum(differs)
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[at] = names
        if names[-1] < 1 << 16:
            reduced = reduced.astype(np.uint16)
        order = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return _induce(s, small, order, starts, n_large)


def common_prefixes(s: np.ndarray, sa: np.ndarray, breaks: np.ndarray, most: int) -> np.ndarray:
    """For each position, in the order of the text, the common prefix with its predecessor in the suffix array.

    Values are exact where they, and the way to the next break, are at most `most`. A value follows from the one before
    it, less one, unless the characters before both suffixes differ; only such positions and those of breaks are compared.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.zeros(n, bool)
    own[breaks] = True
    own[0] = True
    at = np.arange(1, n)
    own[1:] |= (before[1:] <= 0) | (s[at - 1] != s[np.maximum(before[1:] - 1, 0)])
    own &= before >= 0
    words = np.concatenate([s, np.zeros(most + 16, np.uint8)]).astype(np.uint64)
    words = words[:-1] | words[1:] << np.uint64(8)
    words = words[:-2] | words[2:] << np.uint64(16)
    words = words[:-4] | words[4:] << np.uint64(32)
    value = np.zeros(n, np.int64)
    a = np.flatnonzero(own)
    b = before[a]
    for k in range(0, most, 8):
        differ = words[a + k] ^ words[b + k]
        lowest = differ & (~differ + np.uint64(1))
        value[a] = k + np.where(differ == 0, 8, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) // 8)
        go = differ == 0
        a, b = a[go], b[go]
        if not len(a):
            break
    own[before < 0] = True
    value[before < 0] = 0
    source = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return np.maximum(np.minimum(value[source] - (np.arange(n) - source), n - np.maximum(np.arange(n), before)), 0)
