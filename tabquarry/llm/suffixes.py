"""Suffix arrays by induced sorting, and permuted common prefixes, over the bytes of one shard in numpy.

The induction goes bucket by bucket: all suffixes of a bucket induce their predecessors at once, stably by first byte,
so the work is linear and only runs of one byte take a step for each of their letters. Leftmost-smaller (LMS) substrings
are sorted by a first induction and named; the reduced string of names, if some are equal, is sorted in the same way, level
by level. Names have an alphabet as large as their string, so below the first level the induction goes suffix by suffix.
A name that occurs once settles every comparison that reaches it, so of a run of such names only the first is kept.
"""

from __future__ import annotations

import numpy as np


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S-type). The last is larger than the empty suffix."""
    n = len(s)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differs = np.nonzero(s[1:] != s[:-1])[0]
    rising = s[differs + 1] > s[differs]
    nearest = np.searchsorted(differs, np.arange(n))
    inside = nearest < len(differs)
    out[inside] = rising[nearest[inside]]
    return out


def _spread(lists: list[list[np.ndarray]], found: np.ndarray, chars: np.ndarray) -> None:
    """Append ``found`` to the lists of their first bytes, in order."""
    order = np.argsort(chars, kind="stable")
    found, chars = found[order], chars[order]
    ends = np.nonzero(np.diff(chars))[0] + 1
    for part, c in zip(np.split(found, ends), chars[np.concatenate([[0], ends])], strict=True):
        lists[c].append(part)


def _closure(start: list[np.ndarray], s: np.ndarray, kind: np.ndarray, want: bool, c: int) -> np.ndarray:
    """The bucket's suffixes with those that they induce into their own bucket, in order of induction."""
    if not start:
        return np.zeros(0, np.int32)
    all_parts = [np.concatenate(start)]
    while len(all_parts[-1]):
        p = all_parts[-1] - 1
        p = p[p >= 0]
        all_parts.append(p[(s[p] == c) & (kind[p] == want)])
    return np.concatenate(all_parts)


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array from LMS positions in their order (or in any order of equal first bytes, to sort substrings)."""
    n = len(s)
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    if len(lms):
        _spread(seeds, lms, s[lms])
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[s[n - 1]].append(np.array([n - 1], np.int32))
    done: list[np.ndarray] = []
    for c in range(256):
        own = _closure(large[c], s, smaller, False, c)
        done.append(own)
        p = np.concatenate([own, *seeds[c]]) - 1
        p = p[p >= 0]
        p = p[~smaller[p]]
        chars = s[p]
        p, chars = p[chars != c], chars[chars != c]
        if len(p):
            _spread(large, p, chars)
    small: list[list[np.ndarray]] = [[] for _ in range(256)]
    ends: list[np.ndarray] = [np.zeros(0, np.int32)] * 256
    for c in range(255, -1, -1):
        own = _closure(small[c], s, smaller, True, c)
        ends[c] = own[::-1]
        p = np.concatenate([own, done[c][::-1]]) - 1
        p = p[p >= 0]
        p = p[smaller[p]]
        chars = s[p]
        p, chars = p[chars != c], chars[chars != c]
        if len(p):
            _spread(small, p, chars)
    return np.concatenate([x for c in range(256) for x in (done[c], ends[c])])


def _named(s: np.ndarray, ordered: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each LMS substring, from ``ordered`` to its end (exclusive), differs from the one before it, by its letters."""
    new = np.ones(len(ordered), bool)
    length = ends - ordered
    alike = np.nonzero(length[1:] == length[:-1])[0] + 1
    for part in np.array_split(alike, max(1, int(length[alike].sum()) >> 20)):
        n = length[part]
        if not len(n):
            continue
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        step = np.arange(int(n.sum())) - np.repeat(starts, n)
        same = s[np.repeat(ordered[part], n) + step] == s[np.repeat(ordered[part - 1], n) + step]
        new[part] = ~np.logical_and.reduceat(same, starts)
    return new


def _sorted_lms(s: np.ndarray, lms: np.ndarray, by_substring: np.ndarray) -> np.ndarray:
    """The LMS suffixes in order, from any suffix order in which their substrings are sorted."""
    n = len(s)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = by_substring[is_lms[by_substring]].astype(np.int64)
    # an LMS substring reaches to the next LMS position, inclusive; the last one to the end
    ends = np.full(n + 1, n, np.int64)
    ends[lms[:-1]] = lms[1:] + 1
    new = _named(s, ordered, ends[ordered])
    if new.all():
        return ordered
    names = np.empty(n, np.int64)
    names[ordered] = np.cumsum(new) - 1
    reduced = names[lms]
    once = (np.bincount(reduced) == 1)[reduced]
    kept = np.ones(len(lms), bool)
    kept[1:] = ~(once[1:] & once[:-1])
    rank = np.empty(len(lms), np.int64)
    # names that occur once are in order by name; between equal names the order of the kept suffixes decides
    shorter = np.unique(reduced[kept], return_inverse=True)[1]
    within = np.empty(int(kept.sum()), np.int64)
    within[_suffixes_of_names(shorter)] = np.arange(len(shorter))
    rank[kept], rank[~kept] = within, 0
    return lms[np.lexsort((rank, reduced))]


def _suffixes_of_names(s: np.ndarray) -> np.ndarray:
    """The suffix array of a string of names 0, 1, ..., by induced sorting, suffix by suffix."""
    n = len(s)
    if len(set(s.tolist())) == n:
        return np.argsort(s, kind="stable")
    smaller = smaller_types(s)
    lms = np.nonzero(smaller[1:] & ~smaller[:-1])[0] + 1
    if len(lms) > 1:
        lms = _sorted_lms(s, lms, _induced_names(s, smaller, lms))
    return _induced_names(s, smaller, lms)


def _induced_names(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As ``induce``, one suffix after the other: the loops read the places that they fill."""
    n = len(s)
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    order = [-1] * n
    tail = ends.tolist()
    for i, c in zip(reversed(lms.tolist()), s[lms[::-1]].tolist(), strict=True):
        tail[c] -= 1
        order[tail[c]] = i
    head = (ends - counts).tolist()
    last = int(s[n - 1])  # its suffix is the least of its bucket's larger ones
    order[head[last]] = n - 1
    head[last] += 1
    # the letter before each suffix if it is of the wanted type; -1 also stands for the empty places, as index -1
    before = np.concatenate([[-1], np.where(smaller[:-1], -1, s[:-1]), [-1]]).tolist()
    for j in order:
        if (c := before[j]) >= 0:
            order[head[c]] = j - 1
            head[c] += 1
    tail = ends.tolist()
    before = np.concatenate([[-1], np.where(smaller[:-1], s[:-1], -1), [-1]]).tolist()
    for j in reversed(order):
        if (c := before[j]) >= 0:
            tail[c] = h = tail[c] - 1
            order[h] = j - 1
    return np.array(order, np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of the bytes ``s`` in order, as 32-bit numbers."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int32)
    smaller = smaller_types(s)
    lms = (np.nonzero(smaller[1:] & ~smaller[:-1])[0] + 1).astype(np.int32)
    if len(lms) > 1:
        lms = _sorted_lms(s, lms, induce(s, smaller, lms))
    return induce(s, smaller, lms.astype(np.int32))


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): the suffix before each position's in the order (-1: none) and the length they share, by position.

    Only irreducible values, where the bytes before the two suffixes differ, are found by comparing; the others follow,
    as a value and its position add up to the same along a stretch of reducible ones.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    before = np.where((at > 0) & (phi > 0), s[at - 1].astype(np.int16) - s[np.maximum(phi - 1, 0)], 1)
    single = np.nonzero((before != 0) | (phi < 0))[0]
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(n + 1,), strides=(1,))
    length = np.zeros(len(single), np.int64)
    active = np.nonzero(phi[single] >= 0)[0]
    while len(active):
        i, j = single[active] + length[active], phi[single[active]] + length[active]
        inside = (i < n) & (j < n)
        x = np.ones(len(active), np.uint64)
        x[inside] = words[i[inside]] ^ words[j[inside]]
        same = np.where(x == 0, 8, 0)
        part = x != 0
        if part.any():
            low = x[part] & (~x[part] + np.uint64(1))
            same[part] = (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        same[~inside] = 0
        length[active] += np.minimum(same, n - np.maximum(i, j).clip(max=n))
        active = active[(x == 0) & inside]
    value = np.zeros(n, np.int64)
    value[single] = length + single
    last = np.zeros(n, np.int64)
    last[single] = single
    last = np.maximum.accumulate(last)
    return phi, np.maximum(value[last] - at, 0)


def repeated_windows(s: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` bytes from each position also start elsewhere in ``s``."""
    out = np.zeros(len(s), bool)
    if len(s) >= width:
        phi, plcp = common_prefixes(s, suffix_array(s))
        twice = plcp >= width
        out[twice] = True
        out[phi[twice]] = True
    return out
