"""Suffix arrays by induced sorting.

Suffixes are classed as smaller (S) or larger (L) than the next; leftmost-S substrings are sorted by one
induction, named, and sorted as a string of names by the same routine, whatever the number of names; a second
induction gives the array. Within one bucket an induction scan only meets suffixes that earlier buckets, or
earlier rounds of the same letter, have placed: so where buckets are few and large, numpy takes a bucket in a
few array operations. A string of names has many small buckets, and there the scan goes suffix by suffix over
one array with a head and a tail for each bucket. Either way it is linear.
"""

from __future__ import annotations

import numpy as np

#: Letters up to which an induction goes bucket by bucket.
BUCKETS = 1024


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of an array of whole numbers from 0, in order."""
    if len(text) < 2:
        return np.arange(len(text))
    letters = np.append(text.astype(np.int64) + 1, 0)
    return _sorted(letters, int(letters.max()) + 1)[1:]


def _sorted(t: np.ndarray, size: int) -> np.ndarray:
    """t ends in its only 0."""
    t = t.astype(np.uint16 if size <= 1 << 16 else np.int64)
    n = len(t)
    same = np.append(t[1:] == t[:-1], False)
    change = np.minimum.accumulate(np.where(same, n, np.arange(n))[::-1])[::-1]
    smaller = np.append(t[:-1] < t[1:], True)[change]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = _induce(t, size, smaller, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    ends = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = ends - lms + 1
    a, b = order[:-1], order[1:]
    differ = length[a] != length[b]
    live = np.flatnonzero(~differ)
    for k in range(int(length.max(initial=0))):
        live = live[length[a[live]] > k]
        if not len(live):
            break
        odd = t[a[live] + k] != t[b[live] + k]
        differ[live[odd]] = True
        live = live[~odd]
    names = np.concatenate([[0], np.cumsum(differ)])
    if names[-1] + 1 < len(order):
        at = np.zeros(n, np.int64)
        at[order] = names
        word = at[lms]
        order = lms[_sorted(word, int(names[-1]) + 1)]
    return _induce(t, size, smaller, order)


def _deal(p: np.ndarray, t: np.ndarray, parts: list[list[np.ndarray]]) -> None:
    """Append the positions p, in order, to the lists of their letters."""
    if not len(p):
        return
    letters = t[p]
    order = np.argsort(letters, kind="stable")
    p, letters = p[order], letters[order]
    cuts = [0, *(np.flatnonzero(letters[1:] != letters[:-1]) + 1).tolist(), len(p)]
    for a, b in zip(cuts, cuts[1:]):
        parts[int(letters[a])].append(p[a:b])


def _induce(t: np.ndarray, size: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-S ones in order."""
    return _induce_buckets(t, size, smaller, lms) if size <= BUCKETS else _induce_each(t, size, smaller, lms)


def _induce_each(t: np.ndarray, size: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    count = np.bincount(t, minlength=size)
    stops = np.cumsum(count)
    sa, letter = [0] * len(t), t.tolist()
    tails = stops.tolist()
    for p in lms[::-1].tolist():
        c = letter[p]
        tails[c] -= 1
        sa[tails[c]] = p
    before = np.append(-1, t[:-1].astype(np.int64))  # the letter that a scan puts before a suffix, or -1
    heads, into = (stops - count).tolist(), np.where(np.append(True, smaller[:-1]), -1, before).tolist()
    for p in sa:  # the scan meets what it has placed further on
        c = into[p]
        if c >= 0:
            sa[heads[c]] = p - 1
            heads[c] += 1
    tails, into = stops.tolist(), np.where(np.append(False, smaller[:-1]), before, -1).tolist()
    for p in reversed(sa):
        c = into[p]
        if c >= 0:
            tails[c] -= 1
            sa[tails[c]] = p - 1
    return np.array(sa, np.int64)


def _induce_buckets(t: np.ndarray, size: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    none = np.zeros(0, np.int64)
    join = lambda parts: np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else none
    given: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(lms, t, given)
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size):
        cur = join(large[c])
        found = [cur]
        while len(cur):
            p = cur[cur > 0] - 1
            p = p[~smaller[p]]
            again = t[p] == c
            _deal(p[~again], t, large)
            cur = p[again]
            found.append(cur)
        large[c] = [join(found)]
        cur = join(given[c])
        _deal(cur[cur > 0] - 1, t, large)
    small: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size - 1, 0, -1):
        cur = join(small[c])
        found = [cur]
        while len(cur):
            p = cur[cur > 0] - 1
            p = p[smaller[p]]
            again = t[p] == c
            _deal(p[~again], t, small)
            cur = p[again]
            found.append(cur)
        small[c] = [join(found)[::-1]]
        cur = large[c][0][::-1]
        p = cur[cur > 0] - 1
        _deal(p[smaller[p]], t, small)
    small[0] = [np.array([len(t) - 1])]
    return np.concatenate([x for c in range(size) for x in (large[c][0], small[c][0])])


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each start, in text order, the letters it shares with the suffix before it in sa, at most `most`."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    raw = text.astype(np.uint8).tobytes() + bytes(8)
    words = np.ndarray((n + 1,), "<u8", raw, strides=(1,))
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for at in range(0, most, 8):
        a, b = live + at, before[live] + at
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        odd = words[a] ^ words[b]
        low = odd & (~odd + np.uint64(1))
        same = np.where(odd == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
        out[live] = np.minimum(at + same, np.minimum(most, n - np.maximum(live, before[live])))
        live = live[odd == 0]
    return out
