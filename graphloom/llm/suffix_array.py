"""Suffix arrays by induced sorting, vectorised for texts made of many short segments.

Suffixes are classed as smaller or larger than their right neighbour; the leftmost smaller ones of each run are sorted
by inducing from their first characters, named, and, where names repeat, sorted by the names that follow (recursively,
by doubling: names are no longer bytes there, and a segment holds few of them). From their order one pass to the right
places the larger suffixes, one to the left the smaller ones. A bucket's suffixes are moved in whole rounds, so the
number of numpy calls depends on the alphabet and the longest run of one character, not on the length of the text.
"""

from __future__ import annotations

import numpy as np

class Queues:
    """Per bucket, the suffixes pushed so far, in order."""

    def __init__(self, sigma: int):
        self.q: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def push(self, at: np.ndarray, char: np.ndarray) -> None:
        if not len(at):
            return
        if char[0] == char[-1] and (char == char[0]).all():
            self.q[int(char[0])].append(at)
            return
        order = np.argsort(char, kind="stable")
        by = char[order]
        cut = np.flatnonzero(np.diff(by)) + 1
        for piece, c in zip(np.split(at[order], cut), by[np.concatenate([[0], cut])].tolist(), strict=True):
            self.q[c].append(piece)

    def take(self, c: int) -> np.ndarray:
        got, self.q[c] = self.q[c], []
        return got[0] if len(got) == 1 else np.concatenate(got) if got else np.zeros(0, np.int64)


def induce(t: np.ndarray, larger: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes, induced from an order of the leftmost-smaller ones. t[-1] is 0 and nothing else is."""
    char = t[lms]
    order = np.argsort(char, kind="stable")
    grouped, where = lms[order], np.searchsorted(char[order], np.arange(sigma + 1))
    q, placed = Queues(sigma), [[] for _ in range(sigma)]

    def left_of(x: np.ndarray, kind: bool) -> np.ndarray:
        x = x[x > 0] - 1
        return x[larger[x] == kind]

    for c in range(sigma):
        while len(x := q.take(c)):
            placed[c].append(x)
            p = left_of(x, True)
            q.push(p, t[p])
        p = left_of(grouped[where[c] : where[c + 1]], True)
        q.push(p, t[p])
    q, small = Queues(sigma), [[] for _ in range(sigma)]
    for c in range(sigma - 1, -1, -1):
        while len(x := q.take(c)):
            small[c].append(x)
            p = left_of(x, False)
            q.push(p, t[p])
        for x in reversed(placed[c]):
            p = left_of(x[::-1], False)
            q.push(p, t[p])
    out = [np.array([len(t) - 1])]  # the end of the text has no right neighbour to be induced from
    for c in range(sigma):
        out += placed[c]
        out += [x[::-1] for x in reversed(small[c])]
    return np.concatenate(out)


def doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, by doubling. Only suffixes whose place is open are sorted again; a
    rank is the place of the first suffix that may still be equal."""
    n, k = len(names), 1
    order, live, rank = np.arange(n), np.arange(n), np.empty(n, np.int64)
    key = names.astype(np.int64)
    while True:
        by = np.argsort(key, kind="stable")
        order[live], key = order[live][by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[live]] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        live = live[~(new & np.append(new[1:], True))]
        if not len(live) or k >= n:
            return order
        at = order[live]
        key = rank[at] * (n + 1) + np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        k *= 2


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of t (values from 0 to sigma - 1)."""
    # Small values are kept in 16 bits, which numpy sorts by digits.
    small = np.int16 if sigma < 1 << 14 else np.int32
    t, sigma = np.append(t.astype(small) + small(1), small(0)), sigma + 1
    n = len(t)
    if n == 1:
        return np.zeros(0, np.int64)
    # larger[i]: suffix i > suffix i + 1. Runs of one character have the class of what follows them.
    step = np.sign(np.diff(t))
    change = np.flatnonzero(step)
    nxt = np.cumsum(step != 0) - (step != 0)
    larger = np.ones(n, bool)
    has = nxt < len(change)
    larger[:-1][has] = step[change[nxt[has]]] < 0
    larger[-1] = False
    lms = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    if len(lms) > 1:
        sa = induce(t, larger, lms, sigma)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        end = np.append(lms[1:], n - 1) + 1
        index = np.full(n, -1, np.int64)
        index[lms] = np.arange(len(lms))
        a, b = ordered[:-1], ordered[1:]
        la, lb = end[index[a]] - a, end[index[b]] - b
        same = la == lb
        k, live = 0, np.flatnonzero(same)
        while len(live):
            live = live[la[live] > k]
            differs = (t[a[live] + k] != t[b[live] + k]) | (larger[a[live] + k] != larger[b[live] + k])
            same[live[differs]] = False
            live, k = live[~differs], k + 1
        names = np.empty(len(lms), np.int64)
        names[index[ordered]] = np.cumsum(np.concatenate([[0], ~same]))
        lms = ordered if names.max() == len(lms) - 1 else lms[doubled(names)]
    return induce(t, larger, lms, sigma)[1:]


def common_prefixes(t: np.ndarray, sa: np.ndarray, segment: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each position, how far its suffix agrees with the one before it in the suffix
    array, up to ``most`` and never past the end of its segment. All segments advance together; from one position to
    the next the value falls by one at most."""
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    out = np.zeros(n, np.int64)
    padded = np.concatenate([t, np.full(most + 1, -1, t.dtype)])
    have = np.zeros(len(segment), np.int64)
    for j in range(int(length.max()) if len(length) else 0):
        live = np.flatnonzero(length > j)
        at = segment[live] + j
        phi, h = before[at], np.maximum(have[live] - 1, 0)
        go = np.flatnonzero((phi >= 0) & (h < np.minimum(most, length[live] - j)))
        limit = np.minimum(most, length[live] - j)
        h[phi < 0] = 0
        while len(go):
            equal = padded[at[go] + h[go]] == padded[np.maximum(phi[go], 0) + h[go]]
            go = go[equal]
            h[go] += 1
            go = go[h[go] < limit[go]]
        have[live] = h
        out[at] = h
    return out
