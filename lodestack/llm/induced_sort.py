"""Suffix arrays by induced sorting (Nong, Zhang and Chan 2009) and permuted common prefixes (Kärkkäinen, Manzini and
Puglisi 2009), in whole-array steps.

A scan of the induced sort over bytes goes bucket by bucket; all entries of a bucket that are known at once induce their
predecessors in one step. The names of leftmost-smaller (LMS) substrings form a shorter string, which is sorted in the same
way, recursively, until all names differ. Such a string has about as many letters as places, so its scans go place by
place, in linear time."""

from __future__ import annotations

import numpy as np

#: Separates texts in the joined buffer. Each separator counts as a letter of its own, smaller than all bytes and larger
#: than the separators before it (the last one is the smallest), so that no common prefix crosses one.
SEPARATOR = 1
FIRST_BYTE = 2


def joined(texts: list[bytes]) -> np.ndarray:
    """Letters of texts (none of them empty) with a separator after each, and the final sentinel 0."""
    raw = np.frombuffer(b"\xff".join([*texts, b""]), dtype=np.uint8)
    out = np.empty(len(raw) + 1, dtype=np.uint16)
    np.add(raw, FIRST_BYTE, out=out[:-1], dtype=np.uint16)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    out[ends.astype(np.int64)] = SEPARATOR
    out[-1] = 0
    return out


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it."""
    n = len(s)
    change = np.append(s[:-1] != s[1:], True)
    at = np.where(change, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, dtype=bool)
    inner = at < n - 1
    out[inner] = s[at[inner]] < s[at[inner] + 1]
    return out


def _spread(parts: list[list[np.ndarray]], where: np.ndarray, s: np.ndarray) -> None:
    """Append positions to the lists of their letters, in order."""
    letters = s[where]
    order = np.argsort(letters, kind="stable")
    letters, where = letters[order], where[order]
    cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(where)), strict=True):
        parts[letters[a]].append(where[a:b])


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """The order of all suffixes from LMS suffixes that stand in order within each letter."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(letters)]
    larger: list[list[np.ndarray]] = [[] for _ in range(letters)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(letters)]
    _spread(seeds, lms, s)
    done: list[np.ndarray] = []
    none = np.zeros(0, dtype=np.int64)
    for c in range(letters):
        settled, taken = [], 0
        while taken < len(larger[c]):
            wave = np.concatenate(larger[c][taken:])
            taken = len(larger[c])
            settled.append(wave)
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            if len(before):
                _spread(larger, before, s)
        done.append(np.concatenate(settled) if settled else none)
        if seeds[c]:
            before = np.concatenate(seeds[c])
            before = before[before > 0] - 1
            before = before[~small[before]]
            if len(before):
                _spread(larger, before, s)
    out: list[np.ndarray] = []
    smaller[0].append(np.array([len(s) - 1]))
    for c in range(letters - 1, -1, -1):
        settled, taken = [], 0
        if c == SEPARATOR:  # separators keep the order of their places, whatever their successors induce
            smaller[c] = [x[::-1] for x in seeds[c][::-1]]
        while taken < len(smaller[c]):
            wave = np.concatenate(smaller[c][taken:])
            taken = len(smaller[c])
            settled.append(wave)
            before = wave[wave > 0] - 1
            before = before[small[before]]
            if len(before):
                _spread(smaller, before, s)
        before = done[c][::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        if len(before):
            _spread(smaller, before, s)
        if settled:
            out.append(np.concatenate(settled)[::-1])
        out.append(done[c])
    return np.concatenate(out[::-1])


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray, separator: int | None = None) -> np.ndarray:
    """Ranks of the LMS substrings in text order, equal for equal substrings; each separator has a rank of its own."""
    size = np.append(np.diff(lms) + 1, 1)
    index = np.empty(len(s), dtype=np.int64)
    index[lms] = np.arange(len(lms))
    ordered = ordered.copy()
    if separator is not None:
        apart = s[ordered] == separator
        ordered[apart] = np.sort(ordered[apart])
    length = size[index[ordered]]
    same = np.append(False, (length[1:] == length[:-1]) & (s[ordered[1:]] == s[ordered[:-1]]))
    if separator is not None:
        same[1:] &= s[ordered[1:]] != separator
    open_ = np.flatnonzero(same)
    k = 1
    while len(open_):
        open_ = open_[length[open_] > k]
        equal = s[ordered[open_] + k] == s[ordered[open_ - 1] + k]
        same[open_[~equal]] = False
        open_ = open_[equal]
        k += 1
    rank = np.empty(len(lms), dtype=np.int64)
    rank[index[ordered]] = np.cumsum(~same) - 1
    return rank


def _lms(small: np.ndarray) -> np.ndarray:
    """Places of smaller suffixes that follow a larger one."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _scanned(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """_induce() for a string over many letters, the last of them its least: two passes over the places of the order."""
    n = len(s)
    ends = np.cumsum(np.bincount(s))
    # Letter before each place, if the suffix there is larger (smaller) than its successor; place n stands for "none yet".
    before = np.append(-1, s[:-1])
    larger = [*np.where(np.append(True, small[:-1]), -1, before).tolist(), -1]
    smaller = [*np.where(np.append(False, small[:-1]), before, -1).tolist(), -1]
    order = np.full(n, n, dtype=np.int64)
    letters = s[lms]
    turn = np.argsort(letters, kind="stable")
    count = np.bincount(letters, minlength=len(ends))
    order[np.repeat(ends - np.cumsum(count), count) + np.arange(len(lms))] = lms[turn]
    order = order.tolist()
    free = [0, *ends[:-1].tolist()]
    for i in order:  # grows ahead of the pass
        c = larger[i]
        if c >= 0:
            order[free[c]] = i - 1
            free[c] += 1
    free = ends.tolist()
    for i in reversed(order):
        c = smaller[i]
        if c >= 0:
            free[c] = at = free[c] - 1
            order[at] = i - 1
    return np.array(order, dtype=np.int64)


def _order(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names 0, 1, ...; the last of them is 0 and stands nowhere else.

    A suffix that begins with a name of its own is placed by it. The others are sorted recursively, in the string that is left
    of them and of the first such name after each: there every comparison ends."""
    shared = np.bincount(names)[names] > 1
    if not shared.any():
        return np.argsort(names)
    kept = shared.copy()
    kept[1:] |= shared[:-1]
    kept[-1] = True
    at = np.flatnonzero(kept)
    letters = np.unique(names[at], return_inverse=True)[1]
    small = _types(letters)
    lms = _lms(small)
    first = _scanned(letters, small, lms)
    mark = np.zeros(len(letters), dtype=bool)
    mark[lms] = True
    shorter = _names(letters, lms, first[mark[first]])
    turn = np.zeros(len(names), dtype=np.int64)
    turn[at[_scanned(letters, small, lms[_order(shorter)])]] = np.arange(len(at))
    return np.lexsort((turn, names))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of s (see joined()) in order."""
    letters = int(s.max()) + 1
    small = _types(s)
    lms = _lms(small)
    first = _induce(s, small, lms, letters)
    mark = np.zeros(len(s), dtype=bool)
    mark[lms] = True
    names = _names(s, lms, first[mark[first]], SEPARATOR)
    return _induce(s, small, lms[_order(names)], letters)


def permuted_lcp(s: np.ndarray, order: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, by text position.

    until: letters up to the next separator. Only irreducible entries are compared; where the letters before both suffixes
    are equal, the entry is one less than the entry before it."""
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    left, other = s[np.maximum(at - 1, 0)], s[np.maximum(before - 1, 0)]
    reducible = (before > 0) & (at > 0) & (left == other) & (left != SEPARATOR)
    start = np.flatnonzero(~reducible)
    length = np.zeros(n, dtype=np.int64)
    open_ = start[before[start] >= 0]
    most = np.minimum(until[open_], until[before[open_]])
    k = 0
    while len(open_):
        equal = most > k
        equal[equal] = s[open_[equal] + k] == s[before[open_[equal]] + k]
        length[open_[~equal]] = k
        open_, most = open_[equal], most[equal]
        k += 1
    last = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.maximum(length[last] - (at - last), 0)
