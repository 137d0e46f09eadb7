"""Lyndon arrays by grouping suffixes, and the runs that follow from them.

The grouping is the first phase of a suffix sorter that works on groups. At
first a group holds the suffixes with the same first symbol. Groups are taken
from the greatest to the least; each member points at the nearest suffix before
it that lies in a lower group, and suffixes that are pointed at rise into a new
group directly above their old one, those with more pointers above those with
fewer. A suffix then carries a longer prefix: its own and one prefix of the
group just taken for each pointer. In the end this prefix is the longest Lyndon
word that starts there, so the phase gives the Lyndon array without a suffix array.

Every run has a Lyndon root, under the order of symbols or under its reverse,
that starts inside its first period and is the longest Lyndon word there.
Stretching each root by the longest common extensions of its two ends, and
keeping what is long enough, therefore gives every run.
"""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; a proper prefix is smaller than the word."""
    n = len(ranks)
    symbols = sorted(set(ranks))
    number = {s: g for g, s in enumerate(symbols)}
    group = [number[r] for r in ranks]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(symbols)
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    # nearest[i + 1] - 1 is the nearest place up to i that is not taken yet; place -1 never is.
    nearest = list(range(n + 1))
    out = [0] * n

    def not_taken(at: int) -> int:
        root = at
        while nearest[root] != root:
            root = nearest[root]
        while nearest[at] != root:
            nearest[at], at = root, nearest[at]
        return root

    def rise(old: int, rising: list[int], longer: int) -> None:
        """A new group directly above ``old``."""
        new, up = len(members), above[old]
        members.append(rising)
        length.append(length[old] + longer)
        below.append(old)
        above.append(up)
        above[old] = new
        if up >= 0:
            below[up] = new
        for i in rising:
            group[i] = new

    g = len(symbols) - 1
    while g >= 0:
        taken = [i for i in members[g] if group[i] == g]  # those that rose since are left out
        size = length[g]
        for i in taken:
            nearest[i + 1] = i
            out[i] = size
        pointers: dict[int, int] = {}
        for i in taken:
            j = not_taken(i) - 1
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        if len(pointers) == 1:
            ((j, count),) = pointers.items()
            rise(group[j], [j], count * size)
        elif pointers:
            risers: dict[tuple[int, int], list[int]] = {}
            for j, count in pointers.items():
                risers.setdefault((-count, group[j]), []).append(j)
            for count, old in sorted(risers):
                rise(old, risers[count, old], -count * size)
        members[g] = []
        g = below[g]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEP
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    up = np.full(n, _STEP)
    up[:1] = 1
    return np.cumprod(up, dtype=np.uint64)


def common_extensions(symbols: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far the places from i and from j on agree (i < j): bisection on hashes of prefixes, so never too short."""
    n = len(symbols)
    up = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(symbols.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    shift = up[j - i]
    low, high = np.zeros(len(i), np.int64), n - j
    while (low < high).any():
        half = (low + high + 1) >> 1
        same = (sums[i + half] - sums[i]) * shift == sums[j + half] - sums[j]
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    return low


def _exact(symbols: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether the stretch has the period and neither neighbour extends it."""
    n = len(symbols)
    return (
        bool((symbols[start : end - period] == symbols[start + period : end]).all())
        and (start == 0 or symbols[start - 1] != symbols[start - 1 + period])
        and (end == n or symbols[end] != symbols[end - period])
    )


def _stretched(symbols: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """The widest stretch around [place, place + period) with that period, by comparing symbols."""
    differ = np.flatnonzero(symbols[:-period] != symbols[period:])
    at = np.searchsorted(differ, place)
    before = differ[at - 1] + 1 if at else 0
    after = differ[at] if at < len(differ) else len(symbols) - period
    return int(before), int(after) + period


def runs(symbols: np.ndarray, least: int = 2, exponent: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run with length >= max(least, exponent * period), in order; ``exponent`` is 2 or more.

    ``symbols`` are whole numbers that are equal where the words are. Hashes
    only propose; every run that is returned was compared symbol by symbol.
    """
    n = len(symbols)
    if n < max(least, 2):
        return []
    out = set()
    for ranks in (symbols, -symbols):
        i = np.arange(n)
        period = np.asarray(lyndon_array(ranks.tolist()))
        i, period = i[i + period < n], period[i + period < n]
        j = i + period
        forth = common_extensions(symbols, i, j)
        # Backwards from the places before: the same on the reversed symbols.
        back = np.zeros(len(i), np.int64)
        inner = i > 0
        back[inner] = common_extensions(symbols[::-1], n - j[inner], n - i[inner])
        start, end = i - back, j + forth
        long = np.flatnonzero(end - start >= np.maximum(least, exponent * period))
        proposed, which = np.unique(np.stack([start[long], end[long], period[long]], axis=1), axis=0, return_inverse=True)
        for k, (s, e, p) in enumerate(proposed.tolist()):
            if _exact(symbols, s, e, p):
                out.add((s, e - s, p))
                continue
            for place in i[long][which.ravel() == k].tolist():  # equal hashes of unequal stretches
                s, e = _stretched(symbols, place, p)
                if e - s >= max(least, exponent * p):
                    out.add((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))
