"""Suffix order and common-prefix lengths of one shard by external induced sorting.

The text of a shard is a sequence of pieces, each closed by an end mark that
sorts first and equals nothing. The suffixes that start a rising stretch after
a falling one are ordered by reduction: the stretches between them are named in
order, and the string of names is sorted in turn (the recursion ends in memory,
by doubling). From them two sweeps induce all other suffixes: a priority queue
keyed by first symbol hands out (position, common prefix) tuples in order, and
each suffix handed out puts the one before it back into the queue. Tuples of
one symbol enter in the order in which they leave, so the queue is one run per
symbol; runs beyond a memory limit go to disk. The common prefix of two
neighbours is one more than the least one between those that induced them.
"""

from __future__ import annotations

import tempfile

import numpy as np

END = 0
MEMORY_TUPLES = 1 << 20
_FAR = np.int32(1 << 30)
_TUPLE = np.dtype([("pos", "<i4"), ("lcp", "<i4")])


class TupleQueue:
    """Tuples by first symbol, first in first out within a symbol; held in memory up to a limit, the rest on the task's own disk.

    The file has no name and goes with the task; a task that is lost begins anew.
    """

    def __init__(self, limit: int = MEMORY_TUPLES):
        self.limit, self.held, self.file = limit, 0, None
        self.runs: dict[int, list] = {}

    def put(self, symbol: int, tuples: np.ndarray) -> None:
        self.runs.setdefault(symbol, []).append(tuples)
        self.held += len(tuples)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.runs.values():
            in_memory = [k for k, p in enumerate(parts) if isinstance(p, np.ndarray)]
            if in_memory:
                run = np.concatenate([parts[k] for k in in_memory])
                parts[in_memory[0] :] = [(self.file.seek(0, 2), len(run))]
                self.file.write(run.tobytes())
        self.held = 0

    def take(self, symbol: int):
        """The tuples waiting for a symbol, part by part; what is put meanwhile waits for the next call."""
        parts = self.runs.pop(symbol, [])
        fresh = [p for p in parts if isinstance(p, np.ndarray)]
        self.held -= sum(map(len, fresh))
        for part in [p for p in parts if not isinstance(p, np.ndarray)] + ([np.concatenate(fresh)] if fresh else []):
            if isinstance(part, np.ndarray):
                yield part
            else:
                at, n = part
                for lo in range(0, n, self.limit):
                    self.file.seek(at + lo * _TUPLE.itemsize)
                    yield np.frombuffer(self.file.read(min(self.limit, n - lo) * _TUPLE.itemsize), _TUPLE)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _tuples(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(pos), _TUPLE)
    out["pos"], out["lcp"] = pos, lcp
    return out


def _runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position, the length of the run of its symbol from here on, and whether the suffix is of the rising kind."""
    n = len(text)
    breaks = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    last = breaks[np.searchsorted(breaks, np.arange(n))] if n else breaks
    follows = np.append(text, END)[last + 1]
    rising = follows > text
    rising[text == END] = True
    return (last - np.arange(n) + 1).astype(np.int32), rising


def _ordered_names(text: np.ndarray, rising: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Names, in order, of the stretches from each start to the next one, both ends included."""
    symbol = text.astype(np.uint64) * np.uint64(2) + rising
    padded = np.concatenate([symbol, np.zeros(8, np.uint64)])
    stop = np.append(start[1:], len(text) - 1)
    size = np.where(text[start] == END, 1, stop - start + 1)
    name = np.zeros(len(start), np.int64)
    active = np.arange(len(start))
    done = 0
    while len(active):
        word = np.zeros(len(active), np.uint64)
        for k in range(6):
            inside = done + k < size[active]
            spot = np.minimum(start[active] + done + k, len(padded) - 1)
            word = word << np.uint64(10) | np.where(inside, padded[spot] + np.uint64(1), np.uint64(0))
        # Refine the names of the longer ones: all members of a name take part, the ended ones as the least.
        key = np.zeros(len(start), np.uint64)
        key[active] = word
        order = np.lexsort((key, name))
        step = np.ones(len(order), bool)
        step[1:] = (name[order][1:] != name[order][:-1]) | (key[order][1:] != key[order][:-1])
        fresh = np.empty(len(order), np.int64)
        fresh[order] = np.cumsum(step) - 1
        name = fresh
        done += 6
        active = np.flatnonzero(size > done)
    return name


def _order_of(names: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of names by doubling; a stretch that is an end mark closes its piece."""
    m = len(names)
    # End marks differ from each other: they rank by place, before everything else.
    rank = np.where(ends, np.cumsum(ends) - 1, names + int(ends.sum()))
    step = 1
    while True:
        unique, rank = np.unique(rank, return_inverse=True)
        if len(unique) == m:
            return np.argsort(rank, kind="stable")
        ahead = np.zeros(m, np.int64)
        ahead[: m - step] = rank[step:] + 1
        rank = rank * np.int64(m + 1) + ahead
        step *= 2


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to ``most``; an end mark equals nothing."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(most + 8, text.dtype)]), 4)
    packed = np.ascontiguousarray(words).view(np.uint64).ravel() if text.dtype == np.uint16 else None
    out = np.zeros(len(a), np.int32)
    active = np.arange(len(a))
    done = 0
    while len(active) and done < most:
        x, y = packed[a[active] + done], packed[b[active] + done]
        same = (x == y) & _no_end(x)
        out[active[same]] += 4
        rest = active[~same]
        if len(rest):
            alive = np.ones(len(rest), bool)
            for k in range(4):
                p, q = text_at(text, a[rest] + done + k), text_at(text, b[rest] + done + k)
                alive &= (p == q) & (p != END)
                out[rest] += alive
        active = active[same]
        done += 4
    return np.minimum(out, most)


def text_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at < len(text), text[np.minimum(at, len(text) - 1)], END)


def _no_end(packed: np.ndarray) -> np.ndarray:
    """Whether none of the four 16-bit symbols of a word is the end mark."""
    ones, high = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)
    return ((packed - ones) & ~packed & high) == 0


class _Sweep:
    """One direction of the induction: tuples handed out in order put their predecessors back."""

    def __init__(self, text: np.ndarray, eligible: np.ndarray, most: int, limit: int):
        self.text, self.eligible, self.most = text, eligible, most
        self.queue = TupleQueue(limit)
        self.least = np.full(258, _FAR, np.int32)  # by symbol, the least common prefix since its last tuple
        self.begun = np.zeros(258, bool)

    def scan(self, tuples: np.ndarray) -> None:
        pos, lcp = tuples["pos"], tuples["lcp"]
        if not len(pos):
            return
        before = pos - 1
        fits = (before >= 0) & self.eligible[np.maximum(before, 0)]
        symbol = np.where(fits, self.text[np.maximum(before, 0)], 0)
        symbol = np.where(fits, symbol, END)
        order = np.argsort(symbol, kind="stable")
        found, first = np.unique(symbol[order], return_index=True)
        ends = np.append(first[1:], len(order))
        overall = lcp.min()
        least = np.minimum(self.least, overall)
        for c, lo, hi in zip(found, first, ends):
            if c == END:
                continue
            at = order[lo:hi]
            starts = np.append(0, at[:-1] + 1)
            between = np.minimum.reduceat(lcp[: at[-1] + 1], starts)
            between[0] = min(between[0], self.least[c])
            value = np.minimum(between + 1, self.most).astype(np.int32)
            if not self.begun[c]:
                value[0] = 0
                self.begun[c] = True
            self.queue.put(int(c), _tuples(before[at], value))
            least[c] = lcp[at[-1] + 1 :].min() if at[-1] + 1 < len(lcp) else _FAR
        self.least = least


def suffix_order(text: np.ndarray, most: int, limit: int = MEMORY_TUPLES):
    """(positions, common prefix with the one before, up to ``most``) of all suffixes that begin with a symbol, in order, as a list of parts.

    ``text`` is a uint16 array of symbols 1..256 with the mark 0 after each piece.
    """
    n = len(text)
    if not n:
        return []
    run, rising = _runs(text)
    falling = ~rising
    turn = np.flatnonzero(rising & np.append(False, falling[:-1]) | (text == END))
    order = turn[_order_of(_ordered_names(text, rising, turn), text[turn] == END)]
    lcp = np.zeros(len(order), np.int32)
    lcp[1:] = _common(text, order[:-1], order[1:], most)
    symbols = text[order]
    at = np.searchsorted(symbols, np.arange(258))

    # Sweep up: the falling suffixes.
    up = _Sweep(text, falling, most, limit)
    down_parts: dict[int, list[np.ndarray]] = {}
    for c in range(257):
        tail = None
        while c in up.queue.runs:
            for part in up.queue.take(c):
                down_parts.setdefault(c, []).append(part)
                up.scan(part)
                tail = part["pos"][-1]
        mine = slice(at[c], at[c + 1])
        if at[c + 1] > at[c]:
            own = _tuples(order[mine], lcp[mine])
            own["lcp"][0] = 0 if tail is None or c == END else min(run[tail], run[own["pos"][0]], most)
            up.scan(own)
    up.queue.close()

    # Sweep down: the rising suffixes, largest first; each common prefix is the one with the larger neighbour.
    down = _Sweep(text, rising & (text != END), most, limit)
    rises: dict[int, list[np.ndarray]] = {}
    for c in range(256, 0, -1):
        tail = None
        while c in down.queue.runs:
            for part in down.queue.take(c):
                rises.setdefault(c, []).append(part)
                down.scan(part)
                tail = part["pos"][-1]
        falls = down_parts.get(c, [])
        ahead = None  # common prefix of the tuple just scanned with the one below it
        for part in reversed(falls):
            back = part[::-1]
            value = np.empty(len(back), np.int32)
            value[0] = (0 if tail is None else min(run[tail], run[back["pos"][0]], most)) if ahead is None else ahead
            value[1:] = back["lcp"][:-1]
            ahead = back["lcp"][-1]
            down.scan(_tuples(back["pos"], value))
    down.queue.close()

    out = []
    for c in range(1, 257):
        for part in down_parts.get(c, []):
            out.append((part["pos"], part["lcp"]))
        climb = rises.get(c, [])
        if climb:
            whole = np.concatenate(climb)[::-1]
            value = np.empty(len(whole), np.int32)
            # From "with the larger neighbour" to "with the smaller neighbour".
            value[1:] = whole["lcp"][:-1]
            falls = down_parts.get(c, [])
            value[0] = min(run[falls[-1]["pos"][-1]], run[whole["pos"][0]], most) if falls else 0
            out.append((whole["pos"], value))
    return out
