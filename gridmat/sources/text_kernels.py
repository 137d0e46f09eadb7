"""Finding the few tokens of long lines that are not a plain ``0``, in numpy on the bytes of whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE, _ZERO = 32, 48


class _Rank:
    """How many places of a bitmap before a given one are set."""

    def __init__(self, there: np.ndarray):
        packed = np.packbits(there, bitorder="little")
        self.words = np.zeros(len(there) // 64 + 1, np.dtype("<u8"))
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def of(self, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)
        return self.before[at // 64] + np.bitwise_count(self.words[at // 64] & below)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    sizes = end - start
    offsets = np.r_[0, np.cumsum(sizes)]
    chars = data[np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(chars))


def _moved(at: np.ndarray, step: int, may) -> np.ndarray:
    """Places moved on step by step as long as each of them may."""
    at, going = at.copy(), np.arange(len(at))
    while len(going := going[may(at[going], going)]):
        at[going] += step
    return at


def _present(data: np.ndarray, line_start: np.ndarray, line_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Line, column, start and end of each token but the first of its line that is not ``0``, with start and end of the first ones."""
    is_space = data == _SPACE
    first = _moved(line_start, 1, lambda at, n: (at < line_end[n]) & is_space[np.minimum(at, len(data) - 1)])
    some = first < line_end
    line_start, line_end, first = line_start[some], line_end[some], first[some]
    forward = lambda ends: lambda at, n: (at < ends[n]) & ~is_space[np.minimum(at, len(data) - 1)]
    first_end = _moved(first, 1, forward(line_end))
    # Bytes that are neither a space nor a zero, and zeros next to each other; all lie in tokens other than "0".
    odd = (data | (_SPACE ^ _ZERO)) != _ZERO
    zero = data == _ZERO
    odd[1:] |= zero[1:] & zero[:-1]
    at = np.flatnonzero(odd)
    line = np.searchsorted(line_start, at, side="right") - 1
    kept = (line >= 0) & (at >= first_end[line]) & (at < line_end[line])
    at, line = at[kept], line[kept]
    # One place of each token is enough: the first of a run of neighbours.
    fresh = np.r_[True, (at[1:] != at[:-1] + 1) | (line[1:] != line[:-1])][: len(at)]
    at, line = at[fresh], line[fresh]
    start = _moved(at, -1, lambda at, n: (at > line_start[line[n]]) & ~is_space[at - 1])
    fresh = np.r_[True, start[1:] != start[:-1]][: len(start)]
    start, line = start[fresh], line[fresh]
    end = _moved(start, 1, forward(line_end[line]))
    kept = (end - start > 1) | (data[start] != _ZERO)
    start, end, line = start[kept], end[kept], line[kept]
    begins = ~is_space
    begins[1:] &= is_space[:-1]
    begins[first] = True
    rank = _Rank(begins)
    return line, rank.of(start) - rank.of(first[line]) - 1, start, end, first, first_end


def present_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``rowId v0 v1 ...`` to ``(id, pos, token)`` of all tokens but those that are exactly ``0``; doubled and trailing spaces give none."""
    for batch in batches:
        lines = batch.column(0)
        if not len(lines):
            continue
        wide = pa.types.is_large_string(lines.type)
        offsets = np.frombuffer(lines.buffers()[1], np.int64 if wide else np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
        if offsets[-1] == offsets[0]:
            continue
        data = np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        line, pos, start, end, first, first_end = _present(data, offsets[:-1], offsets[1:])
        ids = _strings(data, first, first_end).take(pa.array(line))
        yield pa.RecordBatch.from_arrays([ids, pa.array(pos), _strings(data, start, end)], names=["id", "pos", "token"])
