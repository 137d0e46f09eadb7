"""Draws of generated cells, in numpy on whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)
# Draws made at a time: runs of a batch times draws of a run.
_DRAWS = 1 << 20
_ROOM = 1.1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(state: np.ndarray, first: int, count: int) -> np.ndarray:
    """64 random bits for the draws first..first+count-1 of every state, one row each."""
    return _mixed(state[:, None] + np.arange(first + 1, first + count + 1, dtype=np.uint64) * _STEP)


def _cells(i: np.ndarray, run: np.ndarray, p: np.ndarray, width: np.ndarray, n_cols: int, seed: int):
    """Cells of some runs: jumps until every run is left."""
    start = run * width
    end = np.minimum(start + width, n_cols)
    state = _mixed(_mixed(i.astype(np.uint64) * _STEP + np.uint64(seed)) + run.astype(np.uint64))
    with np.errstate(divide="ignore"):
        scale = 1.0 / np.log1p(-np.minimum(p, 1.0))  # -0.0 where every column has a cell
    at, first = start - 1, 0
    live = np.arange(len(i))
    while len(live):
        left = (end[live] - 1 - at[live]) * p[live]
        count = int(min(max(left.max() * _ROOM + 16, 16), max(_DRAWS // len(live), 16)))
        bits = _draws(state[live], first, count)
        uniform = ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        jump = np.minimum(np.floor(np.log(uniform) * scale[live, None]), float(1 << 62) / (count + 1)).astype(np.int64) + 1
        j = at[live, None] + np.cumsum(jump, axis=1)
        inside = j < end[live, None]
        value = 1.0 + (_mixed(bits) % np.uint64(9)).astype(np.float64)
        yield np.repeat(i[live], inside.sum(axis=1)), j[inside], value[inside]
        at[live] = j[:, -1]
        live = live[j[:, -1] < end[live] - 1]
        first += count


def jump_cells(n_cols: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("i", "run", "p", "width")]
            expected = np.minimum(columns[3], n_cols) * columns[2] * _ROOM + 16
            # Slices of runs that need about _DRAWS draws together.
            cuts = np.flatnonzero(np.diff(np.floor(np.cumsum(expected) / _DRAWS))) + 1
            for part in zip(*(np.split(c, cuts) for c in columns), strict=True):
                if len(part[0]):
                    for i, j, v in _cells(*part, n_cols, seed):
                        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], names=["i", "j", "v"])

    return run
