"""The numpy work done inside tasks, on Arrow data that Spark has placed there."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs

# Pairs of blocks that leave a task in one batch, about.
PAIRS_AT_ONCE = 1 << 16


def fill(block: np.ndarray, pieces: pa.Table) -> None:
    """Write pieces into a zero block; what no piece covers, and nulls, stay zero."""
    if pieces.num_rows == 0:
        return
    pieces = pieces.combine_chunks()
    vals = pieces.column("vals").chunk(0)
    sizes = vals.value_lengths().to_numpy()
    flat = vals.flatten().fill_null(0.0).to_numpy()
    at = pieces.column("at").to_numpy()
    idx = pieces.column("idx").chunk(0)
    if idx.null_count == 0:
        place = idx.flatten().to_numpy()
    elif sizes.min() == sizes.max():
        block[at, : sizes[0]] = flat.reshape(len(at), sizes[0])
        return
    else:
        ends = np.cumsum(sizes)
        place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    block[np.repeat(at, sizes), place] = flat


def checksums(blocks: pa.ListArray) -> np.ndarray:
    """Of each list of pieces the sum of its values, each times its place: (at + 1) * (pos + 1)."""
    pieces = blocks.flatten()
    vals = pieces.field("vals")
    sizes = vals.value_lengths().to_numpy()
    flat = vals.flatten().to_numpy(zero_copy_only=False)
    idx = pieces.field("idx")
    ends = np.cumsum(sizes)
    pos = np.arange(len(flat)) - np.repeat(ends - sizes, sizes) if idx.null_count else idx.flatten().to_numpy()
    weighted = flat * (pos + 1.0) * np.repeat(pieces.field("at").to_numpy() + 1.0, sizes)
    row = np.repeat(np.arange(len(blocks)), blocks.value_lengths().to_numpy())
    return np.bincount(np.repeat(row, sizes), weighted, len(blocks))


def block_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists ``a`` and ``b`` of pieces replaced by their checksums."""
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names if n not in ("a", "b")}
        for name in "ab":
            columns[f"sum_{name}"] = pa.array(checksums(batch.column(name)))
        yield pa.RecordBatch.from_pydict(columns)


class Meeting(NamedTuple):
    """Blocks that meet, of several ``bk``: those from ``a_lo`` on below ``a_hi`` with those from ``b_lo`` on below ``b_hi``."""

    bk: np.ndarray
    a: pa.StructArray
    a_lo: np.ndarray
    a_hi: np.ndarray
    b: pa.StructArray
    b_lo: np.ndarray
    b_hi: np.ndarray


def _ranges(lists: pa.ListArray) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    sizes = lists.value_lengths().to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    return lists.flatten(), ends - sizes, ends


def sent_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[Meeting]:
    for batch in batches:
        yield Meeting(batch.column("bk").to_numpy(), *_ranges(batch.column("as")), *_ranges(batch.column("bs")))


class StoredRuns:
    """Blocks below a qualified path, in order of ``bk``, read forward; what lies before the ``bk`` wanted is passed over by row groups."""

    def __init__(self, uri: str, at_once: int):
        self.uri, self.at_once, self.wanted, self.batch = uri, at_once, 0, None
        self.left = self._read()

    def _read(self) -> Iterator[pa.RecordBatch]:
        for system, path in _parts(self.uri):
            with system.open_input_file(path) as opened:
                file = pq.ParquetFile(opened)
                for n in range(file.num_row_groups):
                    known = file.metadata.row_group(n).column(0).statistics
                    if known is None or not known.has_min_max or known.max >= self.wanted:
                        yield from file.iter_batches(self.at_once, row_groups=[n])

    def reach(self, bk: int) -> np.ndarray | None:
        """The ``bk`` of the batch in hand, which has this one or what follows it; None at the end."""
        self.wanted = bk
        while self.batch is None or not self.batch.num_rows or self.batch.column("bk")[-1].as_py() < bk:
            self.batch = next(self.left, None)
            if self.batch is None:
                return None
        return self.batch.column("bk").to_numpy()


def stored_meetings(uri: str, side: str, at_once: int):
    """Blocks of one operand ``(t, bk, held)``, in order of (t, bk), with the stored ones of the other, which is ``side``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Meeting]:
        tile, stored = None, None
        for batch in batches:
            t, bk = batch.column("t").to_numpy(), batch.column("bk").to_numpy()
            held, lo, hi = _ranges(batch.column("held"))
            row = 0
            while row < len(bk):
                if tile is None or t[row] != tile:
                    tile, stored = t[row], StoredRuns(uri, at_once)
                until = row + int(np.searchsorted(t[row:], tile, side="right"))
                there = stored.reach(bk[row])
                if there is None:
                    row = until
                    continue
                stop = row + int(np.searchsorted(bk[row:until], there[-1], side="right"))
                mine = bk[row:stop]
                names = stored.batch.schema.names[1:]
                other = pa.StructArray.from_arrays([stored.batch.column(c) for c in names], names=names)
                ranges = np.searchsorted(there, mine, side="left"), np.searchsorted(there, mine, side="right")
                ours = held, lo[row:stop], hi[row:stop]
                yield Meeting(mine, *ours, other, *ranges) if side == "b" else Meeting(mine, other, *ranges, *ours)
                row = stop
                if mine[-1] == there[-1]:  # its blocks may go on in the next batch
                    stored.batch, row = None, stop - 1

    return run


def _pairs_in(m: Meeting) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``bk`` and places of both blocks of all pairs, so many at a time."""
    n_a, n_b = m.a_hi - m.a_lo, m.b_hi - m.b_lo
    total = np.r_[0, np.cumsum(n_a * n_b)]
    lo = 0
    while lo < len(m.bk):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS_AT_ONCE, side="right")) - 1)
        n = n_a[lo:hi] * n_b[lo:hi]
        row = np.repeat(np.arange(lo, hi), n)
        nth = np.arange(total[hi] - total[lo]) - np.repeat(total[lo:hi] - total[lo], n)
        yield m.bk[row], m.a_lo[row] + nth // n_b[row], m.b_lo[row] + nth % n_b[row]
        lo = hi


def pairs_of(meetings, sides: tuple[tuple[str, int], ...], whole: bool):
    """Every pair of blocks that meet, with the ``whole`` blocks or the checksums of both, each worked out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in meetings(batches):
            sums = None if whole else [checksums(x.field("block")) for x in (m.a, m.b)]
            own = [x.field(c).to_numpy() for x, c in ((m.a, "bi"), (m.b, "bj"), (m.a, "n"), (m.b, "n"))]
            for bk, a, b in _pairs_in(m):
                at = {"bi": own[0][a], "bj": own[1][b], "bk": bk}
                unit = np.zeros(len(bk), np.int64)
                for name, n in sides:
                    unit = unit * max(1, n) + at[name]
                columns = {"unit": unit, **at, "n_a": own[2][a], "n_b": own[3][b]}
                if whole:
                    columns |= {"a": m.a.field("block").take(pa.array(a)), "b": m.b.field("block").take(pa.array(b))}
                else:
                    columns |= {"sum_a": sums[0][a], "sum_b": sums[1][b]}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def block_multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One block product."""
    return a @ b


def _parts(uri: str) -> Iterator[tuple[fs.FileSystem, str]]:
    """The files of a table below a qualified path, in the order of their names."""
    local = uri.startswith("file:/") and not uri.startswith("file://")
    system, folder = (fs.LocalFileSystem(), uri.removeprefix("file:")) if local else fs.FileSystem.from_uri(uri)
    for found in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
        if found.base_name.endswith(".parquet"):
            yield system, found.path


def stored_blocks(uri: str) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of each block below a qualified path, one at a time."""
    for system, path in _parts(uri):
        with system.open_input_file(path) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(1):
                yield from ((band.as_py(), block.as_py()) for band, block in zip(*batch.columns))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Neighbouring rows with the same key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.column(key).to_numpy()
        cuts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
        if held and held[0].column(key)[0].as_py() != at[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < len(at):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def join_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring bands of a row as one vector."""
    for row in groups(batches, "i"):
        vec = row.column("vec").combine_chunks().flatten()
        if isinstance(vec, pa.ChunkedArray):
            vec = vec.combine_chunks()
        yield pa.RecordBatch.from_arrays([row.column("i").chunk(0)[:1], pa.ListArray.from_arrays(np.array([0, len(vec)], np.int32), vec)], names=["id", "vec"])


def add_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum neighbouring vectors with the same key; the input is sorted by key.

    Holds one batch and one open sum, however many parts a key has.
    """
    open_key, open_sum = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        band, i = batch.column("band").to_numpy(), batch.column("i").to_numpy()
        vecs = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)
        new = np.r_[True, (band[1:] != band[:-1]) | (i[1:] != i[:-1])]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(vecs, starts, axis=0)
        keys = np.stack([band[starts], i[starts]], axis=1)
        if open_key is not None:
            if (keys[0] == open_key).all():
                sums[0] += open_sum
            else:
                keys, sums = np.vstack([open_key, keys]), np.vstack([open_sum, sums])
        open_key, open_sum = keys[-1], sums[-1]
        if len(keys) > 1:
            yield _summed(keys[:-1], sums[:-1])
    if open_key is not None:
        yield _summed(open_key[None, :], open_sum[None, :])


def _summed(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]
    return pa.RecordBatch.from_pydict(
        {
            "band": np.ascontiguousarray(keys[:, 0]),
            "i": np.ascontiguousarray(keys[:, 1]),
            "vec": pa.ListArray.from_arrays(ends, np.ascontiguousarray(sums).ravel()),
        }
    )
