"""Exact top-k by inner product over vector-approximation files.

Vectors become whole numbers and are packed into blocks. A block holds, next
to the exact values, its approximation: every component is quantised into one
of 2**bits cells of equal width between the block's smallest and largest value
of that dimension. A scan over the cells gives each (query, row) an upper and
a lower bound of the score; the k-th lower bound rules most rows out, and the
exact vectors of the rest are read in the order of their bounds until the k-th
score is at least the next bound.

Query blocks meet row blocks on the key (row bucket, query block): the stated
query set against all rows, in blocks. A task keeps the k best so far across
the blocks that it sees, so the result rows before the last merge are k for
each query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 6
BLOCK_ROWS = 2048
QUERY_BLOCK = 4096
_PACKED = "n int, dim int, ids binary, exact binary, cells binary, low binary, width binary"


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v ARRAY<BIGINT>) with v = floor(scale * x); rows without an id, and vectors that are null or hold a null or non-finite component, are left out."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    return vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(scale))).alias("v"))


def quantise(exact: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers, and the low edge and cell width of each dimension (whole numbers)."""
    low = exact.min(axis=0)
    width = np.maximum((exact.max(axis=0) - low) // (1 << bits) + 1, 1)
    return ((exact - low) // width).astype(np.uint8), low, width


def _pack(bits: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat, start = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dim in np.unique(sizes):
                members = np.flatnonzero(sizes == dim)
                for at in range(0, len(members), rows):
                    part = members[at : at + rows]
                    exact = flat[start[part][:, None] + np.arange(dim)].astype(np.int64).reshape(len(part), dim)
                    cells, low, width = quantise(exact, bits) if dim else (exact.astype(np.uint8), exact.sum(axis=0), exact.sum(axis=0))
                    out = [[len(part)], [int(dim)], [ids[part].astype(np.int64).tobytes()], [exact.tobytes()], [cells.tobytes()], [low.tobytes()], [width.tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int32(), pa.int32(), *[pa.binary()] * 5])], names=["n", "dim", "ids", "exact", "cells", "low", "width"])

    return run


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; an error where one does not fit a BIGINT."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[-1])
    if most < 1 << 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    exact = x.astype(object) @ q.astype(object)
    return np.array(exact, dtype=np.int64)


def search_block(queries: np.ndarray, query_ids: np.ndarray, block: dict, best: list, k: int) -> None:
    """Improve ``best`` (per query a pair of arrays: score, id) by the rows of one block."""
    cells, low, width = block["cells"].astype(np.float64), block["low"].astype(np.float64), block["width"].astype(np.float64)
    floor_edge = low + cells * width
    top_edge = floor_edge + (width - 1)
    spread = max(1.0, float(np.abs(floor_edge).max(initial=0)), float(np.abs(top_edge).max(initial=0)))
    for at in range(0, len(queries), 128):
        q = queries[at : at + 128].astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        # Sums of 64-bit floats; beyond 2**53 the slack covers their rounding.
        slack = np.abs(q).sum(axis=1) * spread * (2.0**-46 if np.abs(q).sum(axis=1).max(initial=0) * spread >= 2.0**53 else 0.0)
        upper = up @ top_edge.T + down @ floor_edge.T + slack[:, None]
        lower = up @ floor_edge.T + down @ top_edge.T - slack[:, None]
        for j in range(len(q)):
            scores, ids = best[at + j]
            other = block["ids"] != query_ids[at + j]
            bound = scores[k - 1] if len(scores) >= k else -np.inf
            own = lower[j][other]
            if len(own) >= k:
                bound = max(bound, np.partition(own, len(own) - k)[len(own) - k])
            left = np.flatnonzero(other & (upper[j] >= bound))
            left = left[np.argsort(-upper[j][left], kind="stable")]
            done = 0
            while done < len(left):
                if len(scores) >= k and upper[j][left[done]] < scores[k - 1]:
                    break
                part = left[done : done + max(64, k)]
                done += len(part)
                scores = np.concatenate([scores, _scores(queries[at + j], block["exact"][part])])
                ids = np.concatenate([ids, block["ids"][part]])
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
            best[at + j] = (scores, ids)


def _unpacked(row: dict) -> dict:
    n, dim = row["n"], row["dim"]
    return {"ids": np.frombuffer(row["ids"], np.int64), "exact": np.frombuffer(row["exact"], np.int64).reshape(n, dim), "cells": np.frombuffer(row["cells"], np.uint8).reshape(n, dim), "low": np.frombuffer(row["low"], np.int64), "width": np.frombuffer(row["width"], np.int64)}


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                key = (row["qb"], row["dim"])
                if key not in state:
                    q = np.frombuffer(row["q_exact"], np.int64).reshape(row["q_n"], row["dim"])
                    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    state[key] = (q, np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_keys"], np.int64), [empty] * len(q))
                q, ids, _, best = state[key]
                search_block(q, ids, _unpacked(row), best, k)
        for q, ids, keys, best in state.values():
            sizes = [len(s) for s, _ in best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(keys, sizes)), pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))],
                    names=["qkey", "query_id", "vec_id", "score"],
                )

    return run


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of queries, from rows (qb, dim, members)."""
    for batch in batches:
        for i in range(batch.num_rows):
            members = batch.column("members")[i].as_py()
            dim = batch.column("dim")[i].as_py()
            exact = np.array([m["v"] for m in members], np.int64).reshape(len(members), dim)
            out = [[batch.column("qb")[i].as_py()], [dim], [len(members)], [np.array([m["id"] for m in members], np.int64).tobytes()], [np.array([m["qkey"] for m in members], np.int64).tobytes()], [exact.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 3])], names=["qb", "q_dim", "q_n", "q_ids", "q_keys", "q_exact"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, bits: int = BITS, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest score of every query, ties to the smaller id.

    Vectors of another length than the query's are not its candidates. A
    repeated id names one item per row; a query leaves out every row with its
    own id, and each row of a repeated query answers for itself. A query with
    no candidate, and an empty table, give no rows. The number of query blocks
    comes from the number of queries; blocks and buckets bound memory, not results.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_col, vec_col, scale)
    asked = whole_numbers(queries, id_col, vec_col, scale)
    n_blocks = max(1, -(-asked.count() // query_block))
    buckets = max(1, -(-2 * spark.sparkContext.defaultParallelism // n_blocks))
    packed = (
        rows.mapInArrow(_pack(bits, block_rows), _PACKED)
        .withColumn("bucket", F.pmod(F.xxhash64("ids"), F.lit(buckets)).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    )
    grouped = (
        asked.withColumn("qkey", F.monotonically_increasing_id())
        .withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
        .groupBy("qb", F.size("v").alias("dim"))
        .agg(F.collect_list(F.struct("id", "qkey", "v")).alias("members"))
        .mapInArrow(_pack_queries, "qb int, q_dim int, q_n int, q_ids binary, q_keys binary, q_exact binary")
        .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    )
    met = packed.join(grouped.withColumnRenamed("q_dim", "dim"), ["bucket", "qb", "dim"])
    found = met.mapInArrow(_search(k), "qkey long, query_id long, vec_id long, score long")
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
