"""Shared helpers: scratch tables, bounded batches of text, word hashes on byte arrays."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
CHUNK_BYTES = 1 << 20
#: Rows reach the workers in batches of so many bytes: a batch is held by the executor and by its worker, beside what the task works on.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; below the warehouse where that is unset."""
    root = spark.conf.get(SETTING, None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def set_for(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold for the actions inside."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``scratch_path`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shipped(spark: SparkSession, value: object) -> Broadcast:
    """An object of the library for every task. A broadcast names classes by their module, which executors need not have; this one carries them along."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(value: Broadcast) -> object:
    """In a task, the object that was ``shipped``."""
    return pickle.loads(value.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


# ---------------------------------------------------------------- batches of text


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[edges[0] : edges[-1]], edges - edges[0]


def release_memory() -> None:
    """Give freed memory back to the system: a worker process lives on after its task, beside the executor's other ones."""
    process_cache().pop("powers", None)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES):
    """Slices of the batches with at most ``limit`` bytes of text (a longer text comes alone): (slice, bytes, offsets)."""
    for batch in batches:
        data, edges = text_buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo]
            lo = hi
    release_memory()


# ---------------------------------------------------------------- hashes modulo 2**64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def process_cache() -> dict:
    """What a worker process keeps between tasks; functions are shipped by value, so their modules are not kept."""
    return sys.modules.setdefault("llm_process_cache", types.ModuleType("llm_process_cache")).__dict__


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n (at least)."""
    kept = process_cache().get("powers")
    if kept is None or len(kept[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        kept = []
        for base in (_BASE, _INVERSE):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            kept.append(np.cumprod(full, dtype=np.uint64))
        process_cache()["powers"] = kept
    return kept[0], kept[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """n + 1 running sums of value * base**i, from which the hash of any stretch follows."""
    return _running(values * powers(len(values) + 1)[0][: len(values)])


def _running(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values, out=out[1:])
    return out


def byte_prefix(data: np.ndarray) -> np.ndarray:
    values = _BYTE_VALUES.take(data)
    values *= powers(len(data) + 1)[0][: len(data)]
    return _running(values)


def stretch_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of [start, end); equal for equal stretches wherever they stand (64 bits)."""
    _, down = powers(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# ---------------------------------------------------------------- words

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_edges(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; a word never crosses a text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (data - np.uint8(9) > 4) & (data != 32)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    cuts = edges[(edges > 0) & (edges < n)]
    first[cuts] = True
    last[cuts - 1] = True
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def owner_of(positions: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of the text that each position lies in."""
    return np.searchsorted(edges, positions, side="right") - 1
