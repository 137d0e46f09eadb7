"""Periodic stretches of words in texts, and texts without their repetitions.

A run is a widest stretch of consecutive words whose smallest period q fits it
several times. Each text is worked on by itself, whole, in the task that holds
it; nothing is shuffled. Words are numbered exactly, by a dictionary of the text.

Long texts seldom repeat anything, so the places that can lie in a run are
found first: a run of at least 24 words and three periods holds equal windows
of 16 words one period apart, and such windows cover it. The stretches that
repeated windows cover are searched by ``lyndon.runs``; no run reaches out of
one, so nothing is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridmat.llm.common import release_memory
from gridmat.llm.lyndon import runs

LEAST_WORDS = 24
LEAST_EXPONENT = 3
#: A run of LEAST_WORDS and LEAST_EXPONENT periods is at least so many words longer than its period.
WINDOW = 16
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def planted(words: list, doc_id: int | None) -> list:
    """The words with a repetition written over their tail where the contract of the query asks for one."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def numbered(words: list) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def repeated_stretches(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Widest stretches covered by windows of WINDOW words that the text holds more than once."""
    n = len(numbers)
    if n <= WINDOW:
        return []
    h = numbers.astype(np.uint64)
    width = 1
    while width < WINDOW:  # equal windows of twice the width: equal halves
        h = h[:-width] * _STEP + h[width:]
        h = (h ^ (h >> np.uint64(29))) * _STEP
        width *= 2
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    if not len(at):
        return []
    gap = np.flatnonzero(at[1:] > at[:-1] + WINDOW)
    return list(zip(at[np.append(0, gap + 1)].tolist(), (at[np.append(gap, len(at) - 1)] + WINDOW).tolist(), strict=True))


def word_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start and period."""
    numbers = numbered(words)
    out = []
    for lo, hi in repeated_stretches(numbers):
        out.extend((lo + s, length, p) for s, length, p in runs(numbers[lo:hi], LEAST_WORDS, LEAST_EXPONENT))
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repetitions(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words less those that any run contains after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, length, p in found:
        change[s + p] += 1
        change[s + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def _tagged(names: list[str]):
    """Adds to each row the runs of its text and what is left of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, left = [], []
            for text in batch.column("text").cast(pa.large_binary()):
                raw = text.as_py()
                words = (raw or b"").split()
                found = word_runs(words)
                listed.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                left.append(None if raw is None else b" ".join(without_repetitions(words, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed, _RUNS), pa.array(left, pa.binary()).cast(pa.string())], names=[*names, "runs", "collapsed"])
        release_memory()

    return run


def find_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of each document with ``runs`` and ``collapsed``.

    ``runs`` lists start, length and period, counted in words from 0, by start
    and period. ``collapsed`` is the words outside of repetitions, joined by one
    space. A null text has no runs and stays null; an empty text, or one of
    white space, gives an empty text. Repeated rows are answered alike; an empty
    table gives no rows. Columns of the table named like the new ones are replaced.
    """
    columns = [c for c in (keep or docs.columns) if c not in ("runs", "collapsed")]
    # Other columns travel under numbered names, so that none clashes with a new one.
    plain = docs.select("text", *[docs[c].alias(f"_c{i}") for i, c in enumerate(columns)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = plain.mapInArrow(_tagged(plain.columns), f"{fields}, runs {RUNS}, collapsed string")
    return out.select(*[out[f"_c{i}"].alias(c) for i, c in enumerate(columns)], "runs", "collapsed")


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DIGEST.split(", ")]
    for batch in batches:
        rows = []
        texts = batch.column("text").cast(pa.large_binary())
        for doc_id, text in zip(batch.column("doc_id"), texts, strict=True):
            words = planted((text.as_py() or b"").split(), doc_id.as_py())
            found = word_runs(words)
            # The greatest exponent; of equal ones the first by start, then period.
            best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
            left = b" ".join(without_repetitions(words, found))
            milli = 1000 * best[1] // best[2] if best else None
            rows.append((doc_id.as_py(), len(found), *(best or (None,) * 3), milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(columns)], names=names)
    release_memory()


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text, one row per document.

    The ids decide which texts get a repetition planted first (``planted``); a
    null id plants none. A null, empty or wordless text has no runs, four nulls
    and the digests of the empty string. Repeated rows are answered alike; an
    empty table gives no rows; other columns are not looked at.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_digest, DIGEST)


__all__ = ["find_runs", "planted", "repeated_stretches", "run_digests", "without_repetitions", "word_runs"]
