"""Modified Kneser-Ney model over words, counted and kept by Spark as tables that grow with the corpus.

A word is a run without white space, in small letters; a character of a script
that is written without spaces is a word of its own. It is told by a 64-bit
hash. Texts are dealt into two folds, and a text is scored by the counts of the
other fold, because n-grams that only the text itself holds would make it look
likely. The least hash of its n-grams deals a text, so copies, and nearly always
near copies, share a fold.

An n-gram has one row with its count in each fold. Its probability joins its
context and the n-gram without the first word; both are there for every n-gram
of any text. Texts then meet the finished table by the hash of the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmat.llm.common import SPACE, byte_prefix, chunks, mixed, stored, stretch_hash, word_edges
from gridmat.llm.kneser_ney import discounts

ORDER = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROWS = 1 << 16


def text_keys(edges: np.ndarray, prefix: np.ndarray) -> pa.Array:
    """A 64-bit hash of each text, from the ``byte_prefix`` of all; null for an empty one."""
    return pa.array(stretch_hash(prefix, edges[:-1], edges[1:]).view(np.int64), mask=np.diff(edges) == 0)


def units(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; Han, kana, Thai, Lao, Burmese and Khmer characters stand alone."""
    start, end = word_edges(data, edges)
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return start, end
    a, b = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
    alone = (a >= 0xE3) & (a <= 0xE9) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F)) | (a == 0xEF) & (b >= 0xA4) & (b <= 0xAB) | (a == 0xF0) & (b >= 0xA0)
    at = lead[alone]
    if not len(at):
        return start, end
    after = at + np.where(data[at] >= 0xF0, 4, 3)
    follows = after[after < len(data)]
    # Edges are marked by place, which keeps them sorted and without repeats.
    starts, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 4, bool)
    starts[start], ends[end] = True, True
    ends[after], ends[at[~starts[at]]] = True, True
    starts[at], starts[follows[~SPACE[data[follows]]]] = True, True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def word_grams(data: np.ndarray, edges: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text of each word, the words of the n-gram that ends there (0 before a text), and the fold of each text."""
    return hashed_grams(data, edges, order)[:3]


def hashed_grams(data: np.ndarray, edges: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``word_grams`` gives, and a hash of each n-gram."""
    low = data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    start, end = units(low, edges)
    words = stretch_hash(byte_prefix(low), start, end) if len(start) else np.zeros(0, np.uint64)
    first = np.searchsorted(start, edges)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(first))
    some = np.flatnonzero(np.diff(first) > 0)
    grams = np.zeros((order, len(words)), np.uint64)
    for back in range(order):
        grams[order - 1 - back, back:] = words[: len(words) - back]
        for k in range(back):
            # The k-th word of a text has no word so far back.
            at = first[some] + k
            grams[order - 1 - back, at[at < first[some + 1]]] = 0
    h = np.zeros(len(words), np.uint64)
    for g in grams:
        h = mixed(h * _STEP + g)
    fold = np.zeros(len(edges) - 1, bool)
    if len(some):
        fold[some] = mixed(np.minimum.reduceat(h, first[some]) + _STEP) & np.uint64(1) == 1
    return text, grams, fold, h


def _rows(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, edges in chunks(batches, "text"):
            text, grams, fold = word_grams(data, edges, order)
            keys = text_keys(edges, byte_prefix(data)).fill_null(0).to_numpy()
            for lo in range(0, len(text), _ROWS):
                t = text[lo : lo + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(keys[t]), pa.array(fold[t]), *[pa.array(g[lo : lo + _ROWS].view(np.int64)) for g in grams]], names=["text_key", "fold", *_words(order)])

    return run


def _words(order: int) -> list[str]:
    return [f"w{i}" for i in range(order)]


def gram_rows(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row for each word of each text: text_key, fold and the n-gram that ends there."""
    return docs.select("text").mapInArrow(_rows(order), "text_key long, fold boolean, " + ", ".join(f"{w} long" for w in _words(order)))


def _picked(n: Column, d: np.ndarray) -> Column:
    return F.when(n >= 3, float(d[2])).when(n == 2, float(d[1])).when(n == 1, float(d[0])).otherwise(0.0)


def _share(n: Column, taken_here: Column, total: Column, taken: Column, lower: Column) -> Column:
    """Discounted share of the context and the weight of the lower order; a context that is not in the fold leaves all to the lower order."""
    return F.when(total > 0, (n - taken_here + taken * lower) / total).otherwise(lower)


def fit(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """w0.., p0 and p1 of every n-gram of any text: its probability by the counts of either fold."""
    names = _words(order)
    rows = gram_rows(docs, order)
    levels = [stored(rows.groupBy(*names).agg(*[F.sum((F.col("fold") == bool(m)).cast("long")).alias(f"n{m}") for m in (0, 1)]), f"{order}-grams")]
    for n in range(order - 1, 0, -1):
        # A shorter n-gram counts the different words that stand before it.
        shorter = levels[-1].groupBy(*names[order - n :]).agg(*[F.sum((F.col(f"n{m}") > 0).cast("long")).alias(f"n{m}") for m in (0, 1)])
        levels.append(stored(shorter, f"{n}-grams"))
    p = None
    for n, level in enumerate(reversed(levels), 1):
        mine = names[order - n :]
        of = level.agg(*[F.sum((F.col(f"n{m}") == k).cast("long")) for m in (0, 1) for k in (1, 2, 3, 4)], F.count(F.lit(1))).first()
        d = [discounts([float(x or 0) for x in of[4 * m : 4 * m + 4]]) for m in (0, 1)]
        taken = [_picked(F.col(f"n{m}"), d[m]) for m in (0, 1)]
        sums = [F.sum(c).alias(a) for m in (0, 1) for c, a in ((F.col(f"n{m}"), f"t{m}"), (taken[m], f"k{m}"))]
        if n == 1:
            whole = level.agg(*sums).first()
            both = level.select("*", *[F.lit(float(whole[x] or 0)).alias(x) for x in ("t0", "k0", "t1", "k1")], *[F.lit(1.0 / (of[8] + 1)).alias(f"q{m}") for m in (0, 1)])
        else:
            both = level.join(level.groupBy(*mine[:-1]).agg(*sums), mine[:-1]).join(p.select(*mine[1:], F.col("p0").alias("q0"), F.col("p1").alias("q1")), mine[1:])
        p = both.select(*mine, *[_share(F.col(f"n{m}"), taken[m], F.col(f"t{m}"), F.col(f"k{m}"), F.col(f"q{m}")).alias(f"p{m}") for m in (0, 1)])
        p = stored(p, f"{n}-gram-shares") if n < order else p
    return p


def mean_logs(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """text_key and the mean log probability of the words of every text that has words, by the counts of the other fold."""
    key = F.xxhash64(*_words(order)).alias("gram")
    shares = fit(docs, order).select(key, F.log("p1").alias("l0"), F.log("p0").alias("l1"))
    met = gram_rows(docs, order).select("text_key", "fold", key).join(shares, "gram")
    return met.groupBy("text_key").agg(F.avg(F.when(F.col("fold"), F.col("l1")).otherwise(F.col("l0"))).alias("mean_log"))
