"""Modified Kneser-Ney model over words, in sorted hash arrays that Spark counts and looks up.

Words, folds and discounts are those of ``word_model``. Documents are read in
blocks of whole texts. For n = order down to 1, a block sends its different
n-grams once, as sorted hashes coded by their differences, in slices by
hash range; a task adds up one range over all blocks and answers every block,
in the order in which it asked, with the totals that its texts need. Long levels
take their ranges in turns, and answers are dealt out share by share, so that
little lies on the disk twice. The first block that asks for
an n-gram owns it: owners alone pass totals on to the next level, so every
n-gram adds one to the count of its last n - 1 words and to the sums of its
first n - 1, in whichever block it is found. The last reading of a block finds
all levels there and writes a mean log probability for each text.

Nothing is pruned, and no key gathers rows: hashes spread evenly, and a block
sends an n-gram once however often it occurs. Keys have so many bits that about
one n-gram in ten million shares its key with another; differences take 3 to 4 of
their bytes, and the statistics of an n-gram are a number in a dictionary. A block is told by its partition and its place in it, so the documents
must come in the same order at each reading, as those of a table do; a block
that meets the answers of another fails the job.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmat.llm.common import SMALL_BATCHES, chunks, dropped, mixed, partitions, process_cache, release_memory, scratch_path, set_for
from gridmat.llm.kneser_ney import discounts
from gridmat.llm.warc import _filesystem, _qualified
from gridmat.llm.word_model import hashed_grams

ORDER = 3
#: Texts are dealt into folds by n-grams of this order, whatever the order of the model.
FOLD_ORDER = 3
#: Bits of a key beyond those that number all bytes of text.
SPARE_BITS = 20
#: The shuffle of a level is freed once its answers are stored.
_FREE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A block ends with the text that fills so many words.
BLOCK_WORDS = 1 << 19
#: Levels between the words and the order ask about the most: so many parts of the ranges are taken one after the other, each with a reading of the documents, so that less lies on the disk at once.
TURNS = 2
#: Shares of the blocks to which answers are dealt out one after the other.
SHARES = 4
#: Bytes of text for each range of hashes.
RANGE_BYTES = 1 << 25
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = 1 << 24
#: Bytes of text, and words, that are worked on at once: their arrays stay in the processor's cache.
TEXT_AT_ONCE = 1 << 18
_AT_ONCE = 1 << 15
#: Rows of packed arrays that leave a task together.
ROWS = 64
ASKED = "part int, block long, n int, check long, keys binary, kinds int, dictionary binary, codes binary, folds binary"
ANSWERED = "block long, part int, n int, check long, kinds int, dictionary binary, codes binary, own binary, tally array<bigint>"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


class Level(NamedTuple):
    """A finished level: folder of its answers; bits of a key; by fold the discounts (of counts 0, 1, 2, 3 or more), the sum of all counts and what is taken from them; number of different n-grams."""

    path: str
    bits: int
    discounts: np.ndarray
    total: np.ndarray
    taken: np.ndarray
    grams: int


# ---------------------------------------------------------------- arrays as bytes


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, compressed; a first byte says how many planes the largest number needs."""
    values = np.ascontiguousarray(values, np.uint64).ravel()
    size = -(-int(values.max(initial=0)).bit_length() // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :size].T)
    return bytes([size]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and data[0]:
        planes = pa.decompress(pa.py_buffer(data)[1:], decompressed_size=data[0] * n, codec="zstd")
        out[:, : data[0]] = np.frombuffer(planes, np.uint8).reshape(-1, n).T
    return out.view(np.uint64).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n), dtype=np.uint64)


def ordered(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned numbers: their high bits are sorted with their places, which is faster than an argsort."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64)
    low, place = keys.min(), np.uint64((n - 1).bit_length())
    drop = np.uint64(max(0, int(keys.max() - low).bit_length() + int(place) - 64))
    both = keys - low
    both >>= drop
    both <<= place
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << int(place)) - 1)
    order = both.view(np.int64)
    if drop:
        found = keys[order]
        if (found[1:] < found[:-1]).any():
            return np.argsort(keys, kind="stable")
    return order


def columns(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of a table of statistics, and the number of each column among them."""
    bits = 60 // len(stats)
    h = np.zeros(stats.shape[1], np.uint64)
    for row in stats:
        h = h << np.uint64(bits) | row.view(np.uint64)
    # Small numbers stand side by side; columns with a larger one are told by a hash.
    large = np.flatnonzero(np.bitwise_or.reduce(stats, axis=0) >> bits)
    if len(large):
        rest = np.zeros(len(large), np.uint64)
        for row in stats:
            rest = mixed(rest * _STEP + row[large].view(np.uint64))
        h[large] = rest | np.uint64(1 << 63)
    ranked = np.sort(h)
    ranked = ranked[np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]]
    number = np.searchsorted(ranked, h)
    where = np.empty(len(ranked), np.int64)
    where[number] = np.arange(len(h))
    return stats[:, where], number


def packed_columns(different: np.ndarray, number: np.ndarray) -> tuple[int, bytes, bytes]:
    """Columns as a dictionary of those that occur, most frequent first, and numbers there: size, dictionary, numbers."""
    often = np.bincount(number, minlength=different.shape[1])
    used = np.flatnonzero(often)
    ranked = used[np.argsort(-often[used], kind="stable")]
    code = np.empty(len(often), np.uint64)
    code[ranked] = np.arange(len(ranked), dtype=np.uint64)
    return len(ranked), packed(different[:, ranked]), packed(code[number])


def unpacked_columns(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The dictionaries of the rows' statistics side by side, and the numbers there."""
    different, number, before = [np.zeros((width, 0), np.int64)], [np.zeros(0, np.int32)], 0
    for row in rows:
        size = row["kinds"]
        different.append(unpacked(row["dictionary"], size * width).reshape(width, size).view(np.int64))
        number.append(unpacked(row["codes"], row["n"]).astype(np.int32))
        number[-1] += before
        before += size
    return np.concatenate(different, axis=1), np.concatenate(number)


# ---------------------------------------------------------------- blocks of documents


class Block:
    """The words of whole texts, and their n-grams as sorted arrays of keys without repeats."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        before = np.cumsum([0] + [len(fold) for _, _, fold, _ in parts])
        self.text = np.concatenate([text + b for (text, _, _, _), b in zip(parts, before)])
        self.words = np.concatenate([words for _, words, _, _ in parts], axis=1)
        self.fold = np.concatenate([fold for _, _, fold, _ in parts])
        self.full = np.concatenate([h for _, _, _, h in parts])
        self.starts = np.append(True, self.text[1:] != self.text[:-1])[: len(self.text)]
        self.second = self.fold[self.text]

    def hashes(self, n: int, bits: int) -> np.ndarray:
        """The key of the n-gram at each position; the position after the last one stands for the n-gram before any text."""
        h = np.zeros(len(self.text) + 1, np.uint64)
        if n == FOLD_ORDER:
            np.right_shift(self.full, np.uint64(64 - bits), out=h[:-1])
            return h
        for lo in range(0, len(h), _AT_ONCE):
            part = h[lo : lo + _AT_ONCE]
            for words in self.words[len(self.words) - n :]:
                part *= _STEP
                part[: len(words) - lo] += words[lo : lo + _AT_ONCE]
                part[:] = mixed(part)
        h >>= np.uint64(64 - bits)
        return h

    @staticmethod
    def level(h: np.ndarray, bounds: tuple[int, int] | None = None, numbered: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sorted keys of the different n-grams (within the bounds), a position of each, and the number of each position's key (the number of keys, for one outside)."""
        if bounds is None:
            order = ordered(h)
        else:
            inside = np.flatnonzero((h >= np.uint64(bounds[0])) & (h < np.uint64(bounds[1])))
            order = inside[ordered(h[inside])]
        keys = h[order]
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        if not numbered:
            return keys[new], order[new], None
        number = np.full(len(h), np.count_nonzero(new))
        number[order] = np.cumsum(new) - 1
        return keys[new], order[new], number

    def contexts(self, number: np.ndarray) -> np.ndarray:
        """From the numbers of the n-grams, the number of the one before each position."""
        return np.where(self.starts, number[-1], np.append(number[-1], number[:-2]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, Block]]:
    """Number of each block, its slices of the table with their bytes and offsets, and its words. Blocks depend on the order of the texts, not on how they come in batches."""
    number = TaskContext.get().partitionId() * _BLOCKS
    process_cache().clear()  # what other operators left in this worker
    rows, parts, size = [], [], 0
    for row, data, edges in chunks(batches, "text", TEXT_AT_ONCE):
        text, words, fold, h = hashed_grams(data, edges, FOLD_ORDER)
        upto = np.append(0, np.cumsum(np.bincount(text, minlength=len(fold))))
        lo = 0
        while lo < len(fold):
            hi = min(len(fold), int(np.searchsorted(upto, upto[lo] + BLOCK_WORDS - size)))
            mine = slice(upto[lo], upto[hi])
            parts.append((text[mine] - lo, words[:, mine], fold[lo:hi], h[mine]))
            rows.append((row.slice(lo, hi - lo), data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo]))
            size += int(upto[hi] - upto[lo])
            lo = hi
            if size >= BLOCK_WORDS:
                block, parts = Block(parts), []
                yield number, rows, block
                number, rows, size, block = number + 1, [], 0, None
    if rows:
        yield number, rows, Block(parts)
    release_memory()


def _answers(level: Level, width: int, block: int, keys: int, check: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals of the keys that a block asked for, as a dictionary with one row for each statistic and the number of each key there, and whether the block owns them."""
    system, folder = _filesystem(f"{level.path}/block={block}")
    found = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".parquet")]
    rows = sorted((row for path in found for row in pq.read_table(path, filesystem=system, partitioning=None).to_pylist()), key=lambda row: row["part"])
    if sum(row["n"] for row in rows) != keys or any(row["check"] != check for row in rows):
        raise RuntimeError("the documents came in another order than before; write them to a table first")
    own = np.concatenate([np.unpackbits(np.frombuffer(row["own"], np.uint8), count=row["n"]) for row in rows])
    return *unpacked_columns(rows, width), own.astype(bool)


def _width(n: int, order: int) -> int:
    """Statistics of an n-gram: its count in each fold; below the order also, for what follows it, the sum of counts in each fold and how many have count 1, 2, 3 or more."""
    return 2 if n == order else 10


def _statistics(block: Block, number: int, n: int, order: int, bits: int, above: Level | None, h: np.ndarray, bounds: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """What a block adds to the counts of its n-grams with keys h within the bounds: keys, statistics, and whether texts of each fold have them (None at the order, where the counts tell)."""
    keys, _, place = block.level(h, bounds)
    size = len(keys) + 1
    mine = 2 * place[:-1] + block.second
    if n == order:
        return keys, np.bincount(mine, minlength=2 * size).reshape(size, 2)[:-1].T, None
    folds = np.zeros((size, 2), bool)
    folds.reshape(-1)[mine] = True
    folds[place[-1]] = True
    out = np.zeros((_width(n, order), size), np.int64)
    longer = block.hashes(n + 1, bits)
    check = zlib.crc32(longer)
    longer, at, _ = block.level(longer, numbered=False)
    totals, code, own = _answers(above, _width(n + 1, order), number, len(longer), check)
    own &= at < len(block.text)
    at, code = at[own], code[own]
    last, context = place[at], block.contexts(place)[at]
    for m in (0, 1):
        some = np.flatnonzero((totals[m] > 0)[code])
        of, count = context[some], totals[m][code[some]]
        out[m] = np.bincount(last[some], minlength=size)
        out[4 + 3 * m : 7 + 3 * m] = np.bincount(4 * of + np.minimum(count, 3), minlength=4 * size).reshape(size, 4)[:, 1:].T
        large = np.flatnonzero(count > 2)
        np.add.at(out[2 + m], of[large], count[large])
        out[2 + m] += out[4 + 3 * m] + 2 * out[5 + 3 * m]
    return keys, out[:, :-1], folds[:-1].T


def _asked(n: int, order: int, bits: int, above: Level | None, ranges: int, turn: range):
    cuts = [-(-p * (1 << bits) // ranges) for p in range(ranges + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, block in _blocks(batches):
            h = block.hashes(n, bits)
            check = zlib.crc32(h)
            keys, stats, folds = _statistics(block, number, n, order, bits, above, h, (cuts[turn.start], cuts[turn.stop]))
            different, kind = columns(stats)
            at = np.searchsorted(keys, np.array(cuts[turn.start : turn.stop + 1], np.uint64))
            out = []
            for k in np.flatnonzero(np.diff(at)):
                mine = slice(at[k], at[k + 1])
                out.append((int(turn.start + k), number, int(at[k + 1] - at[k]), check, packed_keys(keys[mine]), *packed_columns(different, kind[mine]), None if folds is None else np.packbits(folds[:, mine]).tobytes()))
                if len(out) == ROWS:
                    yield _rows(ASKED, out)
                    out = []
            if out:
                yield _rows(ASKED, out)

    return run


def _rows(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, _ARROW[kind]) for column, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


def _tally(counts: np.ndarray, often: np.ndarray) -> list[int]:
    """By fold how many n-grams have count 1, 2, 3, 4, 3 or more, and the sum of counts; then the different n-grams. Column i of the counts is there often[i] times."""
    out = []
    for count in counts:
        out += [int(often[count == k].sum()) for k in (1, 2, 3, 4)] + [int(often[count >= 3].sum()), int((often * count).sum())]
    return out + [int(often[counts.sum(axis=0) > 0].sum())]


def _added(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["block"])
        if not rows:
            return
        keys = np.concatenate([unpacked_keys(row["keys"], row["n"]) for row in rows])
        order = ordered(keys)
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        del keys
        own = np.empty(len(order), bool)
        own[order] = new
        stats, code = unpacked_columns(rows, width)
        # Only n-grams that several blocks ask for are added up; others keep their column. From here on a column is told by its number.
        shared = np.flatnonzero(~(new & np.append(new[1:], True)))
        heads = np.flatnonzero(new[shared])
        several = order[shared]
        del order
        sums = np.empty((width, len(heads)), np.int64)
        for i in range(width):
            sums[i] = np.add.reduceat(stats[i][code[several]], heads) if len(heads) else 0
        different, kind = columns(np.concatenate([stats, sums], axis=1))
        kind = kind.astype(np.int32)
        asked = kind[code]
        total = asked.copy()
        total[several] = np.repeat(kind[stats.shape[1] :], np.diff(np.append(heads, len(several))))
        out = [(-1, rows[0]["part"], 0, 0, 0, None, None, None, _tally(different[:2], np.bincount(total[own], minlength=different.shape[1])))]
        # A text is judged by the other fold, and owners pass on the counts of both.
        if rows[0]["folds"] is None:
            in_first, in_second = (different[:2] > 0)[:, asked]
        else:
            in_first, in_second = np.concatenate([np.unpackbits(np.frombuffer(row["folds"], np.uint8), count=2 * row["n"]).reshape(2, -1) for row in rows], axis=1).astype(bool)
        variant = total
        for flag in (own, in_second, in_first):
            variant *= 2
            variant += flag
        often = np.flatnonzero(np.bincount(variant, minlength=8 * different.shape[1]))
        got, mine, wanted = different[:, often >> 3], often & 4 > 0, np.array([often & 2 > 0, often & 1 > 0])
        got[:2] *= wanted | mine
        if width > 2:
            got[2:4] *= wanted
            got[4:] *= np.repeat(wanted, 3, axis=0)
        different, kind = columns(got)
        answer = np.zeros(often[-1] + 1, np.int32)
        answer[often] = kind
        answer = answer[variant]
        hi = 0
        for row in rows:
            lo, hi = hi, hi + row["n"]
            out.append((row["block"], row["part"], row["n"], row["check"], *packed_columns(different, answer[lo:hi]), np.packbits(own[lo:hi]).tobytes(), None))
            if len(out) == ROWS:
                yield _rows(ANSWERED, out)
                out = []
        if out:
            yield _rows(ANSWERED, out)
        release_memory()

    return run


# ---------------------------------------------------------------- the model


def fit(docs: DataFrame, order: int = ORDER) -> list[Level]:
    """The levels of the model, the words first; none for a table without text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    if not size:
        return []
    ranges, bits = max(partitions(spark), -(-size // RANGE_BYTES)), min(size.bit_length() + SPARE_BITS, 63)
    with set_for(spark, _FREE | SMALL_BATCHES):
        levels: list[Level] = []
        for n in range(order, 0, -1):
            levels.insert(0, _fitted(docs, n, order, bits, levels[0] if levels else None, ranges))
    return levels


def _fitted(docs: DataFrame, n: int, order: int, bits: int, above: Level | None, ranges: int) -> Level:
    spark = docs.sparkSession
    path = _qualified(spark, scratch_path(spark, f"{n}-grams"))
    turns = TURNS if 1 < n < order else 1
    for k in range(turns):
        turn = range(k * ranges // turns, (k + 1) * ranges // turns)
        if not turn:
            continue
        asked = docs.mapInArrow(_asked(n, order, bits, above, ranges, turn), ASKED)
        answered = asked.repartitionById(len(turn), (F.col("part") - turn.start).cast("int")).mapInArrow(_added(_width(n, order)), ANSWERED)
        # What was asked is gone from the disk before the answers are dealt out to their blocks, and these go share by share.
        answers = scratch_path(spark, f"{n}-answers")
        answered.withColumn("share", F.pmod("block", F.lit(SHARES))).write.partitionBy("share").parquet(answers)
        for share in range(SHARES):
            mine = spark.read.schema(f"{ANSWERED}, share int").parquet(answers).where(F.col("share") == share).drop("share")
            mine.repartition("block").write.mode("append").partitionBy("block").parquet(path)
            dropped(spark, f"{answers}/share={share}")
        dropped(spark, answers)
    tally = spark.read.schema("tally array<bigint>").parquet(f"{path}/block=-1").agg(*[F.sum(F.col("tally")[i]) for i in range(13)]).first()
    folds = [tally[:6], tally[6:12]]
    taken = np.array([np.append(0.0, discounts([float(x) for x in t[:4]])) for t in folds])
    sums = np.array([d[1] * t[0] + d[2] * t[1] + d[3] * t[4] for d, t in zip(taken, folds)])
    return Level(path, bits, taken, np.array([float(t[5]) for t in folds]), sums, int(tally[12]))


def mean_logs(batches: Iterator[pa.RecordBatch], levels: list[Level]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """In a task: slices of the table with their bytes and offsets, and the mean log probability of each text's words by the counts of the other fold (NaN without words)."""
    order = len(levels)
    for number, rows, block in _blocks(batches):
        texts = len(block.fold)
        found = np.bincount(block.text, minlength=texts)
        share = np.full(len(block.text), 1.0 / (levels[0].grams + 1) if levels else 1.0)
        other = np.where(block.second, 0, 1)
        context = None
        for n, level in enumerate(levels, 1):
            h = block.hashes(n, level.bits)
            check = zlib.crc32(h)
            keys, _, place = block.level(h)
            totals, code, _ = _answers(level, _width(n, order), number, len(keys), check)
            kinds = totals.shape[1]
            if context is None:
                total, taken = level.total[other], level.taken[other]
            else:
                total, taken = sums.take(context), shares.take(context)
            # What an n-gram adds and takes is worked out for each column of the dictionary.
            rest = totals[:2] - np.take_along_axis(level.discounts, np.minimum(totals[:2], 3), axis=1)
            mine = rest.take(other * kinds + code[place[:-1]])
            share = np.where(total > 0, (mine + taken * share) / np.maximum(total, 1), share)
            if n < order:
                # What the next level takes from each n-gram as a context, by fold.
                d = levels[n].discounts
                sums, shares = totals[2:4].astype(float), np.array([sum(d[m, k] * totals[4 + 3 * m + k - 1] for k in (1, 2, 3)) for m in (0, 1)])
                context = other * kinds + code[block.contexts(place)]
        with np.errstate(invalid="ignore"):
            mean = np.bincount(block.text, np.log(share), minlength=texts) / found
        lo = 0
        for part, data, edges in rows:
            yield part, data, edges, mean[lo : lo + part.num_rows]
            lo += part.num_rows
