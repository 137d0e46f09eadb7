"""Removal of repeated passages, judged by suffix order.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else
in the corpus.

1.  Anchors. Of every LENGTH-byte window the anchor is its K-byte string with
    the least hash, so equal windows have equal anchors at the same place. The
    windows of one anchor are consecutive; the bytes that they cover are the
    anchor's context. About one position in sixty is an anchor, and only the
    hashes of anchor and context are shuffled. This loses nothing: windows that
    are equal stand in contexts with the same anchor.
2.  Equal contexts are repeats in full, told from their hashes. A task sums up
    the contexts that it has seen more than once before anything is shuffled,
    and deals the contexts of an anchor that it sees often out by context.
3.  Contexts that share an anchor but differ go to the shard of the anchor, one
    copy of each. A shard orders all suffixes of its contexts with their common
    prefixes by external induced sorting (``induced_sort``); neighbours that
    share LENGTH bytes are repeats. An anchor with very many different contexts
    is not sorted in one task: its windows are counted one by one instead, by
    their hash, which sums up before the shuffle.
4.  The stretches found are joined to the texts by text hash, merged and cut.

Hashes are of 64 bits (a text: 64 bits and its length).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmat.llm.common import byte_prefix, chunks, partitions, release_memory, stored, stretch_hash
from gridmat.llm.induced_sort import suffix_order

LENGTH = 200
K = 80
#: Anchors that a task sums up at once.
ANCHORS_AT_ONCE = 2_000_000
#: Bytes of text whose windows a task looks at at once; it holds some 15 numbers for each.
TEXT_AT_ONCE = 1 << 18
#: Text of contexts that a task sorts at once (whole anchors; a larger one alone).
SHARD_BYTES = 2 << 20
#: A task that sees so many different contexts of an anchor deals them out by context instead of by anchor.
OFTEN = 16
#: An anchor with more different contexts than this is counted by windows.
MANY_CONTEXTS = 4_000
BROADCAST_ROWS = 300_000
_LOW = np.uint64((1 << 24) - 1)
_ROW = "h long, ctx long, th long, nb long, lo long, n long, whole boolean, one boolean, often boolean"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def anchors(data: np.ndarray, edges: np.ndarray, length: int = LENGTH, k: int = K):
    """(anchor hash, context hash, text, first window, last window) of every anchor; windows are numbered from the text's start."""
    none = np.zeros(0, np.int64)
    n = len(data)
    w = length - k + 1
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, None
    prefix = byte_prefix(data)
    grams = n - k + 1
    at = np.arange(grams)
    hashes = stretch_hash(prefix, at, at + k)
    # The high bits of the hash, then the place: the least is the leftmost of the least hash.
    key = (hashes & ~_LOW) | at.astype(np.uint64)
    blocks = -(-grams // w)
    padded = np.full(blocks * w, np.uint64((1 << 64) - 1))
    padded[:grams] = key
    table = padded.reshape(blocks, w)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(right[:windows], left[w - 1 : w - 1 + windows])
    size = np.diff(edges)
    has = np.flatnonzero(size >= length)
    counts = size[has] - length + 1
    text = np.repeat(has, counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(edges[has], counts)
    place = (least[start] & _LOW).astype(np.int64)
    turn = np.ones(len(start), bool)
    turn[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(turn)
    last = np.append(first[1:], len(start)) - 1
    text = text[first]
    lo, hi = start[first], start[last]
    return hashes[place[first]], stretch_hash(prefix, lo, hi + length), text, lo - edges[text], hi - edges[text], prefix


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, count = [], 0

    def summed():
        h, ctx, th, nb, lo, n = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((ctx, h))
        same = (h[order][1:] == h[order][:-1]) & (ctx[order][1:] == ctx[order][:-1])
        whole = np.zeros(len(h), bool)
        whole[order[1:]] |= same
        whole[order[:-1]] |= same
        one = np.zeros(len(h), bool)
        one[order] = np.append(True, ~same)
        first = np.append(True, h[order][1:] != h[order][:-1])
        group = np.cumsum(first) - 1
        many = np.bincount(group, weights=one[order]) >= OFTEN
        often = np.zeros(len(h), bool)
        often[order] = many[group]
        for at in range(0, len(h), 1 << 16):
            yield _batch([c[at : at + (1 << 16)] for c in (h.view(np.int64), ctx.view(np.int64), th, nb, lo, n, whole, one, often)], _NAMES)
        # A mark for each of these anchors, so that a single context of another task knows that it is not alone.
        marks = h[order][first][many].view(np.int64)
        zero, yes = np.zeros(len(marks), np.int64), np.ones(len(marks), bool)
        yield _batch([marks, zero, zero, zero, zero, zero, ~yes, yes, ~yes], _NAMES)

    # A single text beyond 2**24 bytes would not fit the place bits; it is cut into overlapping parts.
    for part, data, edges in chunks(batches, "text", TEXT_AT_ONCE):
        keys = part.column("th").to_numpy()
        for h, ctx, text, nb, lo, n in _parts(data, edges):
            if len(h):
                held.append((h, ctx, keys[text], nb, lo, n))
                count += len(h)
        if count >= ANCHORS_AT_ONCE:
            yield from summed()
            held, count = [], 0
    if held:
        yield from summed()


def _parts(data: np.ndarray, edges: np.ndarray, most: int = 1 << 23):
    """Anchor rows of a chunk, with the number of the text; one very long text is taken in stretches whose windows do not overlap."""
    size = np.diff(edges)
    if len(data) <= most:
        h, ctx, text, lo, hi, _ = anchors(data, edges)
        yield h, ctx, text, size[text], lo, hi - lo + 1
        return
    for at in range(0, len(data) - LENGTH + 1, most):
        piece = data[at : at + most + LENGTH - 1]
        h, ctx, text, lo, hi, _ = anchors(piece, np.array([0, len(piece)]))
        yield h, ctx, text, np.full(len(h), size[0]), lo + at, hi - lo + 1


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and context, those that share an anchor; ``whole`` for equal contexts, ``one`` for one row of each context to compare."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            yield _judged(batch.slice(0, cut))
        rest = batch.slice(cut)
    if rest is not None and rest.num_rows:
        yield _judged(rest)


def _judged(batch: pa.RecordBatch) -> pa.RecordBatch:
    h, ctx = batch.column("h").to_numpy(), batch.column("ctx").to_numpy()
    same_h = h[1:] == h[:-1]
    same = same_h & (ctx[1:] == ctx[:-1])
    whole = batch.column("whole").to_numpy(zero_copy_only=False).copy()
    whole[1:] |= same
    whole[:-1] |= same
    # Anchors with more than one context, here or known to have them elsewhere.
    group = np.cumsum(np.append(True, ~same_h)) - 1
    kinds = np.bincount(group, weights=np.append(True, ~same))[group]
    one = np.append(True, ~same) & ((kinds > 1) | batch.column("often").to_numpy(zero_copy_only=False))
    keep = (whole | one) & (batch.column("n").to_numpy() > 0)
    out = [batch.column(c) for c in _NAMES[:6]] + [pa.array(whole), pa.array(one), batch.column("often")]
    return pa.RecordBatch.from_arrays(out, names=_NAMES).filter(pa.array(keep))


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, th, nb, wanted: [h, lo, n]) to one row per context with its bytes."""
    for batch in batches:
        raw, wanted = batch.column("text").cast(pa.binary()), batch.column("wanted")
        for i in range(batch.num_rows):
            text, th, nb = raw[i].as_py(), batch.column("th")[i].as_py(), batch.column("nb")[i].as_py()
            rows = wanted[i].as_py()
            yield _batch([[r["h"] for r in rows], [th] * len(rows), [nb] * len(rows), [r["lo"] for r in rows], [text[r["lo"] : r["lo"] + r["n"] + LENGTH - 1] for r in rows]], ["h", "th", "nb", "lo", "bytes"])


def repeated_windows(pieces: list[bytes], length: int, limit: int = 1 << 20) -> list[np.ndarray]:
    """For each piece, where the strings of ``length`` bytes start that start more than once in all pieces."""
    sizes = np.array([len(p) for p in pieces])
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(at[-1], np.uint16)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    text[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    found = np.zeros(len(text), bool)
    last = -1
    for pos, lcp in suffix_order(text, length, limit):
        if not len(pos):
            continue
        hit = lcp >= length
        found[pos[hit]] = True
        found[pos[:-1][hit[1:]]] = True
        if hit[0] and last >= 0:
            found[last] = True
        last = pos[-1]
    where = np.flatnonzero(found)
    owner = np.searchsorted(at, where, side="right") - 1
    return [where[lo:hi] - at[i] for i, (lo, hi) in enumerate(zip(np.searchsorted(owner, np.arange(len(pieces))), np.searchsorted(owner, np.arange(len(pieces)), side="right")))]


def _stretches(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Windows as merged [from, to) stretches."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist()))


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; shards of whole anchors. Gives stretches (th, nb, lo, hi)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def solve(rows: pa.RecordBatch):
        out = []
        pieces = rows.column("bytes").to_pylist()
        for th, nb, lo, starts in zip(rows.column("th").to_pylist(), rows.column("nb").to_pylist(), rows.column("lo").to_pylist(), repeated_windows(pieces, LENGTH)):
            out.extend((th, nb, lo + a, lo + b) for a, b in _stretches(starts, LENGTH))
        cols = list(zip(*out)) if out else [[]] * 4
        return _batch([pa.array(c, pa.int64()) for c in cols], ["th", "nb", "lo", "hi"])

    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            held.append(part)
            size += part.column("bytes").nbytes
            if size >= SHARD_BYTES:
                rows = pa.concat_batches(held)
                h = rows.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield solve(rows.slice(0, cut))
                held = [rows.slice(cut)]
                size = held[0].column("bytes").nbytes
    if held:
        yield solve(pa.concat_batches(held))
    release_memory()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of a context."""
    for batch in batches:
        for th, nb, lo, text in zip(*(batch.column(c).to_pylist() for c in ("th", "nb", "lo", "bytes"))):
            data = np.frombuffer(text, np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            w = stretch_hash(byte_prefix(data), at, at + LENGTH).view(np.int64)
            yield _batch([w, np.full(len(w), th), np.full(len(w), nb), lo + at], ["w", "th", "nb", "lo"])


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, non-touching [from, to) stretches of a list of them."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[first, 0], reach[np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)]], axis=1)


class Repeats:
    """The repeated stretches of a table with a text column."""

    def __init__(self, docs: DataFrame):
        self.docs, self.spark = docs, docs.sparkSession

    def _small(self, df: DataFrame) -> DataFrame:
        """Sent to every task where it is checked to be small, else joined by a shuffle."""
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def keyed(self, columns: list[str]) -> DataFrame:
        """The columns with the text key and the byte length. Spark's own expressions: a worker for them would stand beside the one that cuts the texts."""
        return self.docs.select(*columns, F.xxhash64("text").alias("_th"), F.octet_length("text").cast("long").alias("_nb"))

    def stretches(self) -> DataFrame:
        """(th, nb, lo, hi): bytes lo..hi of the text are repeated; stretches may overlap."""
        rows = self.docs.select("text", F.xxhash64("text").alias("th")).mapInArrow(_anchor_rows, _ROW)
        # What a task has already found repeated need not meet the others, but for one row. Contexts of a frequent anchor are spread.
        key = F.when(F.col("one") & F.col("often"), F.xxhash64("h", "ctx")).when(F.col("one"), F.col("h")).otherwise(F.col("th"))
        dealt = rows.repartition(partitions(self.spark), key)
        met = stored(dealt.sortWithinPartitions("h", "ctx").mapInArrow(_met, _ROW), "contexts")
        covered = ["th", "nb", "lo", (F.col("lo") + F.col("n") + LENGTH - 1).alias("hi")]
        # A context may have been dealt both ways: equal ones that have not met yet meet here, summed up before the shuffle.
        ones = met.where("one")
        kept = stored(ones.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("th", "nb", "lo", "n")).alias("first")), "kept-contexts")
        again = ones.join(self._small(kept.where("k > 1").select("h", "ctx")), ["h", "ctx"])
        whole = met.where("whole").select(*covered).unionByName(again.select(*covered))
        compare = kept.select("h", "first.*")
        wanted = stored(compare.groupBy("th", "nb").agg(F.collect_list(F.struct("h", "lo", "n")).alias("wanted")), "wanted")
        texts = self.keyed(["text"]).join(self._small(wanted), (F.col("_th") == F.col("th")) & (F.col("_nb") == F.col("nb")))
        pieces = stored(texts.select("text", "th", "nb", "wanted").mapInArrow(_cut_contexts, "h long, th long, nb long, lo long, bytes binary"), "pieces")
        many = pieces.groupBy("h").agg(F.countDistinct("th", "lo").alias("k")).where(F.col("k") > MANY_CONTEXTS).select("h")
        many = stored(many, "many")
        apart = self._small(many)
        shards = pieces.join(apart, "h", "left_anti").dropDuplicates(["th", "nb", "lo"])
        sorted_ = shards.repartition(partitions(self.spark), "h").sortWithinPartitions("h", "th", "lo").mapInArrow(_sort_shards, "th long, nb long, lo long, hi long")
        windows = pieces.join(apart, "h", "left_semi").dropDuplicates(["th", "nb", "lo"]).mapInArrow(_windows, "w long, th long, nb long, lo long")
        often = windows.groupBy("w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("w")
        counted = windows.join(often, "w").select("th", "nb", "lo", (F.col("lo") + LENGTH).alias("hi"))
        return whole.unionByName(sorted_).unionByName(counted)

    def with_spans(self, columns: list[str]) -> DataFrame:
        """The given columns of every row with _th, _nb and ``spans``, the merged stretches (null where there are none)."""
        spans = stored(self.stretches().groupBy(F.col("th").alias("_t"), F.col("nb").alias("_n")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).mapInArrow(_merge_rows, "_t long, _n long, spans array<struct<lo: bigint, hi: bigint>>"), "spans")
        keyed = self.keyed(list(dict.fromkeys([*columns, "text"])))
        return keyed.join(self._small(spans), (F.col("_th") == F.col("_t")) & (F.col("_nb") == F.col("_n")), "left").drop("_t", "_n")


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in batch.column("spans"):
            values = spans.values
            pairs = merged(np.stack([values.field("lo").to_numpy(), values.field("hi").to_numpy()], axis=1))
            out.append([{"lo": a, "hi": b} for a, b in pairs.tolist()])
        yield pa.RecordBatch.from_arrays([batch.column("_t"), batch.column("_n"), pa.array(out, _SPANS)], names=["_t", "_n", "spans"])


def _kept(raw: bytes, spans: list[dict] | None) -> bytes:
    if not spans:
        return raw
    cuts = [0, *(e for s in spans for e in (s["lo"], s["hi"])), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, counts, digests = [], [], [], []
        for raw, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans")):
            raw, spans = raw.as_py() or b"", spans.as_py()
            rest = _kept(raw, spans)
            sizes.append(len(raw))
            removed.append(len(raw) - len(rest))
            counts.append(len(spans or ()))
            digests.append(hashlib.sha256(rest).hexdigest())
        yield _batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), digests], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A null text is empty; a text under LENGTH bytes loses nothing. Every copy of
    a repeated passage goes, repeated rows included. The cut may fall inside a
    character: the digest is of bytes. An empty table gives no rows.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    rows = Repeats(plain).with_spans(["doc_id"]).select("doc_id", "text", "spans")
    return rows.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _rewritten(names: list[str], index: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Slices, so that neither side holds a second copy of a whole batch.
        for batch, _, _ in chunks(batches, "text", TEXT_AT_ONCE):
            texts = []
            for raw, spans in zip(batch.column(index).cast(pa.binary()), batch.column(len(names))):
                raw, spans = raw.as_py(), spans.as_py()
                texts.append(None if raw is None else _kept(raw, spans).decode("utf-8", errors="ignore"))
            columns = [batch.column(i) if i != index else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with every repeated passage cut out of their text; documents left without a word are dropped, others keep their columns."""
    columns = docs.columns
    index = columns.index("text")
    names = ["text" if c == "text" else f"_c{i}" for i, c in enumerate(columns)]
    rows = Repeats(docs.toDF(*names)).with_spans(names).select(*names, "spans")
    fields = ", ".join(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, columns))
    cut = rows.mapInArrow(_rewritten(names, index), fields)
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).toDF(*columns)
