"""Exact Jaccard self-join of documents on word shingles, with skipping by set relations.

1.  Documents with the same shingle set become one set. A bounded list of the
    shingles found in most sets puts these last in the order of all shingles.
2.  Index lists. Every set enters the lists of the first shingles of its order,
    as many as a set of that size must share one of with any partner, with its
    size and the position of the shingle. Lists of one set are dropped.
3.  Skipping by position. Two entries of a list pair up only if their sizes and
    positions still allow the overlap that is needed.
4.  Skipping by answers. A list's leader is the set with the least position, the
    one with the fewest rare shingles before it. Every set is compared with the
    leader it meets most often, and linked sets form components. All other pairs
    of a list are derived: inside a component they need no comparison, and only
    (list, component, component) triples are expanded to pairs of sets.
5.  Parity bitmaps of the sets give a lower bound on the size of their symmetric
    difference, which refutes nearly every wrong pair; the rest is compared
    shingle by shingle.

A shingle is a 48-bit hash of its words; two different shingles of a pair of
documents agree by chance about once in 10**9 pairs of 500 shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmat.llm.common import LOWER, byte_prefix, chunks, mixed, owner_of, partitions, stored, stretch_hash, word_edges
from gridmat.llm.components import components

SHINGLE = 4
#: A link needs 20 * |intersection| >= 17 * |union|.
NUM, DEN = 17, 20
#: Shingles that stand last in the order: at most so many, by the number of sets.
COMMON = 200_000
#: A task reports a shingle that it has seen in so many sets.
REPORT_FROM = 4
COUNT_AT_ONCE = 6_000_000
#: Salts for entries of common shingles, whose lists may be long.
SALTS = 64
#: Words of the short bitmaps that entries carry into the last join.
SHORT_WORDS = 4
#: Set numbers up to this many are sent to every task; above, they are joined.
BROADCAST_ROWS = 1_000_000

_MASK = np.uint64((1 << 48) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, edges: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and how many each text has."""
    texts = len(edges) - 1
    low = LOWER[data]
    start, end = word_edges(low, edges)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    words = stretch_hash(byte_prefix(low), start, end)
    text = owner_of(start, edges)
    n_words = np.bincount(text, minlength=texts)
    at = np.flatnonzero(text[: max(len(text) - size + 1, 0)] == text[size - 1 :]) if len(text) >= size else np.zeros(0, np.int64)
    h = words[at]
    for k in range(1, size):
        h = mixed(h * _STEP + words[at + k])
    owner = text[at]
    # Fewer words: the whole sequence, told apart by its length.
    first = np.concatenate([[0], np.cumsum(n_words)])
    for k in range(1, size):
        short = np.flatnonzero(n_words == k)
        g = np.full(len(short), k, np.uint64)
        for j in range(k):
            g = mixed(g * _STEP + words[first[short] + j])
        h, owner = np.concatenate([h, g]), np.concatenate([owner, short])
    key = np.sort(owner.astype(np.uint64) << np.uint64(48) | h & _MASK)
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return key & _MASK, np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=texts)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _binary(blob: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(blob.tobytes())]).cast(pa.binary())


def set_hash(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, in any order of its members."""
    run = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mixed(flat + _STEP), out=run[1:])
    at = _offsets(counts)
    return mixed((run[at[1:]] - run[at[:-1]]) + counts.astype(np.uint64) * _STEP).view(np.int64)


def bitmap_bits(counts: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: a power of two of at least twice its size, 64 or more."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(2 * counts, 64))).astype(np.int64))


def bitmaps(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Per set, the parity of the members that hash to each bit."""
    bits = bitmap_bits(counts)
    at = _offsets(bits)
    spot = (mixed(flat ^ _STEP) & np.repeat(bits - 1, counts).astype(np.uint64)).astype(np.int64) + np.repeat(at[:-1], counts)
    odd = (np.bincount(spot, minlength=at[-1]) & 1).astype(np.uint8)
    return _binary(np.packbits(odd, bitorder="little"), at // 8)


def apart_at_least(a: bytes, b: bytes) -> int:
    """Lower bound on the symmetric difference from two bitmaps; the larger one is folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


# ---------------------------------------------------------------- passes over the texts


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a document's set; kind 1: a shingle seen in several sets of this task."""
    names = ["kind", "doc_id", "row_key", "h", "n", "bits"]
    seen, held = [], 0

    def report():
        token, count = np.unique(np.concatenate(seen), return_counts=True)
        often = count >= REPORT_FROM
        token, count = token[often], count[often]
        m = len(token)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(token.astype(np.int64)), pa.array(count), pa.nulls(m, pa.binary())], names=names)

    for part, data, edges in chunks(batches, "text"):
        flat, counts = shingle_sets(data, edges)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(counts), np.int32)), part.column("doc_id"), part.column("row_key"), pa.array(set_hash(flat, counts)), pa.array(counts), bitmaps(flat, counts)], names=names)
        seen.append(flat)
        held += len(flat)
        if held > COUNT_AT_ONCE:
            yield report()
            seen, held = [], 0
    if held:
        yield report()


def prefix_sizes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many first shingles a set shows to partners of any size, and to partners at least as large."""
    any_size = n - -(-NUM * n // DEN) + 1
    larger = n - -(-2 * NUM * n // (NUM + DEN)) + 1
    return any_size, larger


def _entries(common: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = common.value
        for _, data, edges in chunks(batches, "text"):
            flat, counts = shingle_sets(data, edges)
            h = set_hash(flat, counts)
            _, one = np.unique(h, return_index=True)
            mine = np.zeros(len(counts), bool)
            mine[one] = True
            mine &= counts > 0
            owner = np.repeat(np.arange(len(counts)), counts)
            keep = mine[owner]
            flat, owner = flat[keep], owner[keep]
            show = prefix_sizes(counts)[0]
            place = np.minimum(np.searchsorted(tokens, flat), max(len(tokens) - 1, 0))
            often = tokens[place] == flat if len(tokens) else np.zeros(len(flat), bool)
            rare, plenty = np.flatnonzero(~often), np.flatnonzero(often)
            plenty = plenty[np.lexsort((ranks[place[plenty]], owner[plenty]))] if len(plenty) else plenty
            n_rare = np.bincount(owner[rare], minlength=len(counts))
            n_plenty = np.bincount(owner[plenty], minlength=len(counts))
            pos_rare = np.arange(len(rare)) - np.repeat(_offsets(n_rare)[:-1], n_rare)
            pos_plenty = np.arange(len(plenty)) - np.repeat(_offsets(n_plenty)[:-1], n_plenty) + n_rare[owner[plenty]]
            index, pos = np.concatenate([rare, plenty]), np.concatenate([pos_rare, pos_plenty])
            shown = pos < show[owner[index]]
            index, pos = index[shown], pos[shown]
            who = owner[index]
            out = [flat[index].astype(np.int64), h[who], counts[who].astype(np.int32), pos.astype(np.int32), often[index]]
            for lo in range(0, len(index), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 17)]) for c in out], names=["token", "h", "n", "pos", "often"])

    return run


def _lists_of_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries without repeats and without lists of one set; entries of common shingles stay (their lists are spread)."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        token, h = batch.column("token").to_numpy(), batch.column("h").to_numpy()
        again = np.append(False, (token[1:] == token[:-1]) & (h[1:] == h[:-1]))
        if again.any():
            batch = batch.filter(pa.array(~again))
            token, h = token[~again], h[~again]
        # The last run may go on in the next batch; a long one needs no more than its last two rows to be held back.
        last = int(np.searchsorted(token, token[-1]))
        cut = last if len(token) - last < 3 else len(token) - 2
        rest = batch.slice(cut)
        yield _shared(batch, token, cut)
    if rest is not None and rest.num_rows:
        yield _shared(rest, rest.column("token").to_numpy(), rest.num_rows)


def _shared(batch: pa.RecordBatch, token: np.ndarray, cut: int) -> pa.RecordBatch:
    same_before = np.zeros(len(token), bool)
    same_before[1:] = token[1:] == token[:-1]
    same_after = np.zeros(len(token), bool)
    same_after[:-1] = same_before[1:]
    often = batch.column("often").to_numpy(zero_copy_only=False)
    keep = (same_before | same_after | often)[:cut]
    return batch.slice(0, cut).filter(pa.array(keep))


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets themselves, six bytes for a shingle."""
    for _, data, edges in chunks(batches, "text"):
        flat, counts = shingle_sets(data, edges)
        six = flat.view(np.uint8).reshape(-1, 8)[:, :6].copy()
        yield pa.RecordBatch.from_arrays([pa.array(set_hash(flat, counts)), _binary(six.ravel(), 6 * _offsets(counts))], names=["h", "six"])


def _numbers(six: bytes) -> np.ndarray:
    raw = np.frombuffer(six, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view(np.uint64).ravel()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every bitmap folded to SHORT_WORDS words; null for a shorter one, which then refutes nothing."""
    for batch in batches:
        out = np.zeros((batch.num_rows, SHORT_WORDS), np.int64)
        small = np.zeros(batch.num_rows, bool)
        for i, bits in enumerate(batch.column("bits")):
            x = np.frombuffer(bits.as_buffer(), np.int64)
            small[i] = len(x) < SHORT_WORDS
            if not small[i]:
                out[i] = np.bitwise_xor.reduce(x.reshape(-1, SHORT_WORDS), axis=0)
        yield pa.RecordBatch.from_arrays([batch.column("h"), *[pa.array(out[:, k], mask=small) for k in range(SHORT_WORDS)]], names=["h", *[f"s{k}" for k in range(SHORT_WORDS)]])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a_bits").to_pylist(), batch.column("b_bits").to_pylist()
        x, y = batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
        most = x + y - 2 * -(-NUM * (x + y) // (NUM + DEN))
        keep = [apart_at_least(p, q) <= m for p, q, m in zip(a, b, most)]
        yield batch.select(["x", "nx", "y", "ny"]).filter(pa.array(keep, pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for p, q in zip(batch.column("a_six"), batch.column("b_six")):
            a, b = _numbers(p.as_py()), _numbers(q.as_py())
            keep.append((NUM + DEN) * overlap(a, b) >= NUM * (len(a) + len(b)))
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))


# ---------------------------------------------------------------- the join


def _may_pair(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Whether sizes and positions of a common shingle leave room for the overlap that a link needs."""
    need = F.ceil(F.lit(NUM) * (n1 + n2) / F.lit(NUM + DEN))
    return (DEN * F.least(n1, n2) >= NUM * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= need)


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of a row's id and text; nulls are told from anything else."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


class SetJoin:
    """The steps of the join over one table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        doc_id = docs["doc_id"].cast("long")
        self.docs = docs.select(doc_id.alias("doc_id"), docs["text"], row_key(doc_id, docs["text"]).alias("row_key"))
        self.spark = docs.sparkSession
        first = stored(self.docs.mapInArrow(_first_pass, "kind int, doc_id long, row_key long, h long, n long, bits binary"), "sets")
        self.members = first.where("kind = 0").select("doc_id", "row_key", "h", "n")
        some = first.where("kind = 0 and n > 0")
        self.sets = stored(some.groupBy("h").agg(F.max("n").cast("int").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first"), F.min("bits").alias("bits")), "distinct-sets")
        often = first.where("kind = 1").groupBy("h").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "h").limit(COMMON).toPandas()
        token = often["h"].to_numpy(np.int64).astype(np.uint64)
        rank = np.lexsort((token, often["c"].to_numpy(np.int64))).argsort()
        order = np.argsort(token)
        self.common = self.spark.sparkContext.broadcast((token[order], rank[order]))

    def lists(self) -> DataFrame:
        entries = self.docs.mapInArrow(_entries(self.common), "token long, h long, n int, pos int, often boolean")
        salt = F.when(F.col("often"), F.pmod("h", F.lit(SALTS))).otherwise(F.lit(0))
        dealt = entries.repartition(partitions(self.spark), "token", salt)
        # Equal sets of different tasks meet here; they stand side by side after the sort.
        return stored(dealt.sortWithinPartitions("token", "h").mapInArrow(_lists_of_two, "token long, h long, n int, pos int, often boolean").select("token", "h", "n", "pos"), "lists")

    def _with_text(self, wanted: DataFrame) -> DataFrame:
        """Payload of the sets in ``wanted`` (h), from the text of the first row of each."""
        keys = stored(wanted.join(self.sets.select("h", "first"), "h").select("first.row_key").distinct(), "wanted")
        if keys.count() <= BROADCAST_ROWS:
            keys = F.broadcast(keys)
        return self.docs.join(keys, "row_key", "left_semi").mapInArrow(_payload, "h long, six binary").dropDuplicates(["h"])

    def verified(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (x, nx, y, ny) that are links, as (x, y)."""
        bits = self.sets.select("h", "bits")
        near = pairs.join(bits.select(F.col("h").alias("x"), F.col("bits").alias("a_bits")), "x").join(bits.select(F.col("h").alias("y"), F.col("bits").alias("b_bits")), "y")
        near = stored(near.mapInArrow(_near, "x long, nx int, y long, ny int"), label)
        sets = stored(self._with_text(near.select(F.col("x").alias("h")).unionByName(near.select(F.col("y").alias("h"))).distinct()), f"{label}-sets")
        both = near.join(sets.select(F.col("h").alias("x"), F.col("six").alias("a_six")), "x").join(sets.select(F.col("h").alias("y"), F.col("six").alias("b_six")), "y")
        return stored(both.mapInArrow(_linked, "x long, y long"), f"{label}-links")

    def links(self) -> DataFrame:
        """Links between sets whose components are those of all links."""
        lists = self.lists()
        leader = lists.groupBy("token").agg(F.min(F.struct("pos", "h", "n")).alias("lead"))
        to_leader = lists.join(leader, "token").where(F.col("h") != F.col("lead.h")).where(_may_pair(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
        met = to_leader.groupBy(F.col("h").alias("x"), F.col("n").alias("nx"), F.col("lead.h").alias("y"), F.col("lead.n").alias("ny")).count()
        best = met.groupBy("x", "nx").agg(F.max(F.struct("count", "y", "ny")).alias("b")).select("x", "nx", F.col("b.y").alias("y"), F.col("b.ny").alias("ny"))
        first = self.verified(best, "leaders")
        grouped = components(first, "x", "y")
        own = stored(lists.join(grouped.withColumnRenamed("node", "h"), "h", "left").select("token", "h", "n", "pos", F.coalesce("root", "h").alias("c")), "grouped-lists")
        met = own.groupBy("token", "c").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("p"), F.count(F.lit(1)).alias("size"))
        # Only lists with entries of two components have pairs left.
        mixed_lists = met.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
        met = stored(met.join(mixed_lists, "token", "left_semi"), "mixed-lists")
        a, b = met.select("token", *[F.col(c).alias(c + "1") for c in ("c", "least", "most", "p", "size")]), met.select("token", *[F.col(c).alias(c + "2") for c in ("c", "least", "most", "p", "size")])
        room = (DEN * F.col("most1") >= NUM * F.col("least2")) & (DEN * F.col("most2") >= NUM * F.col("least1"))
        # The largest sizes and the least position bound what any two members could share.
        room &= F.least(F.col("most1") - F.col("p1"), F.col("most2") - F.col("p2")) >= F.ceil(F.lit(NUM) * (F.col("least1") + F.col("least2")) / F.lit(NUM + DEN))
        # The component with fewer sets in the list comes first: it is the one that is spread without a look at the other's sets.
        first_is_smaller = (F.col("size1") < F.col("size2")) | ((F.col("size1") == F.col("size2")) & (F.col("c1") < F.col("c2")))
        triples = a.join(b, (a["token"] == b["token"]) & first_is_smaller & room).select(a["token"], "c1", "c2")
        # Entries of those lists carry a short parity bitmap, which refutes most pairs inside the join.
        short = self.sets.select("h", "bits").mapInArrow(_short, "h long, " + ", ".join(f"s{i} long" for i in range(SHORT_WORDS)))
        left = stored(own.join(mixed_lists, "token", "left_semi").join(short, "h"), "open-lists")
        x = left.select("token", F.col("c").alias("c1"), F.col("h").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), *[F.col(f"s{i}").alias(f"sx{i}") for i in range(SHORT_WORDS)])
        y = left.select("token", F.col("c").alias("c2"), F.col("h").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), *[F.col(f"s{i}").alias(f"sy{i}") for i in range(SHORT_WORDS)])
        differ = sum((F.bit_count(F.col(f"sx{i}").bitwiseXOR(F.col(f"sy{i}"))) for i in range(1, SHORT_WORDS)), F.bit_count(F.col("sx0").bitwiseXOR(F.col("sy0"))))
        most = F.col("nx") + F.col("ny") - 2 * F.ceil(F.lit(NUM) * (F.col("nx") + F.col("ny")) / F.lit(NUM + DEN))
        pairs = triples.join(x, ["token", "c1"]).join(y, ["token", "c2"]).where(_may_pair(F.col("nx"), F.col("px"), F.col("ny"), F.col("py")) & F.coalesce(differ <= most, F.lit(True))).select("x", "nx", "y", "ny").distinct()
        return first.unionByName(self.verified(pairs, "others"))

    def _rooted(self) -> DataFrame:
        """h, first and the root of its component for every set."""
        roots = components(self.links(), "x", "y").withColumnRenamed("node", "h")
        return self.sets.select("h", "first").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, h and component_id of every document."""
        sets = self._rooted()
        least = sets.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
        of_set = stored(sets.join(least, "root").select("h", "component_id"), "components")
        filled = self.members.where("n > 0").join(of_set, "h", "left")
        empty = self.members.where("n = 0").withColumn("component_id", F.col("doc_id"))
        return filled.select("doc_id", "n", "h", "component_id").unionByName(empty.select("doc_id", "n", "h", "component_id"))

    def kept_rows(self) -> DataFrame:
        """row_key of the first row of each component and of every row without shingles, and whether the table holds it several times."""
        first = self._rooted().groupBy("root").agg(F.min("first").alias("first")).select("first.row_key")
        kept = first.unionByName(self.members.where("n = 0").select("row_key")).distinct()
        several = self.members.groupBy("row_key").agg((F.count(F.lit(1)) > 1).alias("several"))
        return kept.join(several, "row_key")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A null text, or one without words, has no shingles and stands alone. Equal
    texts, repeated rows included, have the same set and the same component. A
    null doc_id takes part and is never the smallest of a component that has
    another. Only doc_id and text are looked at. An empty table gives no rows.
    """
    return SetJoin(docs).documents().select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, or any where all ids are null.

    A text without shingles stands alone. A row that is repeated (same doc_id and text) is given once.
    """
    kept = stored(SetJoin(docs).kept_rows(), "kept")
    # Columns travel under numbered names, so that none clashes with the key.
    names = [f"_c{i}" for i in range(len(docs.columns))]
    key = row_key(F.col(names[docs.columns.index("doc_id")]).cast("long"), F.col(names[docs.columns.index("text")]))
    found = docs.toDF(*names).withColumn("row_key", key).join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, "row_key")
    # Only repeated rows are shuffled.
    rows = found.where("not several")
    if not kept.where("several").isEmpty():
        rows = rows.unionByName(found.where("several").dropDuplicates(["row_key"]))
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
