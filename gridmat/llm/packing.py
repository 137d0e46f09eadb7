"""Packing by lexical retrieval: windows of tokens filled with a seed document and its BM25 neighbours.

The corpus is cut into shards, runs of an input split of at most
``SHARD_BYTES`` of text, so no row is shuffled and memory is bounded. A shard's
inverted index holds the BM25 weight of every term in its documents; a seed is
the shard's next unused document, its query the terms that weigh most in it.
The unused neighbours fill the seed's window best first, whole where they fit;
what is left is filled by cutting the best of the others, whose rest begins
the next window. So only the last window of an input split is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridmat.llm.bpe import word_bpe
from gridmat.llm.common import chunks

WINDOW = 4096
END_ID = 2
SHARD_BYTES = 4 << 20
QUERY_TERMS = 24
NEIGHBOURS = 64
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, terms: np.ndarray, doc: np.ndarray, docs: int):
        term, number = np.unique(terms, return_inverse=True)
        pair, count = np.unique(doc * len(term) + number, return_counts=True)
        self.doc, number = pair // max(len(term), 1), pair % max(len(term), 1)
        size = np.bincount(doc, minlength=docs).astype(np.float64)
        df = np.bincount(number, minlength=len(term))
        idf = np.log1p((docs - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(size.mean(), 1.0)) if docs else size
        weight = idf[number] * count * (K1 + 1) / (count + norm[self.doc])
        shared = df[number] > 1  # a term of one document finds no other
        self.doc, number, weight = self.doc[shared], number[shared], weight[shared]
        # What a document asks with: its terms, heaviest first.
        order = np.lexsort((number, -weight, self.doc))
        self.asked, self.asked_at = number[order], np.searchsorted(self.doc[order], np.arange(docs + 1))
        order = np.lexsort((self.doc, number))
        self.posting, self.weight = self.doc[order], weight[order]
        self.posting_at = np.searchsorted(number[order], np.arange(len(term) + 1))
        self.score = np.zeros(docs)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first; ties in input order."""
        terms = self.asked[self.asked_at[seed] : self.asked_at[seed + 1]][:QUERY_TERMS]
        if not len(terms):
            return terms
        spans = [slice(self.posting_at[t], self.posting_at[t + 1]) for t in terms]
        docs = np.concatenate([self.posting[s] for s in spans])
        np.add.at(self.score, docs, np.concatenate([self.weight[s] for s in spans]))
        found = np.unique(docs)
        score = self.score[found]
        self.score[found] = 0.0
        free = unused[found]
        found, score = found[free], score[free]
        return found[np.lexsort((found, -score))][:NEIGHBOURS]


class Packer:
    """Fills windows one after the other; the open window goes on from shard to shard of a split."""

    def __init__(self, window: int, first: int):
        self.window, self.space, self.sequence = window, window, first
        self.rows: list[tuple[int, int, int, int, int]] = []  # document, start, length, sequence, offset

    def place(self, doc: int, start: int, length: int) -> int:
        """Put up to ``length`` ids into the open window; how many went in."""
        taken = min(length, self.space)
        self.rows.append((doc, start, taken, self.sequence, self.window - self.space))
        self.space -= taken
        if not self.space:
            self.space, self.sequence = self.window, self.sequence + 1
        return taken

    def shard(self, sizes: np.ndarray, index: Index) -> None:
        unused = np.ones(len(sizes), bool)
        following = 0
        rest: tuple[int, int] | None = None  # document and ids of it that are placed
        while True:
            if rest is None:
                while following < len(sizes) and not unused[following]:
                    following += 1
                if following == len(sizes):
                    return
                seed, done = following, 0
                unused[seed] = False
            else:
                seed, done = rest
            rest = None
            while done < sizes[seed]:
                done += self.place(seed, done, sizes[seed] - done)
            if self.space == self.window:
                continue
            opened, cut = self.sequence, None
            for doc in index.neighbours(seed, unused):
                if sizes[doc] <= self.space:
                    unused[doc] = False
                    self.place(doc, 0, sizes[doc])
                    if self.sequence != opened:
                        break
                elif cut is None:
                    cut = doc
            if self.sequence == opened and cut is not None:
                unused[cut] = False
                rest = (cut, self.place(cut, 0, sizes[cut]))


def _pack(tokenizer: str, window: int, shard_bytes: int):
    def flush(packer: Packer, ids: list, parts: list) -> pa.RecordBatch | None:
        if not parts:
            return None
        flat = np.concatenate([i for i, _, _, _ in parts])
        counts = np.concatenate([c for _, c, _, _ in parts])
        terms, units = np.concatenate([t for _, _, t, _ in parts]), np.concatenate([u for _, _, _, u in parts])
        packer.rows = []
        packer.shard(counts + 1, Index(terms, np.repeat(np.arange(len(units)), units), len(units)))
        at = np.concatenate([[0], np.cumsum(counts)])
        rows = np.array(packer.rows, np.int64).reshape(-1, 5)
        crcs = []
        for doc, start, length in rows[:, :3]:
            piece = flat[at[doc] + start : min(at[doc] + start + length, at[doc + 1])].astype("<u4")
            if start + length > counts[doc]:
                piece = np.append(piece, np.uint32(END_ID)).astype("<u4")
            crcs.append(zlib.crc32(piece.tobytes()))
        named = pa.concat_arrays(ids).take(pa.array(rows[:, 0]))
        out = [named, rows[:, 1], rows[:, 2], np.array(crcs, np.int64), (counts + 1)[rows[:, 0]], rows[:, 3], rows[:, 4]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out], names=[c.split()[0] for c in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        ids, parts, held = [], [], 0
        for part, data, edges in chunks(batches, "text"):
            parts.append(bpe.batch(data, edges))
            ids.append(part.column("doc_id"))
            held += len(data)
            if held >= shard_bytes:
                yield flush(packer, ids, parts)
                ids, parts, held = [], [], 0
        if parts:
            yield flush(packer, ids, parts)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, its end id included, lies in exactly one piece,
    and the pieces of a sequence follow each other without gaps from offset 0.
    A null or empty text is its end id alone. A repeated row is a document of
    its own; a null doc_id is carried as null. An empty table gives no rows.
    """
    typed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return typed.mapInArrow(_pack(tokenizer or default_tokenizer(), window, shard_bytes), PIECES)
