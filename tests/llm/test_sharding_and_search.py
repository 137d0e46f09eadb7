"""Shards and nearest vectors against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmat.llm import sharding, va_search


def reached(key, tree):
    """Leaf by descending region, rack and shard."""
    def draw(leaf, weight):
        bits = int(hashlib.md5(f"{leaf}/{key}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52) / weight

    racks = {r: {k: {s: draw(s, w) for s, w in leaves.items()} for k, leaves in kinds.items()} for r, kinds in tree.items()}
    region = min(racks, key=lambda r: min(min(leaves.values()) for leaves in racks[r].values()))
    rack = min(racks[region], key=lambda k: min(racks[region][k].values()))
    return min(racks[region][rack], key=racks[region][rack].get)


def test_shards(edge_docs, no_docs):
    grown = (1, 2, 24, 1.0)
    rows = sharding.shard_documents(edge_docs, pieces=4).collect()
    larger = sharding.with_leaf(sharding.DEFAULT_TREE, *grown)
    texts = Counter((r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect())
    want = Counter()
    for (doc, text), n in texts.items():
        raw = (text or "").encode()
        key = "\x00" if doc is None else str(doc)
        want[(doc, len(raw) + 8, zlib.crc32(raw), "key", reached(key, sharding.DEFAULT_TREE), reached(key, larger))] += n
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    assert sharding.shard_documents(no_docs).count() == 0


def test_weights_set_the_shares_and_confine_movement(spark):
    keys = spark.range(20000).select(F.col("id").alias("doc_id"))
    tree = {0: {0: {0: 1.0, 1: 3.0}}, 1: {0: {2: 2.0}, 1: {3: 2.0}}}
    heavier = {0: {0: {0: 1.0, 1: 3.0}}, 1: {0: {2: 4.0}, 1: {3: 2.0}}}
    both = sharding.assign(sharding.assign(keys, F.col("doc_id"), tree), F.col("doc_id"), heavier, shard="after").toPandas()
    share = both.groupby("shard").size() / len(both)
    assert np.allclose(share.to_numpy(), [1 / 8, 3 / 8, 2 / 8, 2 / 8], atol=0.015)
    moved = both[both["shard"] != both["after"]]
    assert len(moved) and set(moved["after"]) == {2}


@pytest.mark.parametrize("bits,block", [(1, 7), (6, 2048)])
def test_top_k_is_exact(spark, bits, block):
    rng = np.random.default_rng(6)
    vectors = rng.normal(0, 0.2, (400, 8)).astype(np.float32)
    vectors[50] = vectors[51] = vectors[200]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (1000, [0.1] * 7 + [float("nan")], 1), (1100, [None] + [0.1] * 7, 1), (1200, [float("inf")] * 8, 1), (None, [0.1] * 8, 1), (1300, [0.5] * 3, 1), (200, vectors[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(5)
    got = va_search.top_k(df, df.where("vec_id % 100 = 0"), 10, bits=bits, block_rows=block, query_block=2)
    whole = [(i, np.floor(1024 * v.astype(np.float64)).astype(int)) for i, v in enumerate(vectors)] + [(200, np.floor(1024 * vectors[7].astype(np.float64)).astype(int))]
    want = Counter()
    for q, x in whole:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in whole if i != q)[:10]
            want.update((q, rank + 1, i, -s) for rank, (s, i) in enumerate(best))
    assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want
    assert va_search.top_k(df.limit(0), df.limit(0)).count() == 0
    assert va_search.top_k(df.where("vec_id = 100"), df.where("vec_id = 100")).count() == 0


def test_scores_beyond_a_double_are_exact():
    q, x = np.array([2**31 + 1, 3]), np.array([[2**31 + 5, 7], [-(2**31), 1]])
    assert va_search._scores(q, x).tolist() == [(2**31 + 1) * (2**31 + 5) + 21, -(2**31 + 1) * 2**31 + 3]


def test_bounds_hold():
    rng = np.random.default_rng(9)
    exact = rng.integers(-500, 500, (100, 6))
    cells, low, width = va_search.quantise(exact, 3)
    floor = low + cells.astype(np.int64) * width
    assert (floor <= exact).all() and (exact <= floor + width - 1).all() and cells.max() < 8
