"""Runs of words against definitions tried one by one."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gridmat.llm import lyndon, word_runs
from pyspark.sql import functions as F


def _next_smaller(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] >= s[i:]:
            j += 1
        out.append(j - i)
    return out


def _plain_runs(w, least, exponent):
    """Every widest stretch of every period, kept if no smaller period fits it."""
    out = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            e = i + p
            fits = lambda q: all(w[k] == w[k + q] for k in range(s, e - q))  # noqa: B023, E731
            if e - s >= max(least, exponent * p) and not any(fits(q) for q in range(1, p)):
                out.add((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _strings(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        n, k = rng.randint(0, 60), rng.randint(1, 4)
        s = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 4:
                a, p = rng.randrange(n - 1), rng.randint(1, 8)
                for i in range(a + p, min(n, a + p * rng.randint(2, 9))):
                    s[i] = s[i - p]
        yield s


def test_lyndon_array_is_the_next_smaller_suffix():
    for s in _strings(600, 3):
        assert lyndon.lyndon_array(s) == _next_smaller(s)


@pytest.mark.parametrize("least, exponent", [(2, 2), (8, 3), (24, 3)])
def test_runs_match_all_periods(least, exponent):
    for s in _strings(500, 5):
        assert lyndon.runs(np.array(s, np.int64), least, exponent) == _plain_runs(s, least, exponent)


def test_runs_do_not_trust_hashes(monkeypatch):
    true = lyndon.common_extensions

    def optimistic(symbols, i, j):
        return np.minimum(true(symbols, i, j) + 3, len(symbols) - j)

    monkeypatch.setattr(lyndon, "common_extensions", optimistic)
    for s in _strings(300, 9):
        got = lyndon.runs(np.array(s, np.int64), 6, 2)
        assert set(got) <= set(_plain_runs(s, 6, 2)) | {r for r in got if r in _plain_runs(s, 2, 2)}
        assert set(got) >= set(_plain_runs(s, 6, 2))


def test_narrowing_loses_no_run():
    rng = random.Random(8)
    for _ in range(200):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randrange(4)):
            if len(words) > 30:
                a, p = rng.randrange(len(words) - 20), rng.randint(1, 30)
                for i in range(a + p, min(len(words), a + p + rng.randint(10, 90))):
                    words[i] = words[i - p]
        assert word_runs.word_runs(words) == _plain_runs(words, 24, 3)


def _plain_answer(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = _plain_runs(words, 24, 3)
    best = sorted(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in found)]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(found), *top, digest("".join(f"{s},{m},{p}\n" for s, m, p in found)), digest(" ".join(kept)))


def test_digests_match_definitions(spark, edge_docs):
    few = edge_docs.where(F.length("text") < 2500).unionByName(edge_docs.where("text is null"))
    ids = {i for i in range(100_000, 101_000) if zlib.crc32(str(i).encode()) % 10 == 0}
    planted = few.where("doc_id < 100").withColumn("doc_id", F.element_at(F.array(*[F.lit(i) for i in sorted(ids)]), (F.col("doc_id") % len(ids) + 1).cast("int")))
    rows = few.unionByName(planted).unionByName(few.where("doc_id = 9008"))
    got = word_runs.run_digests(rows).collect()
    want = [_plain_answer(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r.n_runs > 0 for r in got) > 20


def test_texts_and_spans(spark):
    rows = [(1, "a b c " + "x y z " * 10 + "end"), (2, None), (3, " \n"), (4, "no repetition here"), (None, "ha " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("start", F.lit(5))
    out = {r.doc_id: r for r in word_runs.find_runs(docs).collect()}
    assert word_runs.find_runs(docs).columns == ["doc_id", "text", "start", "runs", "collapsed"]
    assert [tuple(x) for x in out[1].runs] == [(3, 30, 3)] and out[1].collapsed == "a b c x y z end"
    assert (out[2].runs, out[2].collapsed) == ([], None) and (out[3].runs, out[3].collapsed) == ([], "")
    assert out[4].collapsed == "no repetition here" and out[None].collapsed == "ha"


def test_empty_table_and_long_text(spark, no_docs):
    assert word_runs.run_digests(no_docs).count() == 0 == word_runs.find_runs(no_docs).count()
    block = " ".join(f"w{i}" for i in range(50_000))
    docs = spark.createDataFrame([(1, f"{block} {block} {block} end")], "doc_id long, text string")
    row = word_runs.run_digests(docs).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 150_000, 50_000, 3000)
    assert row.collapsed_sha256 == hashlib.sha256(f"{block} end".encode()).hexdigest()
