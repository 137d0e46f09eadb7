"""Rows kept by the Jaccard stage against brute force, on repeated rows and null ids."""

from collections import Counter

import numpy as np

from gridmat.llm import jaccard_join, suffix_dedup

SCHEMA = "doc_id long, text string, source string"


def _window(lo, hi, name="w"):
    return " ".join(f"{name}{i}" for i in range(lo, hi))


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").split()
        out.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    return out


def _groups(rows):
    sets, root = _sets([r[1] for r in rows]), list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if sets[i] and sets[j] and 20 * len(sets[i] & sets[j]) >= 17 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return sets, root


ROWS = [
    (1, _window(0, 60), "a"), (None, _window(4, 64), "a"), (2, _window(8, 68), "a"),  # 1 and 2 are linked by a text without id only
    (None, _window(0, 50, "alone"), "b"),
    (5, _window(0, 50, "twice"), "c"), (5, _window(0, 50, "twice"), "c"),
    (None, _window(0, 50, "nulls"), "d"), (None, _window(0, 50, "nulls"), "d"), (None, _window(1, 51, "nulls"), "d"),
    (6, "", "e"), (7, None, "e"), (7, None, "e"), (None, "", "e"),
    (8, _window(0, 50, "eight"), "f"), (8, _window(0, 50, "other"), "f"), (9, _window(0, 50, "eight"), "f"),
]


def test_sets_without_an_id_link(spark):
    got = Counter(tuple(r) for r in jaccard_join.classes(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect())
    sets, root = _groups(ROWS)
    least = lambda i: min((r[0] for r, x in zip(ROWS, root) if x == root[i] and r[0] is not None), default=None)
    assert got == Counter((r[0], len(s), least(i) if s else r[0]) for i, (r, s) in enumerate(zip(ROWS, sets)))


def test_one_row_of_each_component(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    sets, root = _groups(ROWS)
    for limit in (jaccard_join.BROADCAST_ROWS, 0):
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", limit)
        kept = [tuple(r) for r in jaccard_join.one_of_each(docs).collect()]
        assert len(set(kept)) == len(kept) and set(kept) <= set(ROWS)
        for i in {r for r, s in zip(root, sets) if s}:
            mine = [r for r, x in zip(ROWS, root) if x == i]
            here = [r for r in kept if r in mine]
            assert len(here) == 1
            assert here[0][0] == min((r[0] for r in mine if r[0] is not None), default=None)
        assert {r for r in kept if not (r[1] or "").split()} == {r for r in ROWS if not (r[1] or "").split()}


def test_a_clean_document_delivered_twice_stays(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(60)) for _ in range(6)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], SCHEMA)
    kept = suffix_dedup.without_repeats(jaccard_join.one_of_each(docs))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(enumerate(texts))
