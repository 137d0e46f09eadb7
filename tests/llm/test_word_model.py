"""The word model against dictionaries, and what it must tell apart."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from gridmat.llm import hash_arrays, kneser_ney, quality_rules, word_model
from gridmat.llm.common import text_buffers


def _split(texts):
    data, edges = text_buffers(pa.array(texts))
    text, grams, fold = word_model.word_grams(data, edges, 3)
    return text, [tuple(int(x) for x in g) for g in grams.view(np.int64).T], fold


def test_shares_match_a_plain_model(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefgh"), 12)) for _ in range(40)]
    text, grams, fold = _split(texts)
    assert 0 < fold.sum() < len(texts)
    got = {tuple(r)[:3]: (r.p0, r.p1) for r in word_model.fit(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert set(got) == set(grams)
    words = len({g[-1] for g in grams})
    for m in (0, 1):
        level = Counter(g for t, g in zip(text, grams) if fold[t] == bool(m))
        levels = {3: level, 2: (two := Counter(g[1:] for g in level)), 1: Counter(g[1:] for g in two)}

        def prob(gram):
            if not gram:
                return 1 / (words + 1)
            d = kneser_ney.discounts([float(sum(v == k for v in levels[len(gram)].values())) for k in (1, 2, 3, 4)])
            same = [v for g, v in levels[len(gram)].items() if g[:-1] == gram[:-1]]
            if not same:
                return prob(gram[1:])
            own = levels[len(gram)].get(gram, 0)
            return ((own - d[min(own, 3) - 1] if own else 0) + sum(d[min(v, 3) - 1] for v in same) * prob(gram[1:])) / sum(same)

        for gram in set(grams):
            assert got[gram][m] == pytest.approx(prob(gram), rel=1e-9)


def test_units_of_scripts_without_spaces():
    data, edges = text_buffers(pa.array(["ab日本 語c", "ไท x", "день", ""]))
    start, end = word_model.units(data, edges)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["ab", "日", "本", "語", "c", "ไ", "ท", "x", "день"]


def test_shuffled_words_and_gibberish_of_other_scripts_fail(spark):
    rng = np.random.default_rng(7)
    rows, kind = [], {}
    for lang, letters in (("en", "abcdefghijklmnopqrstuvwxyz"), ("ru", "абвгдежзиклмнопрстуфхцчшщы"), ("ar", "ابتثجحخدذرزسشصضطظعغفقكلمن")):
        word = lambda: "".join(rng.choice(list(letters), rng.integers(3, 9)))  # noqa: B023, E731
        vocabulary = [word() for _ in range(400)]
        follows = rng.integers(0, 400, (400, 4))

        def clean():
            at, out = int(rng.integers(400)), []
            for _ in range(int(rng.integers(120, 200))):
                out.append(vocabulary[at])
                at = int(follows[at, rng.integers(4)])
            return out

        for k, n in (("clean", 250), ("shuffled", 12), ("gibberish", 12)):
            for _ in range(n):
                words = clean()
                words = words if k == "clean" else list(rng.permutation(words)) if k == "shuffled" else [word() for _ in words]
                kind[len(rows)] = k, lang
                rows.append((len(rows), " ".join(words), lang))
    kept = {r.doc_id: r.kept for r in quality_rules.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for lang in ("en", "ru", "ar"):
        share = {k: np.mean([kept[i] for i, v in kind.items() if v == (k, lang)]) for k in ("clean", "shuffled", "gibberish")}
        assert share["clean"] > 0.95 and share["shuffled"] == share["gibberish"] == 0, (lang, share)
    assert not math.isnan(sum(kept.values()))


@pytest.mark.parametrize("order", [2, 3])
def test_hash_arrays_match_a_plain_model(spark, order, monkeypatch):
    """Mean logs by blocks and ranges against dictionaries; several blocks, repeated, empty and null texts."""
    monkeypatch.setattr(hash_arrays, "BLOCK_WORDS", 100)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 30))) for _ in range(60)]
    texts += [*texts[:3], "", None, " \n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.log_perplexity for r in quality_rules.features(rows, ["doc_id"], order).collect()}
    text, grams, fold = _split(texts)
    grams = [g[3 - order :] for g in grams]
    words = len({g[-1] for g in grams})
    logs = {}
    for m in (0, 1):
        levels = {order: Counter(g for t, g in zip(text, grams) if fold[t] == bool(m))}
        for n in range(order - 1, 0, -1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])
        taken = {n: kneser_ney.discounts([float(sum(v == k for v in level.values())) for k in (1, 2, 3, 4)]) for n, level in levels.items()}

        def prob(gram):
            if not gram:
                return 1 / (words + 1)
            level, d = levels[len(gram)], taken[len(gram)]
            same = [v for g, v in level.items() if g[:-1] == gram[:-1]]
            if not same:
                return prob(gram[1:])
            own = level.get(gram, 0)
            return ((own - d[min(own, 3) - 1] if own else 0) + sum(d[min(v, 3) - 1] for v in same) * prob(gram[1:])) / sum(same)

        for t, g in zip(text, grams):
            if fold[t] != bool(m):
                logs.setdefault(int(t), []).append(math.log(prob(g)))
    assert {i: x for i, x in got.items() if x is not None} == pytest.approx({i: -np.mean(x) for i, x in logs.items()}, rel=1e-9)
    assert [got[i] for i in range(63, 66)] == [None] * 3 and len(got) == len(texts)


def test_a_block_meets_only_its_own_answers(spark):
    rows = spark.createDataFrame([("a b c d",), ("b c d e f",)], "text string").coalesce(1)
    levels = hash_arrays.fit(rows)
    with pytest.raises(Exception, match="another order"):
        rows.where("text like 'b%'").mapInArrow(quality_rules._features([], ["text"], levels), quality_rules.FEATURES).collect()


def test_order_of_keys_is_stable():
    """Keys too wide to stand beside their places, some of them different in low bits alone, and equal ones."""
    rng = np.random.default_rng(6)
    for keys in (rng.integers(0, 1 << 63, 1000), rng.integers(0, 40, 1000), (1 << 62) + rng.integers(0, 64, 1000) - (1 << 62) * rng.integers(0, 2, 1000), np.zeros(1), np.zeros(0)):
        keys = keys.astype(np.uint64)
        assert np.array_equal(hash_arrays.ordered(keys), np.argsort(keys, kind="stable"))


def test_columns_of_small_and_large_numbers():
    stats = np.random.default_rng(7).integers(0, 3, (10, 500))
    stats[3, ::7], stats[9, ::5], stats[0, ::11] = 1 << 40, 64, 63
    different, number = hash_arrays.columns(stats)
    assert np.array_equal(different[:, number], stats) and len(np.unique(different, axis=1).T) == different.shape[1]


def test_what_was_asked_is_freed_before_answers_are_dealt_out(spark, monkeypatch):
    """A level between takes turns with parts of the ranges; no answers are left behind but those of the blocks."""
    asked, added = [], hash_arrays._asked
    monkeypatch.setattr(hash_arrays, "_asked", lambda n, order, bits, above, ranges, turn: asked.append((n, turn)) or added(n, order, bits, above, ranges, turn))
    rows = spark.createDataFrame([("a b c d",), ("b c d e f",)], "text string").coalesce(1)
    levels = hash_arrays.fit(rows)
    assert [n for n, _ in asked] == [3, *[2] * hash_arrays.TURNS, 1]
    assert sorted(p for n, turn in asked if n == 2 for p in turn) == list(asked[0][1])
    # Each n-gram is counted once, in whichever turn, with those that reach before a text.
    assert [level.grams for level in levels] == [6, 7, 8]
    scratch = Path(levels[0].path.removeprefix("file:")).parent
    assert Path(levels[1].path.removeprefix("file:")).is_dir() and not list(scratch.glob("*-answers-*"))


@pytest.mark.parametrize("text", ["日本a語 ab日 한국 thaiไท x", "€ a… b", "語", "a"])
def test_units_in_scripts_without_spaces(text):
    data = np.frombuffer(text.encode(), np.uint8)
    start, end = word_model.units(data, np.array([0, len(data)]))
    alone = lambda c: "぀" <= c <= "鿿" or "฀" <= c <= "໿"
    expected = [w for run in text.split() for w in "".join(f" {c} " if alone(c) else c for c in run).split()]
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == expected
