"""Language identification of mixed text: script ranges, word scores, Viterbi over words.

Words are runs of letters. Counts of the byte n-grams of words by language come
from all labelled training texts; a word's score for a language is the sum of
the log shares of its n-grams. The script of a word's first letter narrows its
candidates to the languages that the training texts write in that script. Over
the words of a text, Viterbi finds the sequence of languages with the highest
score, less a penalty for every switch, which labels spans of mixed text.

Most texts need no search: if no stretch of words gains more than the penalty
by another language, the best path is the best single language, which running
minima of the score differences decide for all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmat.llm.common import LOWER, byte_prefix, chunks, owner_of, process_cache, received, remainder, shipped, stretch_hash

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
#: Log-likelihood that a switch of language costs.
SWITCH = 14.0
#: Share of a language's words from which a script counts as its own.
SCRIPT_SHARE = 0.002
#: Weight of a word's n-gram sum; n-grams of a word overlap, their logs overcount.
WEIGHT = 0.35
FLOOR = 0.5
_SMALL = 1 << 20

#: First code point of each range and its script. Fixed values of the Unicode blocks.
SCRIPTS = [(0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xB80, "Tamil"), (0xE00, "Thai"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Common"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Common"), (0xF900, "Han"), (0xFB00, "Common"), (0x20000, "Han")]
_FIRST = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({s for _, s in SCRIPTS})
_NUMBER = np.array([_NAMES.index(s) for _, s in SCRIPTS])

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:] = True


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Small letters for ASCII and Latin-1."""
    low = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    low[lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] + 1] += 0x20
    return low


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    cache = process_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def points_of(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Code point of the character at each start."""
    a = data[start].astype(np.int64)
    point = a.copy()
    take = lambda k: data[np.minimum(start + k, len(data) - 1)].astype(np.int64) & 0x3F
    two, three, four = (a >= 0xC0) & (a < 0xE0), (a >= 0xE0) & (a < 0xF0), a >= 0xF0
    point[two] = ((a & 0x1F) << 6 | take(1))[two]
    point[three] = ((a & 0x0F) << 12 | take(1) << 6 | take(2))[three]
    point[four] = ((a & 0x07) << 18 | take(1) << 12 | take(2) << 6 | take(3))[four]
    return point


def letter_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters; what is a letter is looked up by code point beyond ASCII."""
    inside = _LETTER[data]
    wide = np.flatnonzero(data >= 0xC2)
    if len(wide):
        none = wide[~letter_table()[np.minimum(points_of(data, wide), 0x10FFFF)]]
        size = 2 + (data[none] >= 0xE0) + (data[none] >= 0xF0)
        for k in range(4):
            inside[none[size > k] + k] = False
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.append(True, ~inside[:-1]), np.append(~inside[1:], True)
    cuts = edges[(edges > 0) & (edges < n)]
    first[cuts] = True
    last[cuts - 1] = True
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def scripts_of(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Script number of the character at each start."""
    return _NUMBER[np.searchsorted(_FIRST, points_of(data, start), side="right") - 1]


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the n-grams of each word, its edges included, and of the whole word."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 2)])
    text = np.full(at[-1], 32, np.uint8)
    spread = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(at[:-1] + 1, size) + spread] = data[np.repeat(start, size) + spread]
    prefix = byte_prefix(text)
    word = np.repeat(np.arange(len(start)), size + 2)
    owners, hashes = [np.arange(len(start))], [stretch_hash(prefix, at[:-1], at[1:])]
    for n in GRAMS:
        if len(text) >= n:
            lo = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :])
            owners.append(word[lo])
            hashes.append(stretch_hash(prefix, lo, lo + n))
    return np.concatenate(owners), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)


def _distinct_words(data: np.ndarray, edges: np.ndarray):
    """Words of the texts through their distinct forms: (starts, ends, text, form of each word, a start and end of each form, small letters)."""
    start, end = letter_words(data, edges)
    low = lower_bytes(data)
    text = owner_of(start, edges)
    _, where, form = np.unique(stretch_hash(byte_prefix(low), start, end), return_index=True, return_inverse=True)
    return start, end, text, form, start[where], end[where], low


# ---------------------------------------------------------------- training


def _count(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        scripts = np.zeros((len(languages), len(_NAMES)), np.int64)
        for part, data, edges in chunks(batches, "text", _SMALL):
            lang = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
            _, _, text, form, a, b, low = _distinct_words(data, edges)
            if not len(form):
                continue
            script = scripts_of(low, a)
            owner, bucket = _grams(low, a, b)
            for k in np.unique(lang):
                times = np.bincount(form[lang[text] == k], minlength=len(a))
                total[k] += np.bincount(bucket, weights=times[owner], minlength=BUCKETS).astype(np.int64)
                scripts[k] += np.bincount(script, weights=times, minlength=len(_NAMES)).astype(np.int64)
        for k in range(len(languages)):
            both = np.concatenate([total[k], scripts[k]])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(both[at])], names=["lang", "cell", "n"])

    return run


class Model:
    """Log shares by bucket and language, and which languages are written in which script."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages = languages
        grams, scripts = table[:, :BUCKETS].astype(np.float64), table[:, BUCKETS:].astype(np.float64)
        self.log = np.log((grams + FLOOR) / (grams.sum(axis=1, keepdims=True) + FLOOR * BUCKETS)).T.astype(np.float32) if len(languages) else np.zeros((BUCKETS, 0), np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.writes = (share >= SCRIPT_SHARE).T.copy()
        self.writes[~self.writes.any(axis=1)] = True  # a script that no language is known to use narrows nothing


def train(docs: DataFrame, most_languages: int = 1000) -> Model:
    """Counts over all texts with a language. The counts are ``BUCKETS`` numbers a language; more languages than ``most_languages`` are refused."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    languages = sorted(r[0] for r in known.select("lang").distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages in the training texts")
    if not languages:
        return Model([], np.zeros((0, BUCKETS + len(_NAMES))))
    rows = known.mapInArrow(_count(languages), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), BUCKETS + len(_NAMES)))
    table[rows["lang"], rows["cell"]] = rows["n"]
    return Model(languages, table)


# ---------------------------------------------------------------- labelling


def best_path(scores: np.ndarray, edges: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word (rows of ``scores``) within its text, by Viterbi with a penalty for each change; ties go to the first language."""
    words, kinds = scores.shape
    out = np.zeros(words, np.int64)
    if not words or kinds == 1:
        return out
    texts = len(edges) - 1
    run = np.zeros((words + 1, kinds))
    np.cumsum(scores, axis=0, out=run[1:])
    totals = run[edges[1:]] - run[edges[:-1]]
    top = totals.argmax(axis=1)
    owner = np.repeat(np.arange(texts), np.diff(edges))
    # The most that any stretch gains by another language: rise of the running difference above its least value so far.
    gain = run[1:] - run[1:][np.arange(words), top[owner]][:, None]
    base = run[edges[:-1]] - run[edges[:-1]][np.arange(texts), top][:, None]
    hard = np.zeros(texts, bool)
    size = np.diff(edges)
    for k in range(kinds):
        # A drop by text keeps the running minimum of one text from reaching into the next.
        drop = owner * (np.abs(gain[:, k]).max(initial=0) * 4 + 1)
        shifted = gain[:, k] - drop
        start = base[:, k] - np.arange(texts) * (np.abs(gain[:, k]).max(initial=0) * 4 + 1)
        least = np.minimum.accumulate(np.minimum(shifted, start[owner]))
        before = np.minimum(np.append(np.inf, least[:-1]), start[owner])
        rise = gain[:, k] - (before + drop)
        hard[owner[rise > switch]] = True
    out[:] = top[owner]
    tricky = np.flatnonzero(hard & (size > 0))
    if len(tricky):
        _search(scores, edges, tricky[np.argsort(-size[tricky], kind="stable")], switch, out)
    return out


def _search(scores: np.ndarray, edges: np.ndarray, texts: np.ndarray, switch: float, out: np.ndarray) -> None:
    """Viterbi for the given texts (longest first), all at once word by word."""
    size = np.diff(edges)[texts]
    first = edges[:-1][texts]
    kinds = scores.shape[1]
    value = np.zeros((len(texts), kinds))
    came = np.zeros((size.sum(), kinds), np.int16)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    for t in range(size[0]):
        live = int(np.searchsorted(-size, -t, side="left"))
        v = value[:live]
        if t:
            best = v.argmax(axis=1)
            other = v[np.arange(live), best] - switch
            change = other[:, None] > v
            came[at[:live] + t] = np.where(change, best[:, None], np.arange(kinds))
            v = np.maximum(v, other[:, None])
        value[:live] = v + scores[first[:live] + t]
    state = value.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        out[first[:live] + t] = state[:live]
        if t:
            state[:live] = came[at[:live] + t, state[:live]]


def word_scores(model: Model, data: np.ndarray, edges: np.ndarray):
    """Scores of every word for every language (minus infinity would forbid one; a large loss narrows), and the words."""
    start, end, text, form, a, b, low = _distinct_words(data, edges)
    kinds = len(model.languages)
    own = np.zeros((len(a), kinds))
    if len(a) and kinds:
        owner, bucket = _grams(low, a, b)
        for k in range(kinds):
            own[:, k] = np.bincount(owner, weights=model.log[bucket, k], minlength=len(a)) * WEIGHT
        own -= own.max(axis=1, keepdims=True)
        own = np.where(model.writes[scripts_of(low, a)], own, np.minimum(own, -3 * SWITCH))
    return start, end, text, own[form]


def _label(model: Broadcast, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(model)
        names = np.array([*m.languages, "und"], dtype=object)
        for part, data, edges in chunks(batches, "text", _SMALL):
            texts = part.num_rows
            start, end, text, scores = word_scores(m, data, edges)
            at = np.searchsorted(text, np.arange(texts + 1))
            kinds = len(m.languages)
            if not kinds:
                path = np.zeros(len(text), np.int64)
                best, score = np.full(texts, kinds), np.zeros(texts)
            else:
                path = best_path(scores, at, SWITCH)
                weight = np.zeros((texts, kinds))
                np.add.at(weight, (text, path), end - start)
                best = np.where(np.diff(at) > 0, weight.argmax(axis=1), kinds)
                score = np.divide(weight.max(axis=1), weight.sum(axis=1), out=np.zeros(texts), where=weight.sum(axis=1) > 0)
            columns = [part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            if spans:
                columns.append(pa.array([_spans(names, path[a:b], start[a:b] - edges[i], end[a:b] - edges[i]) for i, (a, b) in enumerate(zip(at[:-1], at[1:]))], _SPANS))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    return run


_SPANS = pa.list_(pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64()), ("lang", pa.string())]))


def _spans(names: np.ndarray, path: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[dict]:
    if not len(path):
        return []
    first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
    last = np.append(first[1:], len(path)) - 1
    return [{"from_byte": int(start[a]), "to_byte": int(end[b]), "lang": names[path[a]]} for a, b in zip(first, last)]


def label(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred (language of most letters), score (its share of the letters' bytes) and, if asked for, the labelled spans.

    A null text, or one without letters, is ``und`` with score 0, and so is
    every text if nothing was learned. Only doc_id and text are looked at.
    """
    value = shipped(docs.sparkSession, model)
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return plain.mapInArrow(_label(value, spans), "doc_id long, lang_pred string, score double" + (", spans array<struct<from_byte: bigint, to_byte: bigint, lang: string>>" if spans else ""))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the documents whose crc32(doc_id) modulo 5 is not 0."""
    model = train(docs.where(remainder("doc_id", 5) != 0))
    return label(docs, model, spans=False).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
