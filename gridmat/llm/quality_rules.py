"""Quality rules: word and line counts, and perplexity within the band of a document's language."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmat.llm import hash_arrays
from gridmat.llm.common import SMALL_BATCHES, byte_prefix, owner_of, set_for, stored, stretch_hash, word_edges

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Perplexity bands: this many scaled deviations below and above the median log perplexity of a language,
#: widened for short texts by sqrt(1 + SHORT / characters in words).
BELOW, ABOVE, SHORT = 5.0, 5.0, 800.0
LEAST_SPREAD = 0.01
#: A language with fewer texts than this has no band of its own and takes the one of all texts.
LEAST_TEXTS = 50
#: So many languages have a band of their own, the most frequent first; the rest share the one of all texts.
MOST_BANDS = 2_000
#: Kept texts up to this many are sent to every task; above, they are joined.
BROADCAST_ROWS = 1_000_000

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flags), edges))


def _repeats(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """True where the pair (text, key) occurs more than once."""
    # Only keys that occur twice anywhere are told apart by their texts.
    ranked = np.sort(key)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    out = np.zeros(len(key), bool)
    if not len(twice):
        return out
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
    order = at[np.lexsort((key[at], text[at]))]
    same = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _first_of(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """True at one member of every set of equal pairs (text, key)."""
    order = np.lexsort((key, text))
    k, t = key[order], text[order]
    out = np.zeros(len(key), bool)
    out[order] = np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]))[: len(key)]
    return out


def base_counts(data: np.ndarray, edges: np.ndarray, prefix: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The five counts of each text, from its bytes (and their ``byte_prefix``, where it is known)."""
    texts = len(edges) - 1
    starts, ends = word_edges(data, edges)
    text_of = owner_of(starts, edges) if len(starts) else np.zeros(0, np.int64)
    n_words = np.bincount(text_of, minlength=texts)
    prefix = byte_prefix(data) if prefix is None else prefix
    # Bytes that go on with a character lie in words.
    n_bytes = np.diff(np.append(0, np.cumsum(ends - starts))[np.append(0, np.cumsum(n_words))])
    out = {"n_words": n_words, "word_chars": n_bytes - _per_text((data & 0xC0) == 0x80, edges), "n_symbols": _per_text(_IS_SYMBOL[data], edges)}
    # Lines with a word, less those that are the first of their kind in the text.
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(breaks + 1, edges[:-1][np.diff(edges) > 0])
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[line_end - 1] == 10) if len(line_start) else line_end
    wordy = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[wordy], line_end[wordy]
    owner = owner_of(line_start, edges)
    first = _first_of(stretch_hash(prefix, line_start, line_end), owner)
    out["n_dup_lines"] = np.bincount(owner[~first], minlength=texts)
    # Words inside a window of eight that the text holds twice.
    words = stretch_hash(prefix, starts, ends)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        at = np.flatnonzero(text_of[: len(words) - WINDOW + 1] == text_of[WINDOW - 1 :])
        h = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
            h ^= h >> np.uint64(29)
        found = at[_repeats(h, text_of[at])]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(text_of[np.cumsum(covered)[:-1] > 0], minlength=texts)
    return out


def _features(keep: list[str], names: list[str], levels: list[hash_arrays.Level]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, edges, mean in hash_arrays.mean_logs(batches, levels):
            prefix = byte_prefix(data)
            got = base_counts(data, edges, prefix)
            new = [pa.array(got[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            new.append(pa.array(-mean, mask=np.isnan(mean)))
            yield pa.RecordBatch.from_arrays([part.column(names.index(c)) for c in keep] + new, names=keep + [f.split()[0] for f in FEATURES.split(", ")])

    return run


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def features(docs: DataFrame, keep: list[str], order: int = hash_arrays.ORDER) -> DataFrame:
    """The columns ``keep`` of each document with its counts and log perplexity (null for a text without words)."""
    names = list(dict.fromkeys([*keep, "text"]))
    read = docs.select(*names)
    return read.mapInArrow(_features(keep, names, hash_arrays.fit(read, order)), f"{_ddl(docs, keep)}, {FEATURES}")


def _scored(docs: DataFrame, keep: list[str]) -> DataFrame:
    with set_for(docs.sparkSession, SMALL_BATCHES):
        return stored(features(docs, keep), "quality")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


class Bands(NamedTuple):
    """Median log perplexity and scaled deviation over all texts, and by language."""

    overall: tuple[float, float]
    own: dict[str, tuple[float, float]]


def _middle(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.percentile_approx(value, 0.5, 10000).alias("mid"), F.count(F.lit(1)).alias("n"))


def _by_language(own: dict[str, float], otherwise: float) -> Column:
    """A number for each language; a null language is the empty one."""
    if not own:
        return F.lit(otherwise)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.coalesce("lang", F.lit(""))], F.lit(otherwise))


def bands(scored: DataFrame) -> Bands:
    """The bands of the ``MOST_BANDS`` most frequent languages with ``LEAST_TEXTS`` texts or more; sketches of the medians are summed up before the shuffle."""
    x, lang = F.col("log_perplexity"), F.coalesce("lang", F.lit("")).alias("lang")
    rows = scored.where(x.isNotNull()).select(lang, x.alias("x"), (~base_failed()).alias("fine"))
    mids = {r["lang"]: r["mid"] for r in _middle(rows, ["lang"], F.col("x")).where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "lang").limit(MOST_BANDS).collect()}
    mid = _middle(rows, [], F.col("x")).first()["mid"]
    if mid is None:
        return Bands((0.0, LEAST_SPREAD), {})
    # The deviations are taken over the texts that the base rules let pass, so that junk does not widen a band.
    fine = rows.where("fine")
    scaled = lambda m: max(1.4826 * (m or 0.0), LEAST_SPREAD)
    overall = _middle(fine, [], F.abs(F.col("x") - F.lit(mid))).first()["mid"]
    away = fine.where(F.col("lang").isin(list(mids))) if mids else fine.limit(0)
    mads = {r["lang"]: r["mid"] for r in _middle(away, ["lang"], F.abs(F.col("x") - _by_language(mids, mid))).collect()}
    return Bands((mid, scaled(overall)), {k: (m, scaled(mads.get(k))) for k, m in mids.items()})


def judged(scored: DataFrame, limits: Bands) -> DataFrame:
    """Add lower, upper, base_failed and kept. A language without a band of its own takes the one over all texts."""
    mid = _by_language({k: m for k, (m, _) in limits.own.items()}, limits.overall[0])
    spread = _by_language({k: s for k, (_, s) in limits.own.items()}, limits.overall[1]) * F.sqrt(1 + SHORT / F.greatest("word_chars", F.lit(1)))
    out = scored.withColumn("lower", mid - BELOW * spread).withColumn("upper", mid + ABOVE * spread)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, perplexity, band, base_failed and kept for every document.

    A null or empty text has zero counts, no perplexity and fails. A null
    language forms a group of its own. Repeated rows are judged alike. An empty
    table gives no rows.
    """
    scored = _scored(docs, ["doc_id", "lang"])
    return judged(scored, bands(scored)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("log_perplexity").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper")
    )


def passing(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns.

    The verdict depends on text and language alone; the rows meet it by the
    hash of the text, in place while the kept texts are few. The hash is an
    expression of Spark's, so the texts themselves go to no worker for it.
    """
    scored = _scored(docs.select("lang", "text", F.xxhash64("text").alias("text_key")), ["lang", "text_key"])
    fine = stored(judged(scored, bands(scored)).where("kept").select("text_key", F.coalesce("lang", F.lit("")).alias("_lang")).distinct(), "kept")
    # Other columns travel under numbered names, so that none clashes with the key.
    names = [c if c in ("text", "lang") else f"_c{i}" for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)
    keyed = plain.withColumn("text_key", F.xxhash64("text")).withColumn("_lang", F.coalesce("lang", F.lit("")))
    kept = keyed.join(F.broadcast(fine) if fine.count() <= BROADCAST_ROWS else fine, ["text_key", "_lang"], "left_semi")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
