"""Words of a text as hashed terms for the classifiers: letters, signs, shapes and repeats."""

from __future__ import annotations

import numpy as np

from gridmat.llm.common import LOWER, byte_prefix, mixed, owner_of, stretch_hash, word_edges

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD = LOWER.copy()
# 1 small letter or part of a longer character, 2 capital, 3 digit, 4 sign
_SHAPE = np.full(256, 4, np.uint64)
_SHAPE[97:123] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_SHAPE[128:] = 1


def terms(data: np.ndarray, edges: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the terms in order. Every word gives its letters and digits in small letters, the run of signs at its end if
    there is one, and its shape: kinds of first and last character, whether it is all capitals, and whether it repeats the word before it."""
    start, end = word_edges(data, edges)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = owner_of(start, edges)
    kind = _SHAPE[data]
    low = _FOLD[data]
    prefix = byte_prefix(low)
    # Where the run of signs at the end of each word begins.
    plain = np.flatnonzero(kind != 4)
    before = np.searchsorted(plain, end) - 1
    body = np.where((before >= 0) & (len(plain) > 0), plain[np.maximum(before, 0)] + 1 if len(plain) else 0, 0)
    body = np.clip(body, start, end)
    core = stretch_hash(prefix, start, body)
    tail = stretch_hash(prefix, body, end)
    whole = stretch_hash(prefix, start, end)
    again = np.zeros(len(start), np.uint64)
    again[1:] = (whole[1:] == whole[:-1]) & (text[1:] == text[:-1])
    capitals = np.concatenate([[0], np.cumsum(kind == 2)])
    shouting = (capitals[body] - capitals[start] >= np.maximum(body - start, 2)).astype(np.uint64)
    shape = mixed((((kind[start] * np.uint64(8) + kind[end - 1]) * np.uint64(2) + again) * np.uint64(2) + shouting) + np.uint64(1 << 40))
    parts = [core[body > start], tail[end > body] ^ _STEP, shape]
    where = [3 * np.flatnonzero(body > start), 3 * np.flatnonzero(end > body) + 1, 3 * np.arange(len(start)) + 2]
    order = np.argsort(np.concatenate(where), kind="stable")
    number = np.concatenate(where)[order] // 3
    return (mixed(np.concatenate(parts)[order]) % np.uint64(buckets)).astype(np.int64), text[number]
