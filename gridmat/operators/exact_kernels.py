"""Rounding of exactly added digits, in numpy on whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE_BITS = 26
_MASK = (1 << BASE_BITS) - 1
# Bits of the number that is rounded; the rest only says whether it was more.
_TOP = 62


def _carried(digit: np.ndarray) -> np.ndarray:
    """Digits within [0, 2**26) from the lowest place up; the last column takes what is left, with the sign."""
    out = digit.copy()
    for c in range(out.shape[1] - 1):
        out[:, c + 1] += out[:, c] >> BASE_BITS
        out[:, c] &= _MASK
    return out


def _shifted(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.where(by >= 0, x << np.clip(by, 0, 62), x >> np.clip(-by, 0, 62))


def nearest(digit: np.ndarray, lowest: int) -> np.ndarray:
    """The doubles next to sum(digit[:, c] * 2**(26 * (lowest + c))), ties to even; digits of any sign."""
    n = len(digit)
    room = np.zeros((n, 3), np.int64)
    wide = np.concatenate([np.zeros((n, 3), np.int64), digit, room], axis=1)
    lowest -= 3
    negative = _carried(wide)[:, -1] < 0
    wide = _carried(np.where(negative[:, None], -wide, wide))
    filled = wide != 0
    top = wide.shape[1] - 1 - np.argmax(filled[:, ::-1], axis=1)
    some = filled.any(axis=1)
    top = np.where(some, top, 3)
    at = np.arange(n)
    d = [wide[at, top - back] for back in range(4)]
    bits = np.frexp(np.maximum(d[0], 1).astype(np.float64))[1].astype(np.int64)
    # The first digits in 62 bits, the last bit set if anything is left below: then one rounding is the right one.
    x = _shifted(d[0], _TOP - bits) | _shifted(d[1], _TOP - BASE_BITS - bits) | _shifted(d[2], _TOP - 2 * BASE_BITS - bits) | _shifted(d[3], _TOP - 3 * BASE_BITS - bits)
    lost = np.zeros(n, bool)
    for back in (2, 3):
        right = np.clip(bits - (_TOP - back * BASE_BITS), 0, 62)
        lost |= (d[back] & ((np.int64(1) << right) - 1)) != 0
    below = np.cumsum(filled, axis=1)
    lost |= np.where(top >= 4, below[at, np.maximum(top - 4, 0)], 0) > 0
    with np.errstate(over="ignore", under="ignore"):
        value = np.ldexp((x | lost).astype(np.float64), BASE_BITS * (lowest + top) + bits - _TOP)
    return np.where(some, np.where(negative, -value, value), 0.0)


def round_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (keys, places, digits, wild) to (keys, v)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [n for n in batch.schema.names if n.startswith("_k")]
        places, digits = batch.column("places"), batch.column("digits")
        sizes = places.value_lengths().to_numpy(zero_copy_only=False)
        place, digit = places.flatten().to_numpy(), digits.flatten().to_numpy()
        out = np.full(batch.num_rows, np.nan)
        lowest = int(place.min()) if len(place) else 0
        wide = np.zeros((batch.num_rows, int(place.max()) - lowest + 1 if len(place) else 1), np.int64)
        # Values with different highest places share the places below.
        np.add.at(wide, (np.repeat(np.arange(batch.num_rows), sizes), place - lowest), digit)
        out = nearest(wide, lowest)
        wild = batch.column("_wild")
        is_wild = ~np.asarray(wild.is_null())
        out = np.where(is_wild, wild.fill_null(0.0).to_numpy(zero_copy_only=False), out)
        v = pa.array(out, mask=(sizes == 0) & ~is_wild)
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], v], names=[*keys, "v"])
