"""Token ids of whole batches of text with a word-level BPE file, the same ids as the ``tokenizers`` library gives.

Text is cut into units: inside a word, runs of letters, single digits and runs
of signs. Only the distinct units of a batch are encoded, all of one length at
once: rows of symbols, of which every round merges the pair with the lowest
rank, until no row has a mergeable pair left. Units outside ASCII and the
Latin-1 letters, with an apostrophe or longer than ``LONGEST`` bytes go through
the library itself, whole words at a time.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

from gridmat.llm.common import byte_prefix, owner_of, process_cache, stretch_hash, word_edges

LONGEST = 48
CACHE_UNITS = 1_000_000
_NONE = np.int32(1 << 30)
_OTHER_WORD = np.uint64(0xA5A5A5A55A5A5A5A)


def _visible_bytes() -> list[str]:
    """The printable stand-in of every byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return out


# 1 letters, 2 digits, 3 signs, 0 anything that the fast path leaves to the library
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[39] = 0


class WordBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = _visible_bytes()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + end] for c in shown], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges, or -1."""
        key = left.astype(np.int64) << 16 | right
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        return np.where(self.keys[place] == key, place, -1).astype(np.int32)

    def _merged(self, symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, ids) of units with the same number of symbols, by number of ids left."""
        rows, out = np.arange(len(symbols)), []
        place = self._pairs(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(symbols), -1)
        while symbols.shape[1] > 1 and len(rows):
            rank = np.where(place >= 0, self.rank[place], _NONE)
            j = rank.argmin(axis=1)
            line = np.arange(len(rows))
            live = rank[line, j] < _NONE
            if not live.all():
                out.append((rows[~live], symbols[~live]))
                rows, symbols, place, j = rows[live], symbols[live], place[live], j[live]
                if not len(rows):
                    return out
                line = np.arange(len(rows))
            n = symbols.shape[1]
            symbols[line, j] = self.made[place[line, j]]
            keep = np.ones(symbols.shape, bool)
            keep[line, j + 1] = False
            symbols = symbols[keep].reshape(len(rows), n - 1)
            keep = np.ones(place.shape, bool)
            keep[line, j] = False
            place = place[keep].reshape(len(rows), n - 2)
            if n > 2:
                before = np.flatnonzero(j > 0)
                place[before, j[before] - 1] = self._pairs(symbols[before, j[before] - 1], symbols[before, j[before]])
                after = np.flatnonzero(j < n - 2)
                place[after, j[after]] = self._pairs(symbols[after, j[after]], symbols[after, j[after] + 1])
        if len(rows):
            out.append((rows, symbols))
        return out

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and joined ids of distinct units."""
        size = np.zeros(len(start), np.int64)
        groups = []
        length = np.where(plain & (end - start <= LONGEST), end - start, 0)
        for n in np.unique(length[length > 0]):
            rows = np.flatnonzero(length == n)
            symbols = self.inner[data[start[rows][:, None] + np.arange(n)]]
            symbols[:, -1] = self.last[data[end[rows] - 1]]
            for got, ids in self._merged(symbols):
                groups.append((rows[got], ids))
        other = np.flatnonzero(length == 0)
        if len(other):
            texts = [raw[start[i] : end[i]].tobytes().decode("utf-8") for i in other]
            for i, e in zip(other, self.library.encode_batch(texts, add_special_tokens=False)):
                groups.append((np.array([i]), np.array([e.ids], np.int32).reshape(1, -1)))
        for rows, ids in groups:
            size[rows] = ids.shape[1]
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(at[-1], np.uint16)
        for rows, ids in groups:
            flat[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return size, flat

    def _learn(self, hashes: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        if len(self.known) + len(hashes) > CACHE_UNITS:
            self.clear()
        if self.used + len(flat) > len(self.flat):
            grown = np.zeros(2 * (self.used + len(flat)), np.uint16)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(flat)] = flat
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.at = np.insert(self.at, place, self.used + np.concatenate([[0], np.cumsum(size)])[:-1])
        self.size = np.insert(self.size, place, size)
        self.used += len(flat)

    def batch(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Joined ids (uint16), ids per text, hash of every unit, units per text."""
        texts = len(edges) - 1
        if not len(raw):
            none = np.zeros(texts, np.int64)
            return np.zeros(0, np.uint16), none, np.zeros(0, np.uint64), none
        data = raw.copy()
        upper = (raw >= 65) & (raw < 91)
        data[upper] += 32
        kind = _KIND[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        tail = raw[lead + 1]
        fine = (tail != 0x97) & (tail != 0xB7)
        lead, tail = lead[fine], tail[fine]
        kind[lead] = kind[lead + 1] = 1
        data[lead[tail <= 0x9E] + 1] += 0x20
        special = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        kind[special] = 0
        word_start, word_end = word_edges(raw, edges)
        strange = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(kind == 0, out=strange[1:])
        plain_word = strange[word_end] == strange[word_start]
        # Units of plain words start at the word, at a digit, after a digit and where the kind changes.
        first = np.ones(len(raw), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        first[word_start] = True
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[word_start[plain_word]] += 1
        inside[word_end[plain_word]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        fast = np.flatnonzero(first & inside)
        slow = word_start[~plain_word]
        start = np.concatenate([fast, slow])
        is_fast = np.arange(len(start)) < len(fast)
        order = np.argsort(start, kind="stable")
        start, is_fast = start[order], is_fast[order]
        limit = np.searchsorted(word_start, start, side="right") - 1
        end = np.minimum(np.append(start[1:], len(raw)), word_end[limit])
        hashes = stretch_hash(byte_prefix(data), start, end)
        if len(slow):
            hashes[~is_fast] = stretch_hash(byte_prefix(raw), start[~is_fast], end[~is_fast]) ^ _OTHER_WORD
        unit, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, unit), max(len(self.known) - 1, 0))
        new = np.ones(len(unit), bool) if not len(self.known) else self.known[place] != unit
        if new.any():
            pick = where[new]
            size, flat = self._encode(data, start[pick], end[pick], is_fast[pick], raw)
            before = len(self.known)
            self._learn(unit[new], size, flat)
            if len(self.known) < before + int(new.sum()):  # the cache was emptied: encode the others again
                pick = where[~new]
                size, flat = self._encode(data, start[pick], end[pick], is_fast[pick], raw)
                self._learn(unit[~new], size, flat)
        place = np.searchsorted(self.known, unit)
        at, size = self.at[place][back], self.size[place][back]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(at - total[:-1], size)]
        text = owner_of(start, edges)
        units = np.bincount(text, minlength=texts)
        return ids, np.bincount(text, weights=size, minlength=texts).astype(np.int64), hashes, units


def word_bpe(path: str) -> WordBpe:
    cache = process_cache()
    if ("bpe", path) not in cache:
        cache["bpe", path] = WordBpe(path)
    return cache["bpe", path]
