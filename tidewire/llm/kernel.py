"""Vectorised word and shingle kernels over a batch of texts.

A word is ``[^\\x20\\x09-\\x0D]+``.  All separators are single ASCII bytes, so the
split is done on UTF-8 bytes; no byte of a longer character is a separator.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = "[^\\x20\\x09-\\x0D]+"
LONG_WORD = 96  # bytes; longer words are hashed by a digest, so one blob costs one call

_SEP = np.zeros(256, dtype=bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(seed: int) -> tuple[np.ndarray, np.uint64]:
    draw = np.random.default_rng(seed)
    table = draw.integers(0, 2**64, size=256, dtype=np.uint64)
    factor = np.uint64(int(draw.integers(0, 2**62)) * 4 + 3)
    return table, factor


@dataclass
class Words:
    """The words of a batch: byte spans in ``buf`` and the text each belongs to."""

    buf: np.ndarray  # all texts, each followed by one space
    offsets: np.ndarray  # start of each text in buf; one more entry than texts
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # index of the text of each word
    first: np.ndarray  # index of each text's first word; one more entry than texts

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(texts, lower: bool = False) -> Words:
    """Split texts (None counts as empty) into words."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=offsets[1:])
    buf = np.frombuffer(b" ".join(raw) + b" " if raw else b"", dtype=np.uint8)
    if lower:
        buf = _LOWER[buf]
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SEP[buf], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    first = np.searchsorted(starts, offsets).astype(np.int64)
    doc = np.repeat(np.arange(len(raw), dtype=np.int64), np.diff(first))
    return Words(buf, offsets, starts, ends, doc, first)


def word_hashes(words: Words, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    table, factor = _tables(seed)
    lengths = words.ends - words.starts
    out = np.zeros(len(lengths), dtype=np.uint64)
    short = np.flatnonzero(lengths <= LONG_WORD)
    order = short[np.argsort(-lengths[short].astype(np.int16), kind="stable")]
    at = words.starts[order]
    size = lengths[order]
    h = size.astype(np.uint64)
    alive = len(order)
    left = np.bincount(size, minlength=LONG_WORD + 1) if alive else np.zeros(1, dtype=np.int64)
    for k in range(LONG_WORD):
        alive -= int(left[k]) if k < len(left) else 0
        if alive <= 0:
            break
        h[:alive] = h[:alive] * factor + table[words.buf[at[:alive] + k]]
    out[order] = mix64(h)
    for i in np.flatnonzero(lengths > LONG_WORD):
        bytes_ = words.buf[words.starts[i] : words.ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(bytes_, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def window_hashes(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive entries; run i starts at entry i."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    _, factor = _tables(seed + 1000)
    size = len(hashes) - n + 1
    h = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        h = h * factor + hashes[k : k + size]
    return mix64(h)


def window_starts(words: Words, n: int) -> np.ndarray:
    """Indices of words at which a window of n words of one text begins."""
    if len(words.doc) < n:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(words.doc[: len(words.doc) - n + 1] == words.doc[n - 1 :])


def shingle_sets(texts, n: int = 5, lower: bool = True, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted 64-bit hashes.

    A text of fewer than n words, but at least one, has its whole sequence as its
    one shingle; a text without words has none.  Returns the hashes of all texts
    one after the other, and each text's first place in them.
    """
    words = split_words(texts, lower)
    hashes = word_hashes(words, seed)
    counts = words.counts
    starts = window_starts(words, n)
    values = window_hashes(hashes, n, seed)[starts]
    cuts = np.searchsorted(words.doc[starts], np.arange(words.n_docs + 1))
    sets = []
    for i, count in enumerate(counts.tolist()):
        if count >= n:
            sets.append(np.unique(values[cuts[i] : cuts[i + 1]]))
        elif count:
            at = words.first[i]
            sets.append(mix64(window_hashes(hashes[at : at + count], count, seed) + np.uint64(count)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    first = np.zeros(words.n_docs + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=first[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), first


def slices(texts: pd.Series, chars: int = 2_000_000) -> Iterator[slice]:
    """Consecutive slices of a batch of about so many characters each."""
    lengths = texts.str.len().fillna(0).to_numpy() if len(texts) else []
    start, total = 0, 0
    for i, length in enumerate(lengths):
        total += length
        if total >= chars:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(lengths):
        yield slice(start, len(lengths))
