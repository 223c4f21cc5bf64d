"""Word and character shingles of many texts at once, as 64-bit hashes that are the same in every process."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa

WORD = re.compile(r"\w+")


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of all texts, one after another, and each text's number of words."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    count = np.array([len(w) for w in words], dtype=np.int64)
    coded = pa.array([w for ws in words for w in ws], pa.string()).dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return known[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64), count


def word_shingles(flat: np.ndarray, count: np.ndarray, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words within each text, in order, and how many each text has.

    short: a text of fewer words, one at least, has one shingle of all its words."""
    n = np.maximum(count - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.empty(0, np.int64)
    size = max(len(flat) - width + 1, 0)
    h = np.full(size, width, dtype=np.uint64)
    for k in range(width):
        h = (h ^ flat[k:k + size]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(count) else np.empty(0, np.int64)
    got = h[at]
    if short and (few := np.flatnonzero((count > 0) & (n == 0))).size:
        own = count[few].astype(np.uint64)
        for k in range(width - 1):
            with_word = np.flatnonzero(count[few] > k)
            x = (own[with_word] ^ flat[first[few[with_word]] + k]) * np.uint64(0x9E3779B97F4A7C15)
            own[with_word] = x ^ (x >> np.uint64(29))
        got = np.insert(got, np.cumsum(n)[few], own)
        n[few] = 1
    return got, n


def char_shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` code points within each text, in order, and how many each has; a shorter text
    that is not empty has one, of all its code points."""
    count = np.array([len(t) for t in texts], dtype=np.int64)
    # A code point between texts keeps short texts apart: they are padded to the width with it.
    padded = np.maximum(count, width)
    flat = np.frombuffer("".join(t if len(t) >= width else t + "\0" * (width - len(t)) for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = padded - width + 1
    h = _polynomial(flat.astype(np.uint64), width)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    if (n == padded).all():  # width 1
        return h, n
    last = np.cumsum(padded)[:-1]
    inside = np.ones(len(h), dtype=bool)  # a run may not go from one text to the next
    for k in range(1, width):
        inside[last[last - k < len(h)] - k] = False
    return h[inside], n


def _polynomial(x: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of all runs of ``width`` elements, in about 2 log2(width) passes."""
    size = max(len(x) - width + 1, 0)
    out, have, power, span = None, 0, x, 1
    p = 0xD6E8FEB86659FD93
    while True:
        if width & span:
            out = power if out is None else out[:len(x) - have - span + 1] * np.uint64(pow(p, span, 1 << 64)) + power[have:have + len(x) - have - span + 1]
            have += span
        if have == width:
            return out[:size].copy() if out is x else out[:size]
        power = power[:len(x) - 2 * span + 1] * np.uint64(pow(p, span, 1 << 64)) + power[span:span + len(x) - 2 * span + 1]
        span *= 2
