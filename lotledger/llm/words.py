"""Words and word windows of whole texts as 64-bit hashes, vectorised over many documents.

A word is a run of bytes other than space and \\x09-\\x0D. Hashes are polynomials over the
bytes modulo 2^64, got from one running sum, and then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lotledger.llm.tables import ship, worker_cache

ship(__name__)

BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; kept by the worker."""
    cache = worker_cache("powers")
    if base not in cache or len(cache[base][0]) < n:
        size = max(1 << 19, n)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        if size > 1 << 21:
            return both[0], both[1]
        cache[base] = (both[0], both[1])
    return cache[base]


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, not yet mixed."""
    power, inverse = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (no nulls) and where each text begins, with the end."""
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if places is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    if data is None or not size:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of every text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    inner = space[1:-1]
    np.less(data - np.uint8(9), 5, out=inner)
    inner |= data == 32
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(~inner & (space[:-2] | cut[:-1]))
    ends = np.flatnonzero(~inner & (space[2:] | cut[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return np.where((data - np.uint8(65)) < 26, data | np.uint8(32), data)


def word_hashes(texts: pa.Array, lower: bool, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of every text."""
    data, offsets = raw(texts)
    starts, ends, counts = word_spans(data, offsets)
    return span_hashes(lowered(data) if lower else data, starts, ends, which), counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return mixed(_spans_hash(data.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_BASES[which]))


def window_hashes(hashes: np.ndarray, counts: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words inside one text, the first word of each, and the windows of each text."""
    number = np.maximum(counts - size + 1, 0)
    total = int(number.sum())
    before = np.cumsum(counts) - counts
    starts = np.repeat(before - (np.cumsum(number) - number), number) + np.arange(total)
    return sequence_hashes(hashes, starts, starts + size, which), starts, number


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of hashes[start:end]; sequences of other lengths get other hashes."""
    return mixed(_spans_hash(hashes, starts, ends, WORD_BASES[which]) + (ends - starts).astype(np.uint64))
