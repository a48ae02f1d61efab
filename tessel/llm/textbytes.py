"""Vectorised work on the UTF-8 bytes of a column of texts: words, their hashes, counts.

Texts are taken in chunks of about ``CHUNK`` bytes, so memory doesn't grow with a record batch; one
text is never divided here, so it does grow with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
with np.errstate(over="ignore"):
    _rng = np.random.Generator(np.random.PCG64(20240229))
    BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` on bytes: digits, a-z and every byte of a non-ASCII character.
LOWER_WORD = np.zeros(256, bool)
LOWER_WORD[0x30:0x3A] = LOWER_WORD[0x61:0x7B] = LOWER_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets (n + 1) and bytes of a string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets from 0, bytes) of runs of whole texts."""
    at, data = buffers(texts)
    row, n = 0, len(at) - 1
    while row < n:
        stop = int(np.searchsorted(at, at[row] + size, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop, at[row : stop + 1] - at[row], data[at[row] : at[stop]]
        row = stop


def word_spans(data: np.ndarray, at: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the maximal runs of word bytes; no run crosses two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flags = np.zeros(len(data) + 1, bool)
    flags[:-1] = in_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.concatenate(([False], flags[:-1]))
    starts = np.flatnonzero(flags & (first | ~before))
    ends = np.flatnonzero(before & (first | ~flags))
    return starts, ends


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2**64 and of its inverse, from exponent 0."""
    global _powers
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers = tuple(np.multiply.accumulate(np.concatenate(([_U(1)], np.full(m - 1, b, np.uint64)))) for b in (_BASE, inverse))
    return _powers


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums (n + 1) from which :func:`span_hash` makes the hash of any span."""
    with np.errstate(over="ignore"):
        return np.concatenate(([_U(0)], np.cumsum(BYTE_VALUE[data] * powers(len(data) + 1)[0][: len(data)], dtype=np.uint64)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, the same for the same bytes wherever they stand."""
    with np.errstate(over="ignore"):
        raw = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _U(_STEP))


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive word hashes (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out = out * _U(_BASE) + words[j : j + n]
        return mix(out)


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words (runs of other than the contracts' white space) of each text."""
    out = np.zeros(len(texts), np.int64)
    for row, stop, at, data in chunks(texts):
        starts, _ = word_spans(data, at, NOT_SPACE)
        out[row:stop] = np.diff(np.searchsorted(starts, at))
    return out
