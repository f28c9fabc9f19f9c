"""Words and 64-bit word hashes of Arrow text batches, as NumPy passes over the UTF-8 bytes.

A word's hash is a polynomial in its bytes modulo 2**64, read off one running sum; two different words share a
hash with a chance of about 2**-60, and all exactness claims of the operators are up to that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"n": 0}

#: Bytes that belong to words when words are what lies between the six ASCII blanks.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False


def _lower_bytes() -> np.ndarray:
    table = _BYTE.copy()
    table[65:91] = _BYTE[97:123]
    return table


LOWER = _lower_bytes()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown when a longer slice comes."""
    if _powers["n"] < n + 1:
        size = (1 << max(18, n.bit_length())) + 1
        ones = np.ones(size, np.uint64)
        up, down = ones.copy(), ones
        up[1:], down[1:] = _BASE, _INVERSE
        _powers.update(n=size, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets in them): whole texts of about ``limit`` bytes together; a
    longer one comes alone. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        last = min(last, len(texts))
        yield first, last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each row's words begin among them (one more than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    w = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    starts = np.flatnonzero(w & (~before | cut[:-1]))
    ends = np.flatnonzero(w & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span; with the default table, capital A-Z count as small letters."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their bounds per row. A row with fewer words has its whole sequence as
    one; a row without words has none."""
    counts = np.diff(bounds)
    n = len(words)
    run = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        run = run * np.uint64(0x9FB21C651E98DF25) + words[j : j + len(run)]
    run = mix(run)
    out_counts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(out_counts)])
    whole = np.flatnonzero(counts >= k)
    take = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], out_counts) + np.repeat(bounds[:-1], out_counts)
    short = np.flatnonzero((counts > 0) & (counts < k))
    out = np.zeros(out_bounds[-1], np.uint64)
    if len(whole):
        is_whole = np.repeat(counts >= k, out_counts)
        out[is_whole] = run[take[is_whole]]
    for r in short:
        h = np.uint64(int(counts[r]))
        for w in words[bounds[r] : bounds[r + 1]]:
            h = np.uint64((int(h) * 0x9FB21C651E98DF25 + int(w)) & (2**64 - 1))
        out[out_bounds[r]] = mix(np.array([h ^ np.uint64(0xA5A5A5A5)]))[0]
    return out, out_bounds
