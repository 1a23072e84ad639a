"""Vectorised words and hashes over a byte buffer that holds many texts.

A word is a maximal run of bytes that are no white space. Its hash is a polynomial in the odd base
``BASE`` modulo 2**64 over per-byte random constants, mixed with its length, so it depends on the bytes
alone and equal words hash alike in every text and on every machine.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_BLOCK = 1 << 16


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(_BLOCK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(BASE), _powers(_INVERSE)
_BYTE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser whose every output bit depends on every input bit (in place where it can)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def trim() -> None:
    """Give freed memory back to the system: workers live on between stages, and share an executor's bound."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and where each text starts (one more entry for the end)."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, at - at[0] if len(at) else np.zeros(1, np.int64)


def words(data: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the buffer, and the first word of each text (one more for the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~gap[data]
    left = inside.copy()
    left[1:] &= ~inside[:-1]
    right = inside.copy()
    right[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]  # a text may start inside a run of the buffer
    left[cut] = inside[cut]
    right[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    return start, end, np.searchsorted(start, at)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; the spans are in order and do not overlap."""
    out = np.zeros(len(start), dtype=np.uint64)
    if not len(start):
        return out
    i = 0
    while i < len(start):  # block by block, so that the powers stay in the cache
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _BLOCK, side="right")))
        if end[j - 1] - base > _BLOCK:  # one span longer than a block
            h = np.uint64(0)
            for s in range(int(start[i]), int(end[i]), _BLOCK):
                part = _BYTE[data[s : min(s + _BLOCK, end[i])]] * _POW[: min(_BLOCK, end[i] - s)]
                h = h * np.uint64(0xD6E8FEB86659FD93) + part.sum(dtype=np.uint64)
            out[i] = h
            i += 1
            continue
        total = np.zeros(end[j - 1] - base + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[base : end[j - 1]]] * _POW[: end[j - 1] - base], out=total[1:])
        s = start[i:j] - base
        out[i:j] = (total[end[i:j] - base] - total[s]) * _INV[s]
        i = j
    out += (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return mix(out)
