"""XXH64 of many byte ranges at once, on numpy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
# Fixed values of the XXH64 specification.
P1, P2, P3, P4, P5 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _equal_length(word: np.ndarray, half: np.ndarray, byte: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    s = U(seed)
    end = at + size
    with np.errstate(over="ignore"):
        if size >= 32:
            v = [np.full(len(at), s + P1 + P2), np.full(len(at), s + P2), np.full(len(at), s), np.full(len(at), s - P1)]
            for k in range(size // 32):
                for j in range(4):
                    v[j] = _round(v[j], word[at + (32 * k + 8 * j)])
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for j in range(4):
                h = (h ^ _round(U(0), v[j])) * P1 + P4
            at = at + size // 32 * 32
        else:
            h = np.full(len(at), s + P5)
        h = h + U(size)
        left = size % 32
        for _ in range(left // 8):
            h = _rotl(h ^ _round(U(0), word[at]), 27) * P1 + P4
            at = at + 8
        if left % 8 >= 4:
            h = _rotl(h ^ (half[at].astype(np.uint64) * P1), 23) * P2 + P3
            at = at + 4
        for k in range(left % 4, 0, -1):
            h = _rotl(h ^ (byte[end - k].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
        return h ^ (h >> U(32))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of data[starts[i]:ends[i]], ranges of equal length together."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    n = len(data) + 1
    word = np.ndarray((n,), "<u8", padded, strides=(1,))
    half = np.ndarray((n,), "<u4", padded, strides=(1,))
    size = ends - starts
    order = np.argsort(size.astype(np.uint16) if len(size) and size.max() < 65536 else size, kind="stable")
    bounds = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1)) if len(size) else []
    out = np.empty(len(starts), dtype=np.uint64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        rows = order[a:b]
        out[rows] = _equal_length(word, half, padded, starts[rows], int(size[rows[0]]), seed)
    return out
