"""Hashes of words and of word shingles, in NumPy, with memory bounded by a text's number of words."""

from __future__ import annotations

import re

import numpy as np

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEGMENT = 1 << 19
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = [np.uint64(x | 1) for x in _rng.integers(1, 2**63, 12, dtype=np.uint64)]
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Each bit of x reaches each bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, _BACK)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _hashed(a: np.ndarray) -> np.ndarray:
    space = (a == 32) | ((a >= 9) & (a <= 13))
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, back = _powers(len(a))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * power, dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """64 bits for each word [^\\x20\\x09-\\x0D]+ of the UTF-8 bytes, A-Z lower-cased."""
    data = data.translate(ASCII_LOWER)
    out, at = [], 0
    while len(data) - at > SEGMENT and (cut := _SPACE.search(data, at + SEGMENT)):
        out.append(_hashed(np.frombuffer(data[at : cut.start()], np.uint8)))
        at = cut.start()
    out.append(_hashed(np.frombuffer(data[at:], np.uint8)))
    return np.concatenate(out)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The set of shingles of so many words, sorted; with fewer words, the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * _MIX[i % len(_MIX)]
        total = mix(total) if i % len(_MIX) == len(_MIX) - 1 else total
    return np.unique(mix(total))
