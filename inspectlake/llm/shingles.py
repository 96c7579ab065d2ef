"""Word shingles of UTF-8 texts as 64-bit hashes, computed with array operations."""

from __future__ import annotations

import numpy as np

from inspectlake.llm.common import tables as _powers

WORDS = 5
_M = 2**64
_BASE = 0x9E3779B97F4A7C15
_WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, np.int8)
_WORD[[0x20, *range(0x09, 0x0E)]] = 0
_CHUNK = 1 << 18


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(_CHUNK, n) + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, _M))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(text: bytes):
    """Pieces of about a quarter of a megabyte that end where a word ends, so memory does not grow with the text."""
    at = 0
    while len(text) - at > _CHUNK:
        end = at + _CHUNK
        while end < len(text) and _WORD[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word (longest runs without white space, A-Z in lower case), in order."""
    parts = []
    for piece in _chunks(text):
        buf = _LOWER[np.frombuffer(piece, np.uint8)]
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = _WORD[buf]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _tables(len(buf))
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
        parts.append(mix((total[ends] - total[starts]) * down[starts]))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of the whole sequence where there are fewer words."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        whole = (words * _WEIGHTS[:n]).sum(dtype=np.uint64) + np.uint64(n)
        return mix(np.array([whole], np.uint64))
    total = np.zeros(n - WORDS + 1, np.uint64)
    for j in range(WORDS):
        total += words[j : n - WORDS + 1 + j] * _WEIGHTS[j]
    found = np.sort(mix(total))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]
