"""Word and shingle hashes over whole texts, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _pieces(data: bytes):
    """Cut at white space into pieces of about _CHUNK bytes; one longer word stays whole."""
    at = 0
    while len(data) - at > _CHUNK:
        ends = [e for e in (data.find(c, at + _CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if e >= 0]
        if not ends:
            break
        yield data[at : min(ends)]
        at = min(ends)
    yield data[at:]


def word_hashes(text: str | None) -> np.ndarray:
    """One uint64 for each word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, in text order."""
    if not text:
        return np.empty(0, np.uint64)
    found = []
    for piece in _pieces(text.encode("utf-8", "surrogatepass").lower()):
        raw = np.frombuffer(piece, np.uint8)
        inside = np.concatenate(([False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _powers_to(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
        found.append(mix((total[ends] - total[starts]) * inverse[starts]))
    return found[0] if len(found) == 1 else np.concatenate(found)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle; no words: empty."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * _BASE + w[k : k + len(h)])
    return np.unique(h)
