"""Word shingles as 64-bit hashes, for the operators that run in Python batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: Bytes of a block, a random value for each byte, and the powers of an odd number and of its inverse.
_BLOCK = 1 << 15
_BYTE = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=U64)
_BASE, _FULL = 0x9E3779B97F4A7C17, 1 << 64
#: Bytes of the texts that are hashed at once.
BYTES = 200_000


def _powers(x: int) -> np.ndarray:
    return np.concatenate([[U64(1)], np.cumprod(np.full(_BLOCK - 1, x, dtype=U64))])


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, _FULL))


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte behind it) of each word between ASCII white space, with A-Z lower-cased.

    A word's hash is a polynomial in its bytes' values, modulo 2^64: the difference of two running sums over a block of
    bytes, moved to the word's start. Words that go on in further blocks get a share from each."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    space = np.concatenate([[True], _SPACE[data], [True]])
    edges = np.nonzero(space[1:] != space[:-1])[0]
    first, end = edges[::2], edges[1::2]
    out = np.zeros(len(first), dtype=U64)
    for lo in range(0, len(data), _BLOCK):
        hi = min(lo + _BLOCK, len(data))
        total = np.zeros(hi - lo + 1, dtype=U64)
        np.cumsum(_BYTE.take(data[lo:hi]) * _POWER[: hi - lo], out=total[1:])
        a, b = np.searchsorted(first, [lo, hi])
        if a and end[a - 1] > lo:
            out[a - 1 : a] += total[[min(int(end[a - 1]), hi) - lo]] * U64(pow(_BASE, lo - int(first[a - 1]), _FULL))
        if b > a:
            out[a:b] = (total[np.minimum(end[a:b], hi) - lo] - total[first[a:b] - lo]) * _INVERSE[first[a:b] - lo]
    return mix(out + (end - first).astype(U64)), first, end


def text_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text; many short texts are hashed at once."""
    held: list[bytes] = []
    size = 0

    def out():
        h, first, _ = hash_words(b"\n".join(held))
        cuts = np.searchsorted(first, np.cumsum([len(x) + 1 for x in held])[:-1])
        held.clear()
        return np.split(h, cuts)

    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= BYTES:
            yield from out()
            size = 0
    if held:
        yield from out()


def text_sets(texts: Iterable[str | None], n: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    return (np.unique(shingle_hashes(h, n)) for h in text_hashes(texts))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words, in order; fewer words make one shingle, none make none."""
    if len(h) == 0:
        return h
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, dtype=U64)
    for i in range(k):
        out = out * _MULT + h[i : len(h) - k + 1 + i]
    return mix(out + U64(k))
