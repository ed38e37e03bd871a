"""Word shingles of texts as sets of 64-bit hashes, computed over whole batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from sparkscope.llm import common

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at once; a longer text is cut at white space.
CHUNK = 500_000
WIDTH = 5
_COEFFICIENTS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (wrapping arithmetic)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    if n > len(_powers.get("up", ())):
        for name, b in (("up", BASE), ("down", INVERSE)):
            x = np.full(max(n, CHUNK) + 1, b, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of lower-cased bytes, from prefix sums of a polynomial."""
    white = WHITE[data]
    edge = np.diff(white.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], out=prefix[1:])
    return starts, mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(data) <= CHUNK:
        return _hash_words(np.frombuffer(data, dtype=np.uint8))
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not WHITE[data[end]]:
            end += 1
        s, h = _hash_words(np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at))
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    ASCII letters count as lower case; words are runs without space and U+0009 to U+000D. A text with fewer words has
    its whole sequence as its only shingle; one without words, or null, has none.
    """
    full = [t or "" for t in texts]
    for a, b in common.slices(full, CHUNK):
        parts = [t.encode().lower() for t in full[a:b]]
        bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        starts, hashes = _words(b"\n".join(parts) + b"\n")
        first = np.searchsorted(starts, bounds)
        n = len(hashes)
        rolled = np.zeros(n, dtype=np.uint64)
        for k in range(min(width, n)):
            rolled[: n - k] += hashes[k:] * _COEFFICIENTS[k]
        rolled = mix(rolled)
        for x, y in zip(first[:-1], first[1:]):
            if y - x >= width:
                yield np.unique(rolled[x : y - width + 1])
            elif y > x:
                yield mix(np.array([(hashes[x:y] * _COEFFICIENTS[: y - x]).sum() + U(0xA5A5 * (y - x))], dtype=np.uint64))
            else:
                yield np.empty(0, dtype=np.uint64)
