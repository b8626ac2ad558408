"""Sets of hashed word shingles of whole texts, made for a batch at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0..n-1 and to 0..-(n-1), modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start and the hash of each word of lower-cased bytes; space and 9-13 end words."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    return starts, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _chunk(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    starts, hashed = word_hashes(data)
    first = np.searchsorted(starts, begins)
    rolled = hashed.copy()
    for k in range(1, n):
        rolled[:-k] = mixed(rolled[:-k] * _BASE + hashed[k:])
        rolled[len(rolled) - k :] = mixed(rolled[len(rolled) - k :] * _BASE)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:  # fewer words: the whole sequence is the one shingle
            x = np.uint64(b - a)
            for h in hashed[a:b]:
                x = mixed(np.array([x * _BASE + h], np.uint64))[0]
            yield np.array([x], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: Iterable[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-word shingles; a null text has none. bytes.lower() changes A-Z only."""
    with np.errstate(over="ignore"):
        held: list[bytes] = []
        size = 0
        for t in texts:
            b = (t or "").encode("utf-8", "surrogatepass").lower()
            if held and size + len(b) > CHUNK:
                yield from _chunk(held, n)
                held, size = [], 0
            held.append(b)
            size += len(b)
        if held:
            yield from _chunk(held, n)
