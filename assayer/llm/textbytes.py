"""Texts as byte arrays: words, rolling hashes of spans, sliding minima and hashed lookups, for whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Base of the polynomial hashes modulo 2**64; odd, so that it has an inverse.
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least. A worker keeps a table for blocks; a longer text's is made for it alone."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(max(n, 1 << 20), b, np.uint64)
        x[0] = 1
        made.append(np.cumprod(x, dtype=np.uint64))
    if n <= 1 << 20:
        _powers[:] = made
    return made[0], made[1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, from which span() takes the hash of any span."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])


def byte_values(fold: bool = False) -> np.ndarray:
    """A 64-bit value for each byte, by rule; fold gives A-Z the values of a-z."""
    x = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if fold:
        x[65:91] = x[97:123]
    return x


#: Bytes between words: space and 0x09 to 0x0D.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
VALUES, FOLDED = byte_values(), byte_values(True)


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[slice]:
    """Slices of about `size` bytes of texts."""
    at = 0
    while at < len(texts):
        end, held = at + 1, len(texts[at])
        while end < len(texts) and held + len(texts[end]) <= size:
            held += len(texts[end])
            end += 1
        yield slice(at, end)
        at = end


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One array of bytes with a gap before each text and after the last, and each text's start and end in it."""
    a = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size + len(gap))
    return a, end - size, end


def words(a: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't between words. The array must begin and end with such a byte."""
    apart = between[a]
    return np.flatnonzero(apart[:-1] & ~apart[1:]) + 1, np.flatnonzero(~apart[:-1] & apart[1:]) + 1


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of x[i : i + width], for the len(x) - width + 1 places where it fits."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def window_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of values[i : i + width], for every place where it fits."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix(values)
    return mixed((sums[width:] - sums[:-width]) * powers(len(sums))[1][:n])


class Lookup:
    """Places of keys in an array of distinct 64-bit words, by an open hash table of at most a third full."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        self.bits = max(8, int(3 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(self.keys[:-1])
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            stays = self.table[slot] != left
            left, slot = left[stays], (slot[stays] + 1) & (len(self.table) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        keys = keys.astype(np.uint64)
        slot = self._slot(keys)
        out = self.table[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
            out[left] = self.table[slot[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != keys[left])]
        return out
