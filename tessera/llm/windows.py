"""Hashes of words and of runs of words, for a whole block of texts at once in numpy.

A word's hash is a polynomial over random byte values modulo 2^64, mixed; a run of words is a polynomial over the words'
hashes, mixed. Equal words have equal hashes in every process and run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
SEED = 20240229

_BYTES = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)  #: each byte, with A-Z lowered
LOWER[65:91] += 32
AS_IS, LOWERED = _BYTES, _BYTES[LOWER]
#: The bytes that part words: space and U+0009 to U+000D.
PARTS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_POWERS: dict[str, np.ndarray] = {}
KEPT = 5 << 18


def inverse(odd: int) -> int:
    return pow(int(odd), -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i below n at least. Those for the longest texts are not kept."""
    if len(_POWERS.get("up", ())) >= n:
        return _POWERS["up"], _POWERS["down"]
    out = []
    for base in (BASE, np.uint64(inverse(int(BASE)))):
        steps = np.full(max(n, KEPT), base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps, out=steps))
    if n <= 4 * KEPT:
        _POWERS["up"], _POWERS["down"] = out
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = PARTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~parts[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sums(data: np.ndarray, values: np.ndarray = LOWERED) -> tuple[np.ndarray, np.ndarray]:
    """What ``between`` needs of all bytes: polynomials of the bytes up to each place, and the powers that shift them back."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    return total, down


def between(total: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each range, from ``sums``."""
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWERED) -> np.ndarray:
    """The hash of each word; ``values`` are LOWERED (A-Z as a-z) or AS_IS."""
    return between(*sums(data, values), starts, ends)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, the first place of each, and which one stands at each place; by a hash table, as only the
    distinct ones need an order.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = pa.array(keys).dictionary_encode()
    of, own = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    first = np.flatnonzero(np.append(True, of[1:] > np.maximum.accumulate(of)[:-1]))  # numbers are given as keys come up
    order = np.argsort(own)
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    return own[order], first[order], place.take(of)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on, for all but the last k - 1 words."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * STEP + hashes[j : j + n]
    return mix(out + np.uint64(k))
