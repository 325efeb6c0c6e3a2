"""Words of UTF-8 text as 64-bit hashes, found for many texts at once with numpy.

A word is a longest run of bytes of one class, all but \\x20 and \\x09-\\x0D unless told otherwise; A-Z count as a-z. A word's hash is the sum of a random
number for each byte times a power of an odd multiplier for its place, so one running sum over a text serves all its words.
"""

from __future__ import annotations

import hashlib

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(MULTIPLIER) + U64(seed * 0x632BE59BD9B4E019 % 2**64))


def _byte_numbers() -> np.ndarray:
    table = numbers(256, 1)
    table[65:91] = table[97:123]
    return table


BYTES = _byte_numbers()
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words cut at white space, and of words of ASCII letters, digits and whatever lies beyond ASCII.
SOLID = ~SPACE
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 1 << 20:
            _powers[base] = have
    return have[:n]


INVERSE = pow(MULTIPLIER, -1, 2**64)


def words(data: np.ndarray, bounds: np.ndarray, of: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of all texts, and the first word of each text (with the number of words at the end).

    `of` tells the bytes that words consist of.
    """
    n = len(data)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, U64), np.zeros(len(bounds), np.int64)
    solid = of[data]
    edge = np.empty(n + 1, bool)
    edge[0] = solid[0]
    edge[n] = solid[-1]
    np.not_equal(solid[1:], solid[:-1], out=edge[1:n])
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    inner = np.unique(cuts[solid[cuts] & solid[cuts - 1]]) if len(cuts) else cuts
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(inner):  # a text ends in a word and the next begins with one
        starts = np.sort(np.concatenate([starts, inner]))
        ends = np.sort(np.concatenate([ends, inner]))
    run = np.cumsum(BYTES[data] * powers(MULTIPLIER, n), dtype=U64)
    sums = run[ends - 1]
    sums -= np.where(starts > 0, run[starts - 1], U64(0))
    hashes = mix64(sums * powers(INVERSE, n)[starts])
    return starts, ends, hashes, np.searchsorted(starts, bounds)


_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes of a word that are hashed eight at a time for all words at once; a longer word is hashed by itself.
CHUNKED = 64


def solid_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, cut at white space, of all texts. The hashes are others than those of `words`, found by a
    few steps a word instead of a byte."""
    n = len(data)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, U64)
    raw = data.tobytes().translate(_LOWER) + bytes(8)
    low = np.frombuffer(raw, np.uint8, n)
    white = (low - np.uint8(9) < 5) | (low == 32)
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = not white[0], not white[-1]
    np.not_equal(white[1:], white[:-1], out=edge[1:n])
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    inner = np.unique(cuts[~(white[cuts] | white[cuts - 1])])
    if len(inner):  # a text ends in a word and the next begins with one
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    size = ends - starts
    eight = np.ndarray((n,), "<u8", raw, strides=(1,))  # the eight bytes from each byte on
    hashes = mix64((eight[starts] & _KEPT[np.minimum(size, 8)]) + size.astype(U64) * U64(MULTIPLIER))
    left = np.flatnonzero((size > 8) & (size <= CHUNKED))
    for k in range(8, CHUNKED, 8):
        left = left[size[left] > k]
        if not len(left):
            break
        hashes[left] = mix64((hashes[left] ^ (eight[starts[left] + k] & _KEPT[np.minimum(size[left] - k, 8)])) + U64(MULTIPLIER))
    for k in np.flatnonzero(size > CHUNKED).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return starts, ends, hashes
