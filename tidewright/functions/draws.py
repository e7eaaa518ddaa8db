"""MD5 of numbered messages in arrays: the draws of a bootstrap, many at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Digits that vary within an array of messages.
LOW_DIGITS = 4


def _first_words(words: list, m: int) -> np.ndarray:
    """The first 32 bits of the digests of m messages of one block, as the number that eight hex digits say. words: 16
    numbers of the block, an array where messages differ."""
    a, b, c, d = (np.full(m, x, np.uint32) for x in _STATE)
    t = np.empty(m, np.uint32)
    for i in range(61):  # the last three steps don't change the first word any more
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        w = words[_PLACES[i]]
        if isinstance(w, int):
            t += np.uint32((_SINES[i] + w) & 0xFFFFFFFF)
        else:
            t += w
            t += np.uint32(_SINES[i])
        np.right_shift(t, 32 - _SHIFTS[i], out=a)
        t <<= np.uint32(_SHIFTS[i])
        t |= a
        t += b
        a, b, c, d, t = d, t, b, c, a
    b += np.uint32(_STATE[0])
    return b.byteswap()


def _tails(digits: int, start: int, stop: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers start, ..., stop - 1 in so many digits and the end mark, at a byte of a block's word: their part of that word and of the next."""
    text = np.zeros((stop - start, 8), np.uint8)
    x = np.arange(start, stop)
    for k in range(digits - 1, -1, -1):
        text[:, offset + k] = 48 + x % 10
        x = x // 10
    both = text.view("<u4")
    return both[:, 0].astype(np.uint32), both[:, 1].astype(np.uint32)


def md5_numbers(prefix: bytes, lo: int, hi: int) -> Iterable[np.ndarray]:
    """int(md5(prefix + str(d)).hexdigest()[:8], 16) for d = lo, ..., hi - 1, in arrays."""
    kept: dict = {}
    while lo < hi:
        digits = len(str(lo))
        low = min(digits, LOW_DIGITS)
        high, at = divmod(lo, 10**low)
        end = min(hi, high * 10**low + 10**low)
        fixed = prefix + (str(high).encode() if digits > low else b"")
        n = len(fixed) + low
        if n > 55:  # more than one block
            yield np.array([int(hashlib.md5(prefix + str(d).encode()).hexdigest()[:8], 16) for d in range(lo, end)], np.uint32)
        else:
            word, offset = divmod(len(fixed), 4)
            key = (low, at, end - lo, offset)
            if key not in kept:
                kept[key] = _tails(low, at, at + end - lo, offset)
            block = bytearray(64)
            block[: len(fixed)] = fixed
            block[n] = 0x80
            block[56:] = (8 * n).to_bytes(8, "little")
            words: list = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
            words[word] = kept[key][0] + np.uint32(words[word])
            if offset + low > 4:
                words[word + 1] = kept[key][1] + np.uint32(words[word + 1])
            yield _first_words(words, end - lo)
        lo = end
