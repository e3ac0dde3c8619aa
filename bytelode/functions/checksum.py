"""CRC-32 and Adler-32 of concatenations from those of their parts."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

CRC_POLYNOMIAL, ADLER_BASE = 0xEDB88320, 65_521


def crc32(data: bytes) -> int:
    return zlib.crc32(data)


def adler32(data: bytes) -> int:
    return zlib.adler32(data)


def _times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2), bit-reflected, modulo the CRC polynomial."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


#: x**(8 * 2**k)
_POWERS = [1 << 23]
for _ in range(62):
    _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))


def crc32_shift(crc: int, after: int) -> int:
    """What a part's CRC gives to the whole's when ``after`` bytes follow it: the whole's is the exclusive or of all."""
    k = 0
    while after:
        if after & 1:
            crc = _times(_POWERS[k], crc)
        after >>= 1
        k += 1
    return crc


@lru_cache(None)
def _images(k: int) -> np.ndarray:
    """What multiplication by x**(8 * 2**k) makes of each of the 32 bits."""
    return np.array([_times(_POWERS[k], 1 << i) for i in range(32)], np.int64)


def crc32_shift_all(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """``crc32_shift`` of whole arrays of 64-bit integers: a step for each bit of the sizes."""
    crc = crc.copy()
    for k in range(int(after.max(initial=0)).bit_length()):
        some = np.flatnonzero(after >> k & 1)
        if len(some):
            own, out = crc[some], np.zeros(len(some), np.int64)
            for i, image in enumerate(_images(k)):
                out ^= (own >> i & 1) * image
            crc[some] = out
    return crc


def crc32_combine(first: int, second: int, second_size: int) -> int:
    return crc32_shift(first, second_size) ^ second


def adler32_combine(first: int, second: int, second_size: int) -> int:
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % ADLER_BASE
    b = (b1 + b2 + second_size * (a1 - 1)) % ADLER_BASE
    return b << 16 | a
