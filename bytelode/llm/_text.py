"""Vectorised word kernels over Arrow string columns.

Every function works on a *flat* view: one uint8 buffer that holds all texts of a slice and the
int64 offsets of its rows. Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Texts handled together, in bytes. A longer row makes a slice of its own.
SLICE_BYTES = 1 << 20

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACE)] = False
#: Word class of lower-cased benchmark text: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(seed)) | np.uint64(1)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str):
    """Cuts a batch into runs of rows of about SLICE_BYTES of text each."""
    _, off = flat(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < len(off) - 1:
        end = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words of a flat buffer: byte spans, 64-bit hashes and the first word of each row."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE):
        inside = is_word[buf]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        if len(buf):
            starts_at, ends_at = offsets[:-1], offsets[1:]
            filled = ends_at > starts_at
            before[starts_at[filled]] = False
            after[ends_at[filled] - 1] = False
        self.buf, self.offsets, self.inside = buf, offsets, inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: words of row r: first[r] .. first[r + 1]
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word's bytes, read eight at a time."""
        size = self.end - self.start
        h = mix(size.astype(np.uint64) * _GOLD + np.uint64(seed))
        if not len(size):
            return h
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,), writeable=False) if len(padded) >= 8 else None
        at, left, live = self.start, size, None
        while True:
            part = eight[at] & _KEEP[np.minimum(left, 8)]
            if live is None:
                h = mix((h ^ part) * _M2 + _GOLD)
                keep = np.flatnonzero(left > 8)
            else:
                h[live] = mix((h[live] ^ part) * _M2 + _GOLD)
                keep = np.flatnonzero(left > 8)
            if not len(keep):
                return h
            live = keep if live is None else live[keep]
            at, left = at[keep] + 8, left[keep] - 8


def plain_words(col: pa.Array) -> Words:
    """Lower-cased (A-Z) words: runs of digits, letters and non-ASCII characters."""
    buf, off = flat(col)
    return Words(LOWER[buf], off, ALNUM)


def grams(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hashes of the n-grams that start at each word of a flat sequence (rows are not told apart)."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(k, np.uint64)
    for i, a in enumerate(odd_constants(n, seed)):
        out += words[i : i + k] * a
    return mix(out)


class Ranges:
    """Hashes of any span of a word-hash sequence in constant time (polynomial prefix sums mod 2**64)."""

    P = 0x9E3779B97F4A7C15 | 1
    INV = pow(P, -1, 1 << 64)
    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        if len(Ranges._power) < n:
            size = max(n, 1 << 16)
            for name, base in (("_power", self.P), ("_inverse", self.INV)):
                table = np.full(size, np.uint64(base))
                table[0] = 1
                setattr(Ranges, name, np.multiply.accumulate(table))
        self.sum = np.zeros(n, np.uint64)
        np.cumsum(words * Ranges._power[: n - 1], out=self.sum[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sum[end] - self.sum[start]) * Ranges._inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * _GOLD)


def spans_to_mask(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the half-open spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:n]) > 0


def union_of_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-open spans of rows, in order of row and start, with those that overlap or touch made one; bounds under 2**31."""
    if not len(row):
        return row, start, end
    low, high = (row << 32) + start, (row << 32) + end
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    opens = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
    last = np.concatenate([opens[1:], [len(low)]]) - 1
    return low[opens] >> 32, low[opens] & 0xFFFFFFFF, reach[last] & 0xFFFFFFFF


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
