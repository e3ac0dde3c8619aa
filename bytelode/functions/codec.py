"""Deflate streams: one-shot and in blocks, and back, with their checks."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from . import framing
from .options import WINDOW, CodecError, Options

RSYNC_BITS, RSYNC_MASK, RSYNC_HIT = 12, 0xFFF, 0x7FF


def deflate(data: bytes, level: int = 6, strategy: int = 0, window: bytes = b"", flush: int = zlib.Z_FINISH, memory: int = 8) -> bytes:
    """Raw deflate data; ``window`` is what precedes them, ``flush`` how they end."""
    args = (level, zlib.DEFLATED, -15, memory, strategy)
    c = zlib.compressobj(*args, zdict=window) if window else zlib.compressobj(*args)
    return c.compress(data) + c.flush(flush)


def deflate_part(data: bytes, opts: Options, window: bytes = b"", last: bool = True) -> bytes:
    """One block of a stream. Blocks that aren't the last end on a byte; independent ones forget what came before."""
    flush = zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH if opts.independent else zlib.Z_SYNC_FLUSH
    window = b"" if opts.independent else window[-WINDOW:]
    if opts.level == 11:
        return min((deflate(data, 9, s, window, flush, 9) for s in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED, zlib.Z_RLE)), key=len)
    return deflate(data, opts.zlib_level, opts.zlib_strategy, window, flush)


def rolling_cuts(data: bytes) -> np.ndarray:
    """Offsets after which content says to cut: where the hash of the last twelve bytes hits."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    h = np.zeros(len(b), np.int32)
    for k in range(min(RSYNC_BITS, len(b))):
        h[k:] ^= b[: len(b) - k] << k & RSYNC_MASK
    head = min(RSYNC_BITS, len(b))
    h[:head] ^= (RSYNC_HIT << np.arange(1, head + 1)) & RSYNC_MASK
    return np.flatnonzero(h == RSYNC_HIT) + 1


def pack_cuts(cuts: np.ndarray, size: int, block: int) -> list[int]:
    """Ends of blocks of about ``block`` bytes that end at cuts where there are any."""
    ends, at = [], 0
    while size - at > block:
        inside = cuts[np.searchsorted(cuts, at, "right") : np.searchsorted(cuts, at + block, "right")]
        if len(inside):
            at = int(inside[-1])
        else:
            later = np.searchsorted(cuts, at + block, "right")
            at = int(cuts[later]) if later < len(cuts) and cuts[later] < size else size
        ends.append(at)
    if not ends or ends[-1] < size:
        ends.append(size)
    return ends


def block_ends(data: bytes, opts: Options) -> list[int]:
    if opts.rsyncable:
        return pack_cuts(rolling_cuts(data), len(data), opts.block_size)
    return [*range(opts.block_size, len(data), opts.block_size), len(data)]


def compress(data: bytes, opts: Options = Options(), name: str = "", comment: str = "", mtime: int = 0) -> bytes:
    """A whole stream in the format of ``opts``."""
    name, mtime = name if opts.store_name else "", mtime if opts.store_time else 0
    head = framing.header(opts.format, opts.zlib_level, name, comment, mtime, opts.alias)
    if opts.independent or opts.rsyncable:
        ends = block_ends(data, opts)
        starts = [0, *ends[:-1]]
        body = b"".join(deflate_part(data[a:b], opts, data[max(0, a - WINDOW) : a], b == len(data) and k == len(ends) - 1) for k, (a, b) in enumerate(zip(starts, ends, strict=True)))
    else:
        body = deflate_part(data, opts)
    return head + body + framing.trailer(opts.format, zlib.crc32(data), zlib.adler32(data), len(data), len(body), head, mtime, name, opts.alias)


@dataclass
class Member:
    """One member of a stream, decoded."""

    number: int
    form: str
    name: str | None
    comment: str | None
    mtime: int
    comp_len: int
    raw: bytes
    check: int


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The deflate stream at ``at`` and where it ends."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise CodecError(f"corrupt deflate data: {e}") from None
    if not d.eof:
        raise CodecError("the compressed data end early")
    return out, len(data) - len(d.unused_data)


def members(data: bytes, form: str | None = None):
    """The members of a stream, each checked. ``form`` is needed for raw data only. Foreign bytes after a member end it."""
    form = form or framing.detect(data)
    if form is None:
        raise CodecError("no known format")
    if form == "raw":
        raw, end = _inflate(data, 0)
        yield Member(0, form, None, None, 0, end, raw, zlib.crc32(raw))
    elif form == "zlib":
        raw, end = _inflate(data, 2)
        if len(data) < end + 4:
            raise CodecError("the Adler-32 is missing")
        check = zlib.adler32(raw)
        if struct.unpack_from(">I", data, end)[0] != check:
            raise CodecError("Adler-32 mismatch")
        yield Member(0, form, None, None, 0, end - 2, raw, check)
    elif form == "zip":
        h = framing.parse_zip_local(data)
        raw, end = _inflate(data, h.data)
        check, comp = zlib.crc32(raw), end - h.data
        crc, comp_len, raw_len = h.crc, h.comp_len, h.raw_len
        if h.has_descriptor:
            at = end + 4 if data[end : end + 4] == b"PK\x07\x08" else end
            wide = h.zip64
            if len(data) < at + (20 if wide else 12):
                raise CodecError("the data descriptor is missing")
            crc, comp_len, raw_len = struct.unpack_from("<IQQ" if wide else "<III", data, at)
        if crc != check:
            raise CodecError("CRC-32 mismatch")
        if (comp_len, raw_len) != (comp, len(raw)):
            raise CodecError("length mismatch")
        yield Member(0, form, h.name, None, h.mtime, comp, raw, check)
    else:
        at = number = 0
        while True:
            h = framing.parse_gzip(data, at)
            raw, end = _inflate(data, h.data)
            if len(data) < end + 8:
                raise CodecError("the trailer is missing")
            crc, size = struct.unpack_from("<II", data, end)
            check = zlib.crc32(raw)
            if crc != check:
                raise CodecError("CRC-32 mismatch")
            if size != len(raw) & 0xFFFFFFFF:
                raise CodecError("length mismatch")
            yield Member(number, form, h.name, h.comment, h.mtime, end - h.data, raw, check)
            at, number = end + 8, number + 1
            if data[at : at + 3] != framing.GZIP + b"\x08":
                return


def decompress(data: bytes, which: str = "all", form: str | None = None) -> bytes:
    """The decoded bytes of all members, or of the first."""
    if which not in ("all", "first"):
        raise CodecError(f"members are all or first, not {which!r}")
    found = members(data, form)
    return next(found).raw if which == "first" else b"".join(m.raw for m in found)


def verify(data: bytes | None) -> tuple[bool, str | None]:
    """Whether a stream is whole, else what is wrong."""
    try:
        if data is None:
            return False, "null"
        for _ in members(data):
            pass
    except CodecError as e:
        return False, str(e)
    return True, None


def reduced(raw_len: int, comp_len: int) -> float:
    """Percent saved."""
    return 100.0 * (raw_len - comp_len) / raw_len if raw_len else 0.0


def inflate_exact(data: bytes, size: int) -> bytes:
    """Raw deflate data of a known decoded size."""
    out, _ = _inflate(data, 0)
    if len(out) != size:
        raise CodecError("the inflated size differs")
    return out
