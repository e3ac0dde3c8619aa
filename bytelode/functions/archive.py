"""ZIP archives: records, catalogs and members."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from . import codec, framing
from .options import CodecError, Options

STORE, DEFLATE = 0, 8
FILE_ATTR, DIR_ATTR = 0o100644 << 16, 0o40755 << 16 | 0x10
LIMIT32, UTF8 = 0xFFFFFFFF, 0x800
#: The end of a directory with the longest comment, and the 64-bit records before it.
TAIL = 22 + 0xFFFF + 20 + 56


@dataclass
class Entry:
    """A member's row of the catalog."""

    ordinal: int
    filename: str
    file_size: int
    compress_size: int
    crc: int
    compress_type: int
    mtime: int | None
    comment: bytes
    external_attr: int
    header_offset: int

    @property
    def is_dir(self) -> bool:
        return self.filename.endswith("/")


def pack_member(data: bytes, name: str, compress_type: int = DEFLATE, opts: Options = Options()) -> tuple[int, bytes, int]:
    """(method, stored bytes, CRC): stored where it is a folder, empty, wanted so, or no smaller deflated."""
    crc = zlib.crc32(data)
    if compress_type not in (STORE, DEFLATE):
        raise CodecError(f"unknown compression type {compress_type}")
    if name.endswith("/") or not data or compress_type == STORE:
        return STORE, data, crc
    packed = codec.deflate_part(data, opts)
    return (STORE, data, crc) if len(packed) >= len(data) else (DEFLATE, packed, crc)


def local_header(name: str, method: int, mtime: int, crc: int, comp: int, raw: int) -> bytes:
    own = name.encode("utf-8")
    wide = comp >= LIMIT32 or raw >= LIMIT32
    extra = struct.pack("<HHQQ", 1, 16, raw, comp) if wide else b""
    sizes = (LIMIT32, LIMIT32) if wide else (comp, raw)
    return struct.pack("<IHHHIIIIHH", 0x04034B50, 45 if wide else 20, UTF8, method, framing.unix_to_dos(mtime), crc, *sizes, len(own), len(extra)) + own + extra


def central_header(name: str, method: int, mtime: int, crc: int, comp: int, raw: int, offset: int, comment: bytes = b"", attr: int | None = None) -> bytes:
    own = name.encode("utf-8")
    attr = (DIR_ATTR if name.endswith("/") else FILE_ATTR) if attr is None else attr
    large = [v for v in (raw, comp, offset) if v >= LIMIT32]
    extra = struct.pack(f"<HH{len(large)}Q", 1, 8 * len(large), *large) if large else b""
    short = [min(v, LIMIT32) for v in (comp, raw)]
    return struct.pack("<IBBHHHIIIIHHHHHII", 0x02014B50, 45, 3, 45 if large else 20, UTF8, method, framing.unix_to_dos(mtime), crc, *short, len(own), len(extra), len(comment), 0, 0, attr, min(offset, LIMIT32)) + own + extra + comment


def build(members: list[tuple[str, bytes, int]], opts: Options = Options(), mtime: int = 315532800, comment: bytes = b"") -> bytes:
    """A whole archive of (name, data, compression type)."""
    out, central, at = [], [], 0
    for name, data, kind in members:
        method, stored, crc = pack_member(data, name, kind, opts)
        head = local_header(name, method, mtime, crc, len(stored), len(data))
        central.append(central_header(name, method, mtime, crc, len(stored), len(data), at))
        out += [head, stored]
        at += len(head) + len(stored)
    directory = b"".join(central)
    return b"".join(out) + directory + framing.directory_end(len(central), len(directory), at, comment)


class NeedsMore(Exception):
    """The directory, or the record that tells of it, begins at ``at``, before the bytes at hand."""

    def __init__(self, at: int, is_directory: bool = True):
        self.at, self.is_directory = at, is_directory


def directory(data: bytes, gap: int = 0) -> tuple[int, int, int, bytes]:
    """The number of entries, where the directory begins in the archive and ends at most in ``data``, and the comment.

    ``data`` may be the end of an archive that has ``gap`` bytes before it; NeedsMore tells where to begin instead.
    """
    if len(data) < 22:
        raise CodecError("too small for an archive")
    low = max(0, len(data) - 22 - 0xFFFF)
    at = len(data)
    while True:
        at = data.rfind(b"PK\x05\x06", low, at)
        if at < 0:
            raise CodecError("no end of a central directory")
        if at + 22 <= len(data) and at + 22 + struct.unpack_from("<H", data, at + 20)[0] <= len(data):
            break
        at += 3
    n, size, begin, comment_len = struct.unpack_from("<10xHIIH", data, at)
    comment = data[at + 22 : at + 22 + comment_len]
    end = at
    if at >= 20 and data[at - 20 : at - 16] == b"PK\x06\x07" and (n == 0xFFFF or size == LIMIT32 or begin == LIMIT32):
        wide = struct.unpack_from("<Q", data, at - 12)[0] - gap
        if wide < 0:
            raise NeedsMore(wide + gap, False)
        if data[wide : wide + 4] != b"PK\x06\x06" or wide + 56 > len(data):
            raise CodecError("bad 64-bit end of the central directory")
        n, size, begin = struct.unpack_from("<QQQ", data, wide + 32)
        end = wide
    if begin - gap > end:
        raise CodecError("the central directory overruns the archive")
    if begin < gap:
        raise NeedsMore(begin)
    return n, begin, end, comment


def directory_start(tail: bytes, gap: int) -> int:
    """Where what ``catalog`` needs begins, told from the last TAIL bytes of an archive with ``gap`` bytes before them."""
    try:
        return directory(tail, gap)[1]
    except NeedsMore as e:
        return e.at if e.is_directory else 0


def catalog(data: bytes, gap: int = 0) -> tuple[list[Entry], int, bytes]:
    """Entries in the directory's order, where it begins, and the archive's comment. ``gap`` as for ``directory``."""
    n, begin, end, comment = directory(data, gap)
    entries, p = [], begin - gap
    for k in range(n):
        if p + 46 > end or data[p : p + 4] != b"PK\x01\x02":
            raise CodecError("corrupt central directory")
        method, stamp, crc, comp, raw, name_len, extra_len, own_len, attr, offset = struct.unpack_from("<10xHIIIIHHH4xII", data, p)
        if p + 46 + name_len + extra_len + own_len > end:
            raise CodecError("the central directory overruns its end")
        p += 46
        name = data[p : p + name_len].decode("utf-8", "replace")
        for kind, body in framing.extras(data[p + name_len : p + name_len + extra_len]):
            if kind == 1:
                wide = [struct.unpack_from("<Q", body, i)[0] for i in range(0, len(body) // 8 * 8, 8)]
                raw = wide.pop(0) if raw == LIMIT32 and wide else raw
                comp = wide.pop(0) if comp == LIMIT32 and wide else comp
                offset = wide.pop(0) if offset == LIMIT32 and wide else offset
        p += name_len + extra_len
        entries.append(Entry(k, name, raw, comp, crc, method, framing.dos_to_unix(stamp), data[p : p + own_len], attr, offset))
        p += own_len
    return entries, begin, comment


def stored_member(data: bytes, e: Entry) -> bytes:
    """A member's bytes as they lie in the archive."""
    if data[e.header_offset : e.header_offset + 4] != b"PK\x03\x04" or e.header_offset + 30 > len(data):
        raise CodecError(f"bad local header of {e.filename}")
    name_len, extra_len = struct.unpack_from("<HH", data, e.header_offset + 26)
    at = e.header_offset + 30 + name_len + extra_len
    stored = data[at : at + e.compress_size]
    if len(stored) != e.compress_size:
        raise CodecError(f"{e.filename} ends early")
    return stored


def read_member(data: bytes, e: Entry) -> bytes:
    """A member's bytes, checked."""
    stored = stored_member(data, e)
    if e.compress_type == STORE:
        out = stored
        if len(out) != e.file_size:
            raise CodecError("the stored size differs")
    elif e.compress_type == DEFLATE:
        out = codec.inflate_exact(stored, e.file_size)
    else:
        raise CodecError(f"unsupported method {e.compress_type}")
    if zlib.crc32(out) != e.crc:
        raise CodecError(f"CRC-32 mismatch in {e.filename}")
    return out


def first_bad(data: bytes) -> str | None:
    """The first member, folders aside, that can't be read."""
    for e in catalog(data)[0]:
        if not e.is_dir:
            try:
                read_member(data, e)
            except CodecError:
                return e.filename
    return None
