"""Headers and trailers of gzip, zlib and single-entry ZIP streams."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from datetime import datetime, timezone

from .options import CodecError

GZIP, PK = b"\x1f\x8b", b"PK"
F_HCRC, F_EXTRA, F_NAME, F_COMMENT, F_RESERVED = 2, 4, 8, 16, 0xE0


@dataclass
class Header:
    """What a stream's header says, and where its deflate data begin."""

    form: str
    method: int
    data: int
    mtime: int = 0
    name: str | None = None
    comment: str | None = None
    has_descriptor: bool = False
    zip64: bool = False
    crc: int = 0
    comp_len: int = 0
    raw_len: int = 0


def unix_to_dos(seconds: int) -> int:
    """DOS date and time in UTC; 0 stays 0, and what lies before 1980 becomes its first day."""
    if not seconds:
        return 0
    t = datetime.fromtimestamp(seconds, timezone.utc)
    if t.year < 1980:
        return 1 << 21 | 1 << 16
    return (t.year - 1980) << 25 | t.month << 21 | t.day << 16 | t.hour << 11 | t.minute << 5 | t.second >> 1


def dos_to_unix(stamp: int) -> int | None:
    """Seconds since 1970 in UTC; none for 0 or no date."""
    if not stamp:
        return None
    try:
        t = datetime((stamp >> 25) + 1980, stamp >> 21 & 15, stamp >> 16 & 31, stamp >> 11 & 31, stamp >> 5 & 63, min(59, (stamp & 31) * 2), tzinfo=timezone.utc)
    except ValueError:
        return None
    return int(t.timestamp())


def zlib_head(level: int) -> bytes:
    effort = 3 if level >= 9 else 0 if level == 1 else 1 if level >= 6 or level == -1 else 2
    head = 0x7800 + (effort << 6)
    return struct.pack(">H", head + 31 - head % 31)


def header(form: str, level: int = -1, name: str = "", comment: str = "", mtime: int = 0, alias: str = "-") -> bytes:
    if form == "raw":
        return b""
    if form == "zlib":
        return zlib_head(level)
    if form == "gzip":
        flags = F_NAME * bool(name) | F_COMMENT * bool(comment)
        tail = b"".join(x.encode("utf-8").replace(b"\0", b"") + b"\0" for x in (name, comment) if x)
        return struct.pack("<2sBBIBB", GZIP, 8, flags, mtime & 0xFFFFFFFF, 2 if level >= 9 else 4 if level == 1 else 0, 3) + tail
    own = (name or alias).encode("utf-8")
    local = struct.pack("<IHHHIIIIHH", 0x04034B50, 45, 8, 8, unix_to_dos(mtime), 0, 0xFFFFFFFF, 0xFFFFFFFF, len(own), 29)
    return local + own + struct.pack("<HHQQ", 1, 16, 0, 0) + struct.pack("<HHBI", 0x5455, 5, 1, mtime & 0xFFFFFFFF)


def trailer(form: str, crc: int, adler: int, raw_len: int, comp_len: int = 0, head: bytes = b"", mtime: int = 0, name: str = "", alias: str = "-") -> bytes:
    if form == "raw":
        return b""
    if form == "zlib":
        return struct.pack(">I", adler)
    if form == "gzip":
        return struct.pack("<II", crc, raw_len & 0xFFFFFFFF)
    own = (name or alias).encode("utf-8")
    big = raw_len >= 0xFFFFFFFF or comp_len >= 0xFFFFFFFF
    wide = struct.pack("<HHQQ", 1, 16, raw_len, comp_len) if big else b""
    stamp = struct.pack("<HHBI", 0x5455, 5, 1, mtime & 0xFFFFFFFF)
    sizes = (0xFFFFFFFF, 0xFFFFFFFF) if big else (comp_len, raw_len)
    central = struct.pack("<IBBHHHIIIIHHHHHII", 0x02014B50, 45, 3, 45, 8, 8, unix_to_dos(mtime), crc, *sizes, len(own), len(wide + stamp), 0, 0, 0, 0, 0) + own + wide + stamp
    descriptor = struct.pack("<IIQQ", 0x08074B50, crc, comp_len, raw_len)
    at = len(head) + comp_len + len(descriptor)
    return descriptor + central + directory_end(1, len(central), at, b"")


def directory_end(entries: int, size: int, at: int, comment: bytes) -> bytes:
    """The end of a ZIP's central directory, with the 64-bit one before it where numbers ask for it."""
    out = b""
    if entries > 0xFFFE or size >= 0xFFFFFFFF or at >= 0xFFFFFFFF:
        out = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, entries, entries, size, at) + struct.pack("<IIQI", 0x07064B50, 0, at + size, 1)
    return out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(entries, 0xFFFF), min(entries, 0xFFFF), min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF), len(comment)) + comment


def detect(data: bytes) -> str | None:
    """gzip, zlib, zip, or none: zlib's check comes first."""
    if len(data) < 2:
        return None
    magic = data[0] << 8 | data[1]
    if magic % 31 == 0 and magic & 0x8F20 == 0x0800:
        return "zlib"
    return "zip" if data[:2] == PK else "gzip" if data[:2] == GZIP else None


def _need(data: bytes, end: int) -> None:
    if end > len(data):
        raise CodecError("the header ends early")


def _cstring(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\0", at)
    if end < 0:
        raise CodecError("the header ends early")
    return data[at:end].decode("utf-8", "replace"), end + 1


def parse_gzip(data: bytes, at: int = 0) -> Header:
    _need(data, at + 10)
    if data[at : at + 2] != GZIP:
        raise CodecError("no gzip magic")
    method, flags, stamp = data[at + 2], data[at + 3], struct.unpack_from("<i", data, at + 4)[0]
    if flags & F_RESERVED:
        raise CodecError("reserved gzip flags are set")
    if method != 8:
        raise CodecError(f"unknown compression method {method}")
    out, p = Header("gzip", method, 0, stamp), at + 10
    if flags & F_EXTRA:
        _need(data, p + 2)
        p += 2 + struct.unpack_from("<H", data, p)[0]
        _need(data, p)
    if flags & F_NAME:
        out.name, p = _cstring(data, p)
    if flags & F_COMMENT:
        out.comment, p = _cstring(data, p)
    if flags & F_HCRC:
        _need(data, p + 2)
        if struct.unpack_from("<H", data, p)[0] != zlib.crc32(data[at:p]) & 0xFFFF:
            raise CodecError("gzip header CRC mismatch")
        p += 2
    out.data = p
    return out


def parse_zip_local(data: bytes) -> Header:
    """The first entry of a ZIP stream, read from its front."""
    _need(data, 30)
    kind, flags, method, stamp, crc, comp_len, raw_len, name_len, extra_len = struct.unpack_from("<I2xHHIIIIHH", data)
    if kind != 0x04034B50:
        raise CodecError("no ZIP entry")
    if flags & 0xF7F0:
        raise CodecError("unknown ZIP flags")
    if flags & 1 or method != 8:
        raise CodecError("encrypted, or an unknown compression method")
    at = 30 + name_len
    _need(data, at + extra_len)
    out = Header("zip", method, at + extra_len, dos_to_unix(stamp) or 0, data[30:at].decode("utf-8", "replace"), None, bool(flags & 8), False, crc, comp_len, raw_len)
    for kind, body in extras(data[at : at + extra_len]):
        if kind == 1 and len(body) >= 16:
            out.zip64 = True
            out.raw_len, out.comp_len = struct.unpack_from("<QQ", body)
        elif kind == 0x5455 and len(body) >= 5 and body[0] & 1:
            out.mtime = struct.unpack_from("<i", body, 1)[0]
    return out


def extras(data: bytes):
    at = 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + size]
        at += 4 + size
