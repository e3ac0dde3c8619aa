"""The codecs as column functions. Binary columns cross to Python as Arrow arrays; what SQL can say stays in the JVM."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checksum, codec, png
from .archive import pack_member
from .options import DEFAULT_BLOCK, CodecError, Options

_KINDS = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "struct<ok: boolean, error: string>": pa.struct([("ok", pa.bool_()), ("error", pa.string())]), "struct<data: binary, error: string>": pa.struct([("data", pa.binary()), ("error", pa.string())]), "struct<method: int, stored: binary, crc: long>": pa.struct([("method", pa.int32()), ("stored", pa.binary()), ("crc", pa.int64())]), "struct<width: int, height: int, channels: int, pixels: binary>": pa.struct([("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary())])}


def arrow_function(kind: str, f: Callable, *columns: Column | str, null_in: bool = False) -> Column:
    """``f`` on the values of each row; a null first value gives null unless ``f`` takes it."""
    out = _KINDS[kind]

    def run(*arrays: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in arrays), strict=True)
        return pa.array([None if r[0] is None and not null_in else f(*r) for r in rows], out)

    return F.arrow_udf(run, kind)(*columns)


def compress(content: Column | str, opts: Options = Options(), name: Column | None = None, comment: Column | None = None, mtime: Column | None = None) -> Column:
    """A whole stream of each value."""
    empty, zero = F.lit(""), F.lit(0).cast("long")
    return arrow_function("binary", lambda c, n, m, t: codec.compress(c, opts, n or "", m or "", t or 0), content, empty if name is None else name, empty if comment is None else comment, zero if mtime is None else mtime)


def gzip_compress(content: Column | str, level: int = 6, engine: str = "auto", **columns: Column) -> Column:
    return compress(content, Options(level=level, engine=engine), **columns)


def zlib_compress(content: Column | str, level: int = 6, strategy: str = "default", engine: str = "auto") -> Column:
    return compress(content, Options(level=level, strategy=strategy, engine=engine, format="zlib"))


def raw_deflate(content: Column | str, level: int = 6, strategy: str = "default") -> Column:
    return compress(content, Options(level=level, strategy=strategy, format="raw"))


def inflate_auto(content: Column | str, members: str = "all") -> Column:
    """The decoded bytes of gzip, zlib or single-entry ZIP streams; an error fails the query."""
    return arrow_function("binary", lambda c: codec.decompress(c, members), content)


def inflate_raw(content: Column | str) -> Column:
    return arrow_function("binary", lambda c: codec.decompress(c, form="raw"), content)


def inflate_part(content: Column | str) -> Column:
    """One independent block of raw deflate data, which need not be a stream's last."""
    return arrow_function("binary", lambda c: zlib.decompressobj(-15).decompress(c), content)


def _tried(f: Callable, *args) -> dict:
    try:
        return {"data": f(*args), "error": None}
    except CodecError as e:
        return {"data": None, "error": str(e)}


def try_inflate(content: Column | str, members: str = "all") -> Column:
    """The decoded bytes or the error."""
    return arrow_function("struct<data: binary, error: string>", lambda c: _tried(codec.decompress, c, members), content)


def verify(content: Column | str) -> Column:
    """Whether a stream is whole, and what is wrong."""
    return arrow_function("struct<ok: boolean, error: string>", lambda c: dict(zip(("ok", "error"), codec.verify(c), strict=True)), content, null_in=True)


def deflate_block(raw: Column | str, window: Column | str, is_last: Column | str, opts: Options = Options()) -> Column:
    return arrow_function("binary", lambda r, w, last: codec.deflate_part(r, opts, w or b"", last), raw, window, is_last)


def rolling_cuts(content: Column | str) -> Column:
    return arrow_function("array<int>", lambda c: codec.rolling_cuts(c).tolist(), content)


def block_ends(content: Column | str, opts: Options) -> Column:
    return arrow_function("array<int>", lambda c: codec.block_ends(c, opts), content)


def adler32(content: Column | str) -> Column:
    return arrow_function("long", checksum.adler32, content)


def crc32_shift(crc: Column | str, after: Column | str) -> Column:
    """A part's share in the CRC-32 of the whole, ``after`` bytes before its end; bit_xor adds the shares."""

    def run(crcs: pa.Array, sizes: pa.Array) -> pa.Array:
        null = np.asarray(crcs.is_null()) | np.asarray(sizes.is_null())
        out = checksum.crc32_shift_all(*(a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (crcs, sizes)))
        return pa.array(out, mask=null)

    return F.arrow_udf(run, "long")(crc, after)


def adaptive_block(size: Column, threads: int, largest: int = 2 << 20) -> Column:
    """The block size for a blob (int): ``options.adaptive_block`` in SQL."""
    block, out = largest, F.lit(DEFAULT_BLOCK)
    sizes = []
    while block > DEFAULT_BLOCK:
        sizes.append(block)
        block //= 2
    for b in reversed(sizes):
        out = F.when(F.floor(size / b) >= 4 * max(1, threads), b).otherwise(out)
    return out.cast("int")


def thread_cap(size: Column, block: Column, threads: int) -> Column:
    """As many threads as have two blocks each (int): ``options.thread_cap`` in SQL."""
    return F.least(F.lit(max(1, threads)), F.greatest(F.lit(1), F.floor(size / (block * 2)))).cast("int")


def adler32_total(adler: Column, after: Column) -> Column:
    """The Adler-32 of a whole from those of its parts in any order, as an aggregate."""
    base = checksum.ADLER_BASE
    low, high = adler % 65536, F.shiftright(adler, 16)
    a = (F.sum(low - 1) + 1) % base
    b = F.sum((high + (after % base) * (low - 1)) % base) % base
    return F.pmod(b, F.lit(base)) * 65536 + F.pmod(a, F.lit(base))


def little_endian(content: Column, at: int | Column, size: int) -> Column:
    """An unsigned number of up to seven bytes at an offset."""
    start = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.concat(*(F.hex(content.substr(start + 1 + k, F.lit(1))) for k in reversed(range(size)))), 16, 10).cast("long")


def pack_little_endian(value: Column, size: int) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(value, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size))))


def pack_big_endian(value: Column, size: int) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(value, 8 * k).bitwiseAND(255)), 2, "0") for k in reversed(range(size)))))


def gzip_isize(content: Column) -> Column:
    """The decoded size that a gzip trailer claims (null: too short, or no gzip)."""
    n = F.octet_length(content)
    return F.when((n >= 18) & (content.substr(1, 2) == F.unhex(F.lit("1F8B"))), little_endian(content, n - 4, 4))


def detect_format(content: Column) -> Column:
    """gzip, zlib or zip by the first two bytes; null for none."""
    magic = F.conv(F.hex(content.substr(1, 2)), 16, 10).cast("int")
    known = F.when((magic % 31 == 0) & (magic.bitwiseAND(0x8F20) == 0x0800), "zlib").when(magic == 0x504B, "zip").when(magic == 0x1F8B, "gzip")
    return F.when(F.octet_length(content) >= 2, known)


def unix_to_dos(t: Column) -> Column:
    """DOS date and time of a timestamp, in the session's time zone; two-second steps."""
    parts = ((F.year(t) - 1980, 25), (F.month(t), 21), (F.dayofmonth(t), 16), (F.hour(t), 11), (F.minute(t), 5), (F.floor(F.second(t) / 2).cast("int"), 0))
    out = F.lit(0).cast("long")
    for v, k in parts:
        out = out + F.shiftleft(v.cast("long"), k)
    return F.when(F.year(t) >= 1980, out)


def dos_to_unix(stamp: Column) -> Column:
    """The timestamp of a DOS date and time; null for 0."""

    def bits(k: int, n: int) -> Column:
        return F.shiftright(stamp, k).bitwiseAND((1 << n) - 1).cast("int")

    return F.when(stamp != 0, F.make_timestamp(bits(25, 7) + 1980, bits(21, 4), bits(16, 5), bits(11, 5), bits(5, 6), (bits(0, 5) * 2).cast("decimal(16,6)")))


def zip_pack(content: Column | str, name: Column | str, compress_type: Column | str, level: Column | str, opts: Options = Options()) -> Column:
    """(method, stored, crc) of a member; null types and levels are those of the options."""

    def packed(c, n, kind, own):
        return dict(zip(("method", "stored", "crc"), pack_member(c, n, 8 if kind is None else kind, opts if own is None else replace(opts, level=own)), strict=True))

    return arrow_function("struct<method: int, stored: binary, crc: long>", packed, content, name, compress_type, level)


def png_encode(pixels: Column | str, width: Column | str, height: Column | str, channels: Column | str, **options) -> Column:
    return arrow_function("binary", lambda p, w, h, c: png.encode(p, w, h, c, **options), pixels, width, height, channels)


def png_decode(content: Column | str) -> Column:
    return arrow_function("struct<width: int, height: int, channels: int, pixels: binary>", lambda c: dict(zip(("width", "height", "channels", "pixels"), png.decode(c), strict=True)), content)
