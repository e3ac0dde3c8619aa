"""8-bit PNG images with one to four channels."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .options import STRATEGIES, CodecError

SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOR_OF, CHANNELS_OF = {1: 0, 2: 4, 3: 2, 4: 6}, {0: 1, 4: 2, 2: 3, 6: 4}
FILTERS = {"none": 0, "sub": 1, "up": 2, "average": 3, "paeth": 4, "adaptive-fast": 5, "adaptive-all": 6}
#: level, strategy, filter
PRESETS = {"fast": (1, "rle", "up"), "balanced": (1, "rle", "adaptive-fast"), "small": (9, "filtered", "adaptive-all"), "": (1, "rle", "up")}
IDAT_SIZE = 1 << 20


def preset(name: str = "fast", level: int | None = None, strategy: str | None = None, filter: str | None = None) -> tuple[int, str, str]:
    """Options of a preset, with those that are given in their place."""
    if name not in PRESETS:
        raise CodecError(f"unknown preset {name!r}")
    own = PRESETS[name]
    out = (own[0] if level is None else level, own[1] if strategy is None else strategy, own[2] if filter is None else filter)
    if not -1 <= out[0] <= 9:
        raise CodecError(f"level {out[0]}: -1 to 9")
    if out[1] not in STRATEGIES:
        raise CodecError(f"unknown strategy {out[1]!r}")
    if out[2] not in FILTERS:
        raise CodecError(f"unknown filter {out[2]!r}")
    return out


def predict_paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The neighbour nearest to left + up - corner; ties go left, then up."""
    a, b = np.abs(up - corner), np.abs(left - corner)
    c = np.abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filtered(rows: np.ndarray, channels: int, kinds: tuple[int, ...] = (0, 1, 2, 3, 4)) -> np.ndarray:
    """Each row (height by bytes) under each filter: kinds by height by bytes."""
    x = rows.astype(np.int16)
    up = np.vstack([np.zeros_like(x[:1]), x[:-1]])
    left = np.hstack([np.zeros((len(x), channels), np.int16), x[:, :-channels]]) if x.shape[1] > channels else np.zeros_like(x)
    corner = np.vstack([np.zeros_like(x[:1]), left[:-1]])
    guess = {0: lambda: 0, 1: lambda: left, 2: lambda: up, 3: lambda: (left + up) >> 1, 4: lambda: predict_paeth(left, up, corner)}
    return np.stack([(x - guess[k]()).astype(np.uint8) for k in kinds])


def scores(filtered_rows: np.ndarray) -> np.ndarray:
    """Sum of distances from zero, bytes taken as signed."""
    v = filtered_rows.astype(np.int64)
    return np.minimum(v, 256 - v).sum(-1)


def choose(pixels: bytes, width: int, height: int, channels: int, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """The filter of each row and the rows under it; the lowest score, of equal ones the lowest number."""
    rows = np.frombuffer(pixels, np.uint8).reshape(height, width * channels)
    number = FILTERS[mode]
    kinds = (0, 1, 2) if number == 5 else (0, 1, 2, 3, 4) if number == 6 else (number,)
    all_ = filtered(rows, channels, kinds)
    best = np.argmin(scores(all_), 0)
    return np.array(kinds)[best], all_[best, np.arange(height)]


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: bytes | None, width: int, height: int, channels: int, preset_name: str = "fast", level: int | None = None, strategy: str | None = None, filter: str | None = None, idat_chunk_size: int = 0) -> bytes:
    level, strategy, filter = preset(preset_name, level, strategy, filter)
    if pixels is None:
        raise CodecError("no pixels")
    if width <= 0 or height <= 0:
        raise CodecError("an image has no zero dimension")
    if channels not in COLOR_OF:
        raise CodecError(f"{channels} channels: 1 to 4")
    if len(pixels) != width * height * channels:
        raise CodecError("pixels don't match the shape")
    kinds, rows = choose(pixels, width, height, channels, filter)
    c = zlib.compressobj(level, zlib.DEFLATED, 15, 8, STRATEGIES[strategy])
    body = c.compress(np.hstack([kinds[:, None].astype(np.uint8), rows]).tobytes()) + c.flush()
    size = idat_chunk_size or IDAT_SIZE
    parts = b"".join(chunk(b"IDAT", body[i : i + size]) for i in range(0, len(body), size))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, COLOR_OF[channels], 0, 0, 0)) + parts + chunk(b"IEND", b"")


def encode_array(a: np.ndarray, **options) -> bytes:
    """An image from rows by columns, or rows by columns by channels, of bytes."""
    if a.dtype != np.uint8 or a.ndim not in (2, 3) or not a.flags.c_contiguous:
        raise CodecError("a contiguous array of bytes with two or three dimensions is needed")
    return encode(a.tobytes(), a.shape[1], a.shape[0], 1 if a.ndim == 2 else a.shape[2], **options)


def chunks(data: bytes):
    """(type, data, CRC) of each chunk, checked."""
    if data[:8] != SIGNATURE:
        raise CodecError("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise CodecError("truncated chunk")
        size = struct.unpack_from(">I", data, at)[0]
        if at + 12 + size > len(data):
            raise CodecError("truncated chunk")
        kind, body, crc = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], struct.unpack_from(">I", data, at + 8 + size)[0]
        if zlib.crc32(kind + body) != crc:
            raise CodecError("chunk CRC mismatch")
        yield kind, body, crc
        at += 12 + size


def unfilter(rows: np.ndarray, kinds: np.ndarray, channels: int) -> np.ndarray:
    """Rows as they were before their filters."""
    height, n = rows.shape
    out = np.zeros((height, n), np.uint8)
    above = np.zeros(n, np.int64)
    for r in range(height):
        x, kind = rows[r].astype(np.int64), int(kinds[r])
        if kind == 1:
            x = np.cumsum(x.reshape(-1, channels), 0).ravel()
        elif kind == 2:
            x = x + above
        elif kind == 3:
            for i in range(0, n, channels):
                left = x[i - channels : i] if i else 0
                x[i : i + channels] = (x[i : i + channels] + (left + above[i : i + channels]) // 2) & 255
        elif kind == 4:
            zero = np.zeros(channels, np.int64)
            for i in range(0, n, channels):
                left, corner = (x[i - channels : i], above[i - channels : i]) if i else (zero, zero)
                x[i : i + channels] = (x[i : i + channels] + predict_paeth(left, above[i : i + channels], corner)) & 255
        elif kind:
            raise CodecError(f"bad filter {kind}")
        out[r] = x & 255
        above = out[r].astype(np.int64)
    return out


def decode(data: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, channels, pixels). Chunks of other kinds are checked and skipped."""
    shape, body, ended = None, [], False
    for kind, own, _ in chunks(data):
        if ended:
            raise CodecError("data after the end")
        if kind == b"IHDR":
            if shape is not None:
                raise CodecError("two headers")
            if len(own) != 13:
                raise CodecError("bad header size")
            width, height, depth, color, method, filter_method, interlace = struct.unpack(">IIBBBBB", own)
            if depth != 8 or interlace or method or filter_method or color not in CHANNELS_OF:
                raise CodecError("only 8-bit images without interlace or palette")
            if not width or not height:
                raise CodecError("an image has no zero dimension")
            shape = (width, height, CHANNELS_OF[color])
        elif shape is None:
            raise CodecError("the header isn't first")
        elif kind == b"IDAT":
            body.append(own)
        elif kind == b"IEND":
            if own:
                raise CodecError("the end has data")
            ended = True
    if shape is None or not ended or not body:
        raise CodecError("incomplete image")
    width, height, channels = shape
    d = zlib.decompressobj()
    try:
        raw = d.decompress(b"".join(body))
    except zlib.error as e:
        raise CodecError(f"corrupt image data: {e}") from None
    if not d.eof or len(raw) != height * (1 + width * channels):
        raise CodecError("image data of another size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return width, height, channels, unfilter(lines[:, 1:], lines[:, 0], channels).tobytes()


def decode_array(data: bytes) -> np.ndarray:
    w, h, c, p = decode(data)
    a = np.frombuffer(p, np.uint8)
    return a.reshape(h, w) if c == 1 else a.reshape(h, w, c)
