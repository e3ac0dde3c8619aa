"""Pure functions, held against the standard library's codecs."""

import gzip
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from bytelode.functions import archive, checksum, codec, framing, png
from bytelode.functions.options import FORMATS, CodecError, Options, adaptive_block, fast_level, thread_cap

LINES = "".join(f"Line {i}: some repetitive test data for compression.\n" for i in range(5000)).encode()
RANDOM = random.Random(0).randbytes(200_000)
CASES = {"empty": b"", "short": b"Hello, World!\n", "lines": LINES, "random": RANDOM, "long line": b"A" * 99_900, "byte": b"x"}


@pytest.mark.parametrize("form", FORMATS)
@pytest.mark.parametrize("fields", [{}, {"level": 0}, {"level": 1}, {"level": 9}, {"level": 11}, {"independent": True}, {"rsyncable": True}, {"strategy": "huffman"}, {"strategy": "fixed"}, {"engine": "isal"}])
@pytest.mark.parametrize("case", CASES)
def test_round_trip(form, fields, case):
    data, opts = CASES[case], Options(format=form, **fields)
    packed = codec.compress(data, opts, "n.txt", "said", 1_700_000_000)
    assert codec.decompress(packed, form="raw" if form == "raw" else None) == data
    if form == "gzip":
        assert gzip.decompress(packed) == data
    elif form == "zlib":
        assert zlib.decompress(packed) == data
    elif form == "zip":
        z = zipfile.ZipFile(io.BytesIO(packed))
        assert z.testzip() is None and z.read("n.txt") == data
    else:
        assert zlib.decompress(packed, -15) == data


def test_reads_foreign_streams():
    for data in CASES.values():
        assert codec.decompress(gzip.compress(data)) == data and codec.decompress(zlib.compress(data)) == data


def test_levels_order_sizes():
    size = {k: len(codec.compress(LINES, Options(level=k))) for k in (0, 1, 9, 11)}
    assert size[11] <= size[9] + 8 and size[9] <= size[1] < size[0] and size[0] > 4 * size[9]


def test_members():
    two = codec.compress(b"one", Options(), "a") + gzip.compress(b"two")
    assert codec.decompress(two) == b"onetwo" and codec.decompress(two, "first") == b"one"
    assert codec.decompress(two + b"\0trailing") == b"onetwo"
    # a zlib or ZIP header behind a gzip member is foreign too
    assert codec.decompress(gzip.compress(b"one") + zlib.compress(b"two")) == b"one"
    assert [m.name for m in codec.members(two)] == ["a", None]
    with pytest.raises(CodecError):
        codec.decompress(two, "second")


@pytest.mark.parametrize(("data", "what"), [(b"not gzip data", "no known format"), (b"", "no known format"), (b"\x1f\x8b\x08", "ends early"), (b"\x1f\x8b\x09" + bytes(20), "method"), (b"\x1f\x8b\x08\xe0" + bytes(20), "reserved"), (gzip.compress(LINES)[:-20], "early"), (gzip.compress(LINES)[:-3], "trailer"), (zlib.compress(LINES)[:-2], "Adler"), (b"\x78\x9c\xff\xff\xff", "corrupt|early")])
def test_errors(data, what):
    with pytest.raises(CodecError, match=what):
        codec.decompress(data)
    ok, error = codec.verify(data)
    assert not ok and error


def test_corrupt_trailers():
    packed = bytearray(gzip.compress(LINES))
    for at, what in ((-8, "CRC"), (-1, "length")):
        bad = bytearray(packed)
        bad[at] ^= 1
        with pytest.raises(CodecError, match=what):
            codec.decompress(bytes(bad))
    bad = bytearray(zlib.compress(LINES))
    bad[-1] ^= 1
    with pytest.raises(CodecError, match="Adler"):
        codec.decompress(bytes(bad))
    assert codec.verify(bytes(packed)) == (True, None) and codec.verify(None)[0] is False


def test_gzip_header():
    head = framing.header("gzip", 9, "test.txt", "said", 1_700_000_000)
    h = framing.parse_gzip(head + b"rest")
    assert (h.name, h.comment, h.mtime, h.data, head[8]) == ("test.txt", "said", 1_700_000_000, len(head), 2)
    extra = b"\x1f\x8b\x08\x06" + bytes(6) + struct.pack("<H", 3) + b"abc"
    assert framing.parse_gzip(extra + struct.pack("<H", zlib.crc32(extra) & 0xFFFF)).data == len(extra) + 2
    with pytest.raises(CodecError, match="CRC"):
        framing.parse_gzip(extra + b"\0\0")
    assert framing.parse_gzip(framing.header("gzip", mtime=-5)).mtime == -5


def test_zlib_heads_and_detection():
    for level in range(-1, 10):
        head = framing.zlib_head(level)
        assert int.from_bytes(head, "big") % 31 == 0 and framing.detect(head) == "zlib"
    assert [framing.detect(x) for x in (b"PK\3\4", b"\x1f\x8b", b"ab", b"x")] == ["zip", "gzip", None, None]


def test_dos_time():
    assert framing.unix_to_dos(0) == 0 and framing.dos_to_unix(0) is None and framing.dos_to_unix(1) is None
    for t in (315_532_800, 1_700_000_000, 1_700_000_001):
        assert abs(framing.dos_to_unix(framing.unix_to_dos(t)) - t) < 2


@pytest.mark.parametrize(("a", "b"), [(b"Hello, ", b"World!"), (b"A" * 128, b"B" * 128), (b"", b"x"), (b"x", b""), (RANDOM, LINES)])
def test_combined_checksums(a, b):
    assert checksum.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert checksum.adler32_combine(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_rolling_cuts():
    for data in (b"", b"ab", RANDOM, LINES):
        h, cuts = 0x7FF, []
        for i, c in enumerate(data):
            h = (h << 1 ^ c) & 0xFFF
            if h == 0x7FF:
                cuts.append(i + 1)
        assert codec.rolling_cuts(data).tolist() == cuts
        ends = codec.pack_cuts(np.array(cuts, np.int64), len(data), 9000)
        assert ends[-1] == len(data) and ends == sorted(set(ends)) and set(ends[:-1]) <= set(cuts)


def test_rsyncable_blocks_meet_again():
    """An insertion near the front changes blocks there; later ones are cut at the same content."""
    changed = RANDOM[:100] + b"inserted" + RANDOM[100:]

    def cut(data):
        ends = codec.block_ends(data, Options(rsyncable=True, block_size=32_768))
        return {data[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    assert cut(RANDOM) & cut(changed)


def test_options():
    for bad in ({"level": 10}, {"level": 12}, {"level": -2}, {"strategy": "best"}, {"engine": "gpu"}, {"format": "bz2"}, {"block_size": 1000}, {"threads": -1}):
        with pytest.raises(CodecError):
            Options(**bad)
    assert Options(engine="isal").engine_used == "zlib"
    assert [fast_level(k) for k in (0, 1, 3, 9)] == [0, 1, 2, 3]
    assert adaptive_block(1 << 30, 8) == 2 << 20 and adaptive_block(1 << 20, 8) == 131_072 and thread_cap(1 << 20, 131_072, 8) == 4


def test_flags():
    from bytelode.functions.flags import parse

    opts, command = parse(["-9", "-ib", "128", "--no-name", "-C", "said", "a", "--", "-b"])
    assert (opts.level, opts.independent, opts.block_size, opts.store_name, opts.format) == (9, True, 131_072, False, "gzip")
    assert (command.mode, command.comment, command.paths) == ("compress", "said", ["a", "-b"])
    assert parse(["-11"])[0].level == 11 and parse(["--best"])[0].level == 9 and parse(["-z"])[0].format == "zlib" and parse(["-K"])[0].format == "zip"
    assert parse(["-dk"])[1].mode == "decompress" and parse(["--list", "x"])[1].mode == "list" and parse(["-t"])[1].mode == "test"
    assert parse(["-H"])[0].strategy == "huffman" and parse(["--engine", "isal", "-p", "4"])[0].threads == 4 and parse(["-z"])[0].suffix == ".zz"
    for bad in (["-10"], ["-12"], ["-b", "16"], ["-p", "0"], ["-E", "gpu"], ["--bogus"], ["-b"], ["-b", "x"]):
        with pytest.raises(CodecError):
            parse(bad)


MEMBERS = [("a.txt", b"hello " * 99, 8), ("b/c.txt", b"x", 8), ("empty.txt", b"", 8), ("subdir/", b"", 8), ("big.bin", RANDOM[:50_000], 8), ("stored", b"aaaa" * 99, 0)]


def test_archives():
    packed = archive.build(MEMBERS, comment=b"said")
    z = zipfile.ZipFile(io.BytesIO(packed))
    assert z.testzip() is None and z.comment == b"said" and [i.compress_type for i in z.infolist()] == [8, 0, 0, 0, 0, 0]
    entries, _, comment = archive.catalog(packed)
    assert [(e.filename, archive.read_member(packed, e)) for e in entries] == [(n, d) for n, d, _ in MEMBERS] and comment == b"said"
    assert entries[3].is_dir and entries[3].external_attr == 0o40755 << 16 | 0x10 and archive.first_bad(packed) is None


def test_foreign_archives():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d, _ in MEMBERS:
            with z.open(zipfile.ZipInfo(n), "w", force_zip64=True) as f:
                f.write(d)
        z.comment = b"PK\x05\x06 inside"
    data = b"stub" * 0 + buffer.getvalue()
    assert [archive.read_member(data, e) for e in archive.catalog(data)[0]] == [d for _, d, _ in MEMBERS]


def test_archive_64_bit_records():
    end = framing.directory_end(70_000, 10, 20, b"")
    assert end[:4] == b"PK\x06\x06" and len(end) == 98
    head = archive.central_header("n", 8, 0, 1, 5, 1 << 33, 1 << 34)
    assert struct.unpack_from("<HHQQ", head, 47) == (1, 16, 1 << 33, 1 << 34)


def test_archive_errors():
    packed = archive.build(MEMBERS)
    bad = bytearray(packed)
    bad[40] ^= 255
    assert archive.first_bad(bytes(bad)) == "a.txt"
    for data in (b"small", b"x" * 100, packed[: len(packed) - 30], packed[:-22].replace(b"PK\1\2", b"PK\1\3") + packed[-22:]):
        with pytest.raises(CodecError):
            archive.catalog(data)
    with pytest.raises(CodecError):
        archive.pack_member(b"x", "n", 12)


def image(h, w, c, seed=1):
    y, x = np.mgrid[:h, :w]
    a = np.stack([(k * 5 + 7 * x + 3 * y * (k + seed)) % 256 for k in range(c)], -1).astype(np.uint8)
    return np.ascontiguousarray(a if c > 1 else a[:, :, 0])


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", png.FILTERS)
def test_images(channels, kind):
    for h, w in ((23, 29), (1, 1), (7, 2)):
        a = image(h, w, channels)
        packed = png.encode_array(a, filter=kind, idat_chunk_size=64)
        assert (png.decode_array(packed) == a).all()
        assert [k for k, _, _ in png.chunks(packed)][0::1][0] == b"IHDR"


def test_image_filters_by_definition():
    rows = image(9, 8, 3).reshape(9, -1).astype(int)
    out = png.filtered(rows.astype(np.uint8), 3)
    at = lambda r, i: rows[r][i] if r >= 0 and i >= 0 else 0
    for r in range(9):
        for i in range(24):
            left, up, corner = at(r, i - 3), at(r - 1, i), at(r - 1, i - 3) if i >= 3 else 0
            p = left + up - corner
            near = min(((abs(p - v), k) for k, v in enumerate((left, up, corner))))[1]
            want = [0, left, up, (left + up) // 2, (left, up, corner)[near]]
            assert [int(out[k, r, i]) for k in range(5)] == [(rows[r][i] - v) % 256 for v in want]


def test_image_presets():
    a = image(32, 24, 3)
    for name, (level, strategy, kind) in png.PRESETS.items():
        assert png.encode_array(a, preset_name=name) == png.encode_array(a, level=level, strategy=strategy, filter=kind)
    for bad in ({"preset_name": "tiny"}, {"filter": "best"}, {"strategy": "best"}, {"level": 11}):
        with pytest.raises(CodecError):
            png.encode_array(a, **bad)
    assert len(png.encode_array(np.zeros((128, 128), np.uint8), level=0)) > 4 * len(png.encode_array(np.zeros((128, 128), np.uint8), level=1))


def test_image_errors():
    packed = png.encode_array(image(8, 8, 1))
    head, body, end = (png.chunk(k, b) for k, b, _ in png.chunks(packed))
    flipped = bytearray(packed)
    flipped[-20] ^= 1
    bad = [b"x" * 20, bytes(flipped), packed + b"more", packed + end, png.SIGNATURE + body + head + end, png.SIGNATURE + head + head + body + end, png.SIGNATURE + head + end, packed[:-12], packed[:-4], png.SIGNATURE + png.chunk(b"IHDR", b"x") + end]
    for field in ((8, 8, 16, 0, 0, 0, 0), (8, 8, 8, 3, 0, 0, 0), (8, 8, 8, 0, 0, 0, 1), (0, 8, 8, 0, 0, 0, 0), (9, 8, 8, 0, 0, 0, 0)):
        bad.append(png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", *field)) + body + end)
    bad.append(png.SIGNATURE + head + png.chunk(b"IDAT", zlib.compress(b"\x09" + bytes(8) + bytes(63))) + end)
    for data in bad:
        with pytest.raises(CodecError):
            png.decode(data)
    assert png.decode(png.SIGNATURE + head + png.chunk(b"teXt", b"skipped") + body + end)[0] == 8
    for shape in ((0, 1, 1), (1, 1, 5), (2, 2, 1)):
        with pytest.raises(CodecError):
            png.encode(b"x", *shape)
    with pytest.raises(CodecError):
        png.encode(None, 1, 1, 1)
    with pytest.raises(CodecError):
        png.encode_array(np.zeros((2, 2), np.float32))
