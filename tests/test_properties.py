"""Properties of the codecs over generated inputs."""

import gzip
import io
import zipfile
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bytelode.functions import archive, checksum, codec, png
from bytelode.functions.options import FORMATS, CodecError, Options

blobs = st.one_of(st.binary(max_size=3000), st.builds(lambda b, n: b * n, st.binary(max_size=40), st.integers(0, 200)))
options = st.builds(lambda form, level, strategy, mode: Options(format=form, level=level, strategy=strategy, block_size=700, min_block=1, **mode), st.sampled_from(FORMATS), st.sampled_from([-1, 0, 1, 6, 9, 11]), st.sampled_from(["default", "huffman", "rle", "fixed", "filtered"]), st.sampled_from([{}, {"independent": True}, {"rsyncable": True}]))


@settings(max_examples=150, deadline=None)
@given(blobs, options)
def test_what_is_packed_comes_back(data, opts):
    assert codec.decompress(codec.compress(data, opts, "n", "c", 5), form="raw" if opts.format == "raw" else None) == data


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400))
def test_junk_gives_an_error_or_bytes(data):
    for head in (b"", b"\x1f\x8b\x08\0", b"\x78\x9c", b"PK\3\4"):
        ok, error = codec.verify(head + data)
        assert ok or error
    for read in (archive.catalog, png.decode):
        try:
            read(data)
        except CodecError:
            pass


@settings(max_examples=100, deadline=None)
@given(st.lists(blobs, min_size=1, max_size=6))
def test_checksums_fold_in_any_order(parts):
    whole, total = b"".join(parts), sum(map(len, parts))
    at = shares = 0
    for p in parts:
        at += len(p)
        shares ^= checksum.crc32_shift(zlib.crc32(p), total - at)
    assert shares == zlib.crc32(whole)
    crc, adler = 0, 1
    for p in parts:
        crc, adler = checksum.crc32_combine(crc, zlib.crc32(p), len(p)), checksum.adler32_combine(adler, zlib.adler32(p), len(p))
    assert (crc, adler) == (zlib.crc32(whole), zlib.adler32(whole))


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.text("abc/é", min_size=1, max_size=8).filter(lambda s: s.strip("/")), blobs), max_size=6), st.binary(max_size=50).filter(lambda c: b"PK\5\6" not in c))
def test_archives_are_read_elsewhere(members, comment):
    packed = archive.build([(n.lstrip("/"), b"" if n.endswith("/") else d, 8) for n, d in members], comment=comment)
    z = zipfile.ZipFile(io.BytesIO(packed))
    assert z.testzip() is None and [i.filename for i in z.infolist()] == [n.lstrip("/") for n, _ in members]
    assert [archive.read_member(packed, e) for e in archive.catalog(packed)[0]] == [z.read(i) for i in z.infolist()]


def test_a_comment_that_looks_like_an_end_is_read_here():
    """The standard library takes the last such mark for the archive's end, which is why the test above leaves it out."""
    for comment in (b"PK\5\6", b"x PK\5\6 y", b"PK\5\6" * 5):
        packed = archive.build([("a", b"data", 8)], comment=comment)
        entries, _, found = archive.catalog(packed)
        assert found == comment and archive.read_member(packed, entries[0]) == b"data"


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 4), st.sampled_from(sorted(png.FILTERS)), st.randoms(use_true_random=False))
def test_images_come_back(h, w, c, kind, rng):
    a = np.frombuffer(rng.randbytes(h * w * c), np.uint8).reshape(h, w, c)
    assert (png.decode_array(png.encode_array(np.ascontiguousarray(a), filter=kind)).reshape(h, w, c) == a).all()


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=5), st.binary(max_size=20))
def test_members_end_where_foreign_bytes_begin(parts, tail):
    if tail.startswith(b"\x1f\x8b\x08"):
        tail = b""
    stream = b"".join(map(gzip.compress, parts)) + tail
    assert codec.decompress(stream) == b"".join(parts) and codec.decompress(stream, "first") == parts[0]
