"""Operators on frames, held against the standard library."""

import gzip
import io
import os
import random
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from bytelode.functions import columns as C
from bytelode.functions import archive, checksum, paths
from bytelode.functions.options import CodecError, Options, adaptive_block, thread_cap
from bytelode.operators import blocks as B
from bytelode.operators import containers as Z
from bytelode.operators import images as I
from bytelode.operators import streams as S
from bytelode.operators.summary import summarize_runs

TEXT = "".join(f"Line {i}: parallel compression test data.\n" for i in range(4000)).encode()
NOISE = random.Random(1).randbytes(100_000)


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame([(0, bytearray()), (1, bytearray(b"x")), (2, bytearray(TEXT)), (3, bytearray(NOISE)), (4, None), (5, bytearray(TEXT[:4096]))], "id long, content binary")


WANT = {0: b"", 1: b"x", 2: TEXT, 3: NOISE, 5: TEXT[:4096]}


@pytest.mark.parametrize("form", ["gzip", "zlib", "raw"])
@pytest.mark.parametrize("fields", [{}, {"independent": True}, {"rsyncable": True}, {"level": 11}])
def test_streams_in_blocks(blobs, form, fields):
    opts = Options(format=form, block_size=4096, min_block=1, **fields)
    rows = {r.id: r for r in B.compress_in_blocks(blobs.where("id != 4"), ["id"], opts=opts).collect()}
    read = {"gzip": gzip.decompress, "zlib": zlib.decompress, "raw": lambda d: zlib.decompress(d, -15)}[form]
    assert {i: read(bytes(r.content)) for i, r in rows.items()} == WANT
    assert all(r.crc == zlib.crc32(WANT[i]) and r.adler == zlib.adler32(WANT[i]) and r.raw_len == len(WANT[i]) for i, r in rows.items())


def test_windows_save_bytes(blobs):
    size = lambda **k: B.compress_in_blocks(blobs.where("id = 2"), ["id"], opts=Options(block_size=4096, min_block=1, **k)).select(F.octet_length("content")).first()[0]
    assert size() < size(independent=True)


def test_planned_compression(blobs):
    rows = B.compress_blobs(blobs, ["id"], opts=Options(block_size=4096, min_block=1), parallel_from=50_000).collect()
    assert {r.id: r.content and gzip.decompress(bytes(r.content)) for r in rows} == WANT | {4: None}
    plan = B.compress_blobs(blobs, ["id"])._jdf.queryExecution().toString()
    assert plan.count("Window") == 0


def test_headers_in_sql_equal_the_codecs(blobs):
    opts = Options(level=9)
    one = B.assemble(B.deflate_blocks(B.split_blocks(blobs.where("id = 1"), opts=opts), opts), ["id"], opts, F.lit("näme"), F.lit("said"), F.lit(1_700_000_000).cast("long")).first()
    assert bytes(one.content) == bytes(blobs.where("id = 1").select(C.compress("content", opts, F.lit("näme"), F.lit("said"), F.lit(1_700_000_000).cast("long"))).first()[0])


def test_column_functions(spark, blobs):
    d = blobs.withColumn("z", C.gzip_compress("content"))
    rows = {r.id: r for r in d.select("id", C.verify("z").alias("v"), C.try_inflate(F.concat("z", F.lit(b"\x1f\x8b\x08"))).alias("t"), C.gzip_isize(F.col("z")).alias("n"), C.detect_format(F.col("z")).alias("f"), C.adler32("content").alias("a")).collect()}
    assert rows[2].v.ok and not rows[4].v.ok and rows[2].t.data is None and rows[2].t.error and rows[4].t is None
    assert rows[3].n == len(NOISE) and rows[4].n is None and rows[2].f == "gzip" and rows[4].f is None and rows[0].a == 1
    with pytest.raises(Exception, match="no known format"):
        spark.createDataFrame([(bytearray(b"zz"),)], "c binary").select(C.inflate_auto("c")).collect()
    t = spark.sql("SELECT timestamp'2023-11-14 22:13:20' AS t, timestamp'1970-01-01' AS old")
    dos = t.select(C.unix_to_dos(F.col("t")).alias("d"), C.unix_to_dos(F.col("old")).alias("o")).first()
    assert dos.d == zipfile_dos(2023, 11, 14, 22, 13, 20) and dos.o is None


def zipfile_dos(y, mo, d, h, mi, s):
    return (y - 1980) << 25 | mo << 21 | d << 16 | h << 11 | mi << 5 | s // 2


def test_member_lists(spark):
    two = gzip.compress(TEXT, mtime=7) + gzip.compress(b"two")
    d = spark.createDataFrame([(1, bytearray(two)), (2, bytearray(two[:-4])), (3, None), (4, bytearray(b"junk"))], "id long, content binary")
    rows = sorted((r.id, r.member, r.raw_len, r.error) for r in S.list_members(d, ["id"]).collect())
    assert rows == [(1, 0, len(TEXT), None), (1, 1, 3, None), (2, 0, len(TEXT), None), (2, 1, None, "the trailer is missing"), (4, 0, None, "no known format")]
    assert 80 < S.list_members(d, ["id"]).where("id = 1 AND member = 0").first().reduced < 100


ROWS = [("x", 2, "b/c.txt", b"x", None, None), ("x", 1, "/a.txt", TEXT, None, None), ("x", 3, "in\\same", b"1", None, None), ("x", 4, "in/same", b"22", None, None), ("x", 5, "dir", None, None, True), ("y", 1, "noise", NOISE, 8, None), ("y", 2, "kept", TEXT, 0, None), ("y", 3, "empty", b"", 8, None)]
SCHEMA = "archive string, ordinal long, filename string, data binary, compress_type int, is_dir boolean"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(a, o, n, d if d is None else bytearray(d), k, i) for a, o, n, d, k, i in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def archives(rows):
    return Z.zip_build(rows, ["archive"], comment=F.lit(b"said"))


def test_archives(archives):
    built = {r.archive: zipfile.ZipFile(io.BytesIO(bytes(r.content))) for r in archives.collect()}
    assert all(z.testzip() is None and z.comment == b"said" for z in built.values())
    assert [(i.filename, i.compress_type, i.date_time[0]) for i in built["x"].infolist()] == [("a.txt", 8, 1980), ("b/c.txt", 0, 1980), ("in/same", 0, 1980), ("in/same", 0, 1980), ("dir/", 0, 1980)]
    assert [i.compress_type for i in built["y"].infolist()] == [0, 0, 0] and built["y"].read("noise") == NOISE
    members = Z.zip_members(archives, ["archive"])
    assert {(r.archive, r.ordinal): bytes(r.data) for r in members.collect()}[("x", 0)] == TEXT
    entries = Z.zip_entries(archives, ["archive"])
    assert [r.file_size for r in Z.lookup(entries, "/in\\same", ["archive"]).collect()] == [2] and Z.lookup(entries, "none", ["archive"]).collect() == []
    assert {r.archive: r.names for r in Z.names(entries, ["archive"]).collect()}["x"] == ["a.txt", "b/c.txt", "in/same", "in/same", "dir/"]
    assert {r.archive: r.first_bad for r in Z.test_archives(members, ["archive"]).collect()} == {"x": None, "y": None}
    assert {bytes(r.comment) for r in Z.archive_comments(archives, ["archive"]).collect()} == {b"said"}


def test_reading_members(spark, archives):
    members = Z.zip_members(archives, ["archive"])
    x = members.where("archive = 'x'")
    assert bytes(Z.read_by_name(x, "in/same", ["archive"]).first().data) == b"22" and bytes(Z.read_by_index(x, 0, ["archive"]).first().data) == TEXT
    for call in (lambda: Z.read_by_name(x, "none", ["archive"]), lambda: Z.read_by_index(x, 9, ["archive"])):
        with pytest.raises(Exception, match="no such member|no member at"):
            call().collect()
    entries = Z.zip_entries(archives, ["archive"])
    assert {r.archive: r.found for r in Z.contains(entries, "\\noise", ["archive"]).collect()} == {"x": False, "y": True}
    assert Z.info(entries, ["archive"]).columns[-1] == "comment" and Z.short_info(entries, ["archive"]).columns[1:] == ["name", "size", "compressedSize", "crc32", "method", "isDir"]


def test_member_levels(spark):
    d = spark.createDataFrame([("a", k, f"{k}", bytearray(TEXT), k) for k in (0, 1, 9)], "archive string, ordinal int, filename string, data binary, compress_level int")
    size = {r.filename: r.compress_size for r in Z.zip_entries(Z.zip_build(d, ["archive"]), ["archive"]).collect()}
    assert size["9"] < size["1"] < size["0"] == len(TEXT)


def test_corpora(spark):
    from bytelode.sources.corpus import random_bytes, repeated_text

    assert [bytes(r.content) for r in repeated_text(spark, "abé", 10, 2).collect()] == ["abé".encode() * 2 + b"ab"] * 2
    rows = [bytes(r.content) for r in random_bytes(spark, 10_001, 2).collect()]
    assert [len(r) for r in rows] == [10_001] * 2 and rows[0] != rows[1] and len(zlib.compress(rows[0])) > 10_000


def test_broken_archives(archives):
    bad = archives.where("archive = 'y'").select("archive", F.concat(F.substring("content", 1, 100), F.lit(b"!"), F.expr("substring(content, 102)")).alias("content"))
    members = Z.zip_members(bad, ["archive"])
    assert Z.test_archives(members, ["archive"]).first().first_bad == "noise"
    with pytest.raises(CodecError):
        Z.extract(members, "/nowhere")
    with pytest.raises(Exception, match="corrupt archive"):
        Z.zip_append(bad, members.limit(0).select("archive", "ordinal", "filename", "data"), ["archive"]).collect()


def test_python_gets_no_whole_archive(archives):
    for d in (Z.zip_members(archives, ["archive"]), Z.zip_entries(archives, ["archive"]), Z.archive_comments(archives, ["archive"]), Z.zip_append(archives, archives.limit(0).selectExpr("archive", "1L ordinal", "'' filename", "X'' data"), ["archive"])):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        # as an argument of its own; substrings of it are cut before
        assert "run(" in plan and not re.search(r"run\((?:[^()]*, )?content#", plan)


def test_odd_archives_are_read_by_their_directories(spark):
    def zipped(members, comment=b"", kind=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", kind) as z:
            for name, data in members:
                z.writestr(name, data)
            z.comment = comment
        return out.getvalue()

    big = [(f"é{k}", os.urandom(50_000) + TEXT) for k in range(5)]
    whole = zipped(big, b"c" * 0xFFFF)
    at = archive.catalog(whole)[0][2].header_offset
    cases = {"none": zipped([]), "long comment": whole, "many": zipped([(str(k), b"") for k in range(66_000)], b"c" * 0xFFFF), "stored": zipped(big, b"PK\x05\x06", zipfile.ZIP_STORED), "header": whole[:at] + b"!" + whole[at + 1 :], "names": whole[: at + 26] + b"\xff\xff\xff\xff" + whole[at + 30 :], "null": None}
    frame = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in cases.items()], "archive string, content binary")
    want = {(k, e.ordinal): (e.filename, e.header_offset, Z._read(v, e)) for k, v in cases.items() if v for e in archive.catalog(v)[0]}
    got = {(r.archive, r.ordinal): (r.filename, r.header_offset, {"error": r.error} if r.error else {"data": bytes(r.data)}) for r in Z.zip_members(frame, ["archive"]).toLocalIterator()}
    assert got == want and sum("error" in x for _, _, x in got.values()) == 2
    assert Z.zip_entries(frame, ["archive"]).count() == len(want)
    assert {r.archive: None if r.comment is None else len(r.comment) for r in Z.archive_comments(frame, ["archive"]).collect()} == {"none": 0, "long comment": 0xFFFF, "many": 0xFFFF, "stored": 4, "header": 0xFFFF, "names": 0xFFFF, "null": None}
    for bad in (b"too short", whole[:-1], b"x" * 100_000):
        with pytest.raises(Exception, match="archive|directory"):
            Z.zip_members(spark.createDataFrame([("a", bytearray(bad))], "archive string, content binary"), ["archive"]).collect()


def test_archives_of_many_members(spark):
    d = spark.range(66_000).selectExpr("'a' AS archive", "id AS ordinal", "cast(id AS string) AS filename", "encode(cast(id AS string), 'UTF-8') AS data")
    z = zipfile.ZipFile(io.BytesIO(bytes(Z.zip_build(d, ["archive"]).first().content)))
    assert len(z.namelist()) == 66_000 and z.read("65999") == b"65999"


def test_append(spark, archives):
    more = spark.createDataFrame([("x", 0, "new.txt", bytearray(b"new")), ("z", 0, "first.txt", bytearray(b"first"))], "archive string, ordinal long, filename string, data binary")
    built = {r.archive: zipfile.ZipFile(io.BytesIO(bytes(r.content))) for r in Z.zip_append(archives, more, ["archive"]).collect()}
    assert built["x"].namelist()[-1] == "new.txt" and built["x"].read("a.txt") == TEXT and built["z"].namelist() == ["first.txt"] and built["y"].read("noise") == NOISE
    with pytest.raises(Exception, match="needs a name"):
        Z.zip_build(more.withColumn("filename", F.lit("//")), ["archive"]).collect()


def test_append_keeps_what_was_there(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, mode in (("run.sh", 0o100755), ("plain.txt", 0o100600)):
            i = zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6))
            i.external_attr, i.comment, i.compress_type = mode << 16, name.encode(), zipfile.ZIP_DEFLATED
            z.writestr(i, TEXT)
        z.comment = b"of the archive"
    old = spark.createDataFrame([("x", bytearray(out.getvalue()))], "archive string, content binary")
    more = spark.createDataFrame([("x", 0, "new.txt", bytearray(b"new"))], "archive string, ordinal long, filename string, data binary")
    content = bytes(Z.zip_append(old, more, ["archive"], Options(level=9)).first().content)
    before, after = zipfile.ZipFile(out), zipfile.ZipFile(io.BytesIO(content))
    assert after.comment == b"of the archive" and after.namelist() == ["run.sh", "plain.txt", "new.txt"] and after.testzip() is None
    for a, b in zip(before.infolist(), after.infolist()):
        assert (a.external_attr, a.comment, a.date_time, a.CRC, a.compress_size) == (b.external_attr, b.comment, b.date_time, b.CRC, b.compress_size)
    mine, theirs = archive.catalog(content)[0], archive.catalog(out.getvalue())[0]
    assert [archive.stored_member(content, e) for e in mine[:2]] == [archive.stored_member(out.getvalue(), e) for e in theirs]


def test_no_block_row_carries_its_blob(spark):
    frame = spark.createDataFrame([("a", bytearray(TEXT))], "path string, content binary").repartition(2)
    plan = B.split_blocks(frame)._jdf.queryExecution().optimizedPlan().toString()
    # the rows above have no content, and the generator drops it from its input's columns (path, content, total, ends)
    dropped = re.search(r"\[([\d, ]+)\], false, \[seq", plan)[1].split(", ")
    assert "content" not in plan[: plan.index("Generate")] and "1" in dropped


def test_threads_deal_blocks(spark):
    big = TEXT * (1 + (3 << 20) // len(TEXT))
    frame = spark.createDataFrame([("a", bytearray(big)), ("b", bytearray(b"")), ("c", bytearray(TEXT))], "path string, content binary")
    for opts in (Options(threads=4), Options(threads=1), Options(threads=3, independent=True)):
        got = {r.path: gzip.decompress(bytes(r.content)) for r in B.compress_in_blocks(frame, ["path"], opts=opts).collect()}
        assert got == {"a": big, "b": b"", "c": TEXT}
    sizes = {r.path: r.n for r in B.split_blocks(frame, opts=Options(threads=4)).groupBy("path").agg(F.max("raw_len").alias("n")).collect()}
    assert sizes["a"] == adaptive_block(len(big), 4)


def test_adaptive_blocks_in_sql(spark):
    rows = [(n, t) for n in (0, 1, 131_072, 1 << 20, (32 << 20) - 1, 32 << 20, 1 << 26, 1 << 33) for t in (0, 1, 8, 100)]
    frame = spark.createDataFrame(rows, "size long, t int")
    for t in (0, 1, 8, 100):
        for r in frame.where(F.col("t") == t).select("size", C.adaptive_block(F.col("size"), t).alias("b"), C.thread_cap(F.col("size"), F.lit(1 << 18), t).alias("c")).collect():
            assert (r.b, r.c) == (adaptive_block(r.size, t), thread_cap(r.size, 1 << 18, t))


def test_checksum_shares_of_whole_columns(spark):
    rows = [(zlib.crc32(bytes([k])), n) for k, n in enumerate((0, 1, 31, 131_072, 1 << 20, (1 << 40) + 12_345))] + [(None, 3), (5, None)]
    got = spark.createDataFrame(rows, "crc long, after long").select("crc", "after", C.crc32_shift("crc", "after").alias("s")).collect()
    assert all(r.s == (None if None in (r.crc, r.after) else checksum.crc32_shift(r.crc, r.after)) for r in got) and len(got) == 8


def test_extract(spark, archives, tmp_path):
    assert Z.extract(Z.zip_members(archives, ["archive"]).where("archive = 'x'"), str(tmp_path)) == 5
    assert (tmp_path / "a.txt").read_bytes() == TEXT and (tmp_path / "dir").is_dir() and (tmp_path / "b/c.txt").read_bytes() == b"x"
    evil = spark.createDataFrame([("x", 1, "../evil.txt", bytearray(b"x"))], "archive string, ordinal long, filename string, data binary")
    with pytest.raises(CodecError):
        Z.extract(Z.zip_members(Z.zip_build(evil, ["archive"]), ["archive"]), str(tmp_path / "in"))
    assert not (tmp_path / "evil.txt").exists()


def test_table_functions(spark, archives):
    Z.register_functions(spark)
    archives.createOrReplaceTempView("archives")
    assert spark.sql("SELECT e.filename FROM archives a, LATERAL zip_entries(a.content) e WHERE a.archive = 'x' AND e.is_dir").collect()[0][0] == "dir/"
    assert spark.sql("SELECT sum(length(m.data)) FROM archives a, LATERAL zip_members(a.content) m").first()[0] == sum(len(d or b"") for _, _, _, d, _, _ in ROWS)
    spark.createDataFrame([(bytearray(gzip.compress(b"abc")),)], "c binary").createOrReplaceTempView("streams")
    assert spark.sql("SELECT m.raw_len FROM streams s, LATERAL gzip_members(s.c) m").first()[0] == 3


def test_images(spark):
    d = spark.createDataFrame([(1, 2, 2, 3, bytearray(range(12))), (2, 3, 1, 1, bytearray(b"abc"))], "id long, width int, height int, channels int, pixels binary")
    files = I.encode_images(d, preset_name="balanced").select("id", "content")
    assert sorted(map(tuple, I.decode_images(files).collect())) == sorted(map(tuple, d.collect()))
    assert [r.type for r in I.image_chunks(files, ["id"]).where("id = 1").orderBy("ordinal").collect()] == ["IHDR", "IDAT", "IEND"]
    lines = I.scanlines(d, ["id"], "sub").where("id = 2").first()
    assert (lines.filter, bytes(lines.bytes)) == (1, b"a\x01\x01")
    with pytest.raises(CodecError):
        I.scanlines(d, ["id"], "best")


def test_names(spark):
    cases = {"a.tar.gz": "a.tar", "a.tgz": "a.tar", ".gz": ".gz", "x.gz": "x", "a.ZIP": "a", "a.Z": "a", "a_z": "a", "b-gz": "b", "plain": "plain", ".tgz": ".tgz", "a.zz": "a"}
    d = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.o for r in d.select("n", paths.strip_suffix(F.col("n")).alias("o")).collect()} == cases
    with pytest.raises(Exception, match="unsafe path"):
        spark.createDataFrame([("a/../b",)], "n string").select(paths.safe_path(F.col("n"))).collect()


def test_summary(spark):
    runs = spark.createDataFrame([("c", m, t, 1_000_000, b) for m, ts, b in (("base", [2.0, 4.0, 1.0], 500), ("fast", [0.5, 0.25], 250)) for t in ts], "corpus string, method string, seconds double, raw_bytes long, comp_bytes long")
    got = {r.method: r for r in summarize_runs(runs, ["corpus"], "base").collect()}
    assert got["base"].median_s == 2.0 and got["fast"].median_s == 0.5 and got["fast"].speedup == 4.0 and got["fast"]["rank"] == 1 and got["base"].best_s == 1.0 and got["fast"].ratio == 4000
