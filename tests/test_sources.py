"""Files, the archive source and streams."""

import gzip
import os
import zipfile
import zlib

import numpy as np
import pytest

from bytelode.functions import archive, png
from bytelode.functions.options import CodecError, Options
from bytelode.sources import files, zip_source
from bytelode.streaming import blobs as streams

MEMBERS = [("a.txt", b"hello " * 500, 8), ("b/c.txt", b"x", 8), ("dir/", b"", 8), ("n.bin", os.urandom(3000), 8)]


@pytest.fixture
def zips(spark, tmp_path):
    zip_source.register(spark)
    folder = tmp_path / "zips"
    (folder / "deep").mkdir(parents=True)
    (folder / "one.zip").write_bytes(archive.build(MEMBERS))
    with zipfile.ZipFile(folder / "deep/two.zip", "w") as z:
        for i in range(3000):
            z.writestr(f"long-member-name-{i:06d}.txt", str(i))
        z.comment = b"c" * 60_000
    return folder


def test_archive_source(spark, zips):
    d = spark.read.format("ziparchive").option("partitionBytes", 1000).load(str(zips))
    assert d.count() == 3004 and d.rdd.getNumPartitions() > 4
    found = d.where("filename = 'a.txt'")
    assert [bytes(r.data) for r in found.collect()] == [MEMBERS[0][1]]
    assert found.rdd.getNumPartitions() == 1 and "filename" in found._jdf.queryExecution().toString()
    assert d.where("filename = 'none'").collect() == [] and d.where("ordinal = 3").count() == 2
    bare = spark.read.format("ziparchive").option("content", "false").load(str(zips / "one.zip"))
    assert [r.data for r in bare.collect()] == [None] * 4
    with pytest.raises(Exception, match="does not exist"):
        spark.read.format("ziparchive").load(str(zips / "no.zip")).collect()


def test_archive_sink(spark, zips, tmp_path):
    d = spark.read.format("ziparchive").load(str(zips / "one.zip")).select("filename", "data")
    out = tmp_path / "out"
    d.coalesce(1).write.format("ziparchive").mode("append").save(str(out))
    written = list(out.glob("*.zip"))
    z = zipfile.ZipFile(written[0])
    assert len(written) == 1 and z.testzip() is None and z.read("a.txt") == MEMBERS[0][1]
    d.limit(1).coalesce(1).write.format("ziparchive").mode("overwrite").save(str(out))
    assert [len(zipfile.ZipFile(p).namelist()) for p in out.glob("*.zip")] == [1]
    with pytest.raises(Exception, match="exists"):
        d.write.format("ziparchive").mode("append").option("exclusive", "true").save(str(out))


def test_compressed_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, data in (("a.txt", b"A" * 1000), ("b.gz", b"x"), ("d/c.txt", b"c")):
        (tmp_path / name).write_bytes(data)
    os.symlink(tmp_path / "a.txt", tmp_path / "link")
    names = [str(tmp_path / n) for n in ("a.txt", "b.gz", "d", "link", "gone")]
    rows = {os.path.basename(r.path): r for r in files.compress_files(spark, names, Options(level=9)).collect()}
    assert gzip.decompress(bytes(rows["a.txt"].content)) == b"A" * 1000 and rows["a.txt"].output.endswith("a.txt.gz")
    assert {k: r.reason for k, r in rows.items() if r.reason} == {"b.gz": "already has a compressed suffix", "d": "is a directory", "link": "is a symbolic link", "gone": "does not exist"}
    deep = files.compress_files(spark, [str(tmp_path / "d")], recursive=True).where("content IS NOT NULL").collect()
    assert [os.path.basename(r.output) for r in deep] == ["c.txt.gz"]
    (tmp_path / "r.zz").write_bytes(zlib.compress(b"1\n2\n"))
    assert files.resolve(str(tmp_path / "r")) == str(tmp_path / "r.zz")
    with pytest.raises(CodecError):
        files.resolve(str(tmp_path / "nothing"))
    assert [r.value for r in files.read_zlib_lines(spark, str(tmp_path / "r.zz")).orderBy("pos").collect()] == ["1", "2"]


def test_commands(spark, tmp_path):
    from bytelode.sources.commands import execute

    (tmp_path / "a.txt").write_bytes(b"A" * 5000)
    path = str(tmp_path / "a.txt")
    packed = execute(spark, ["-9", "-C", "said", path]).first()
    assert gzip.decompress(bytes(packed.content)) == b"A" * 5000
    (tmp_path / "a.txt.gz").write_bytes(bytes(packed.content))
    (tmp_path / "bad.gz").write_bytes(bytes(packed.content)[:-2])
    listed = execute(spark, ["-l", path + ".gz"]).first()
    assert (listed.name, listed.comment, listed.raw_len) == ("a.txt", "said", 5000)
    both = {os.path.basename(r.path): (r.output and os.path.basename(r.output), r.data and len(r.data), r.reason) for r in execute(spark, ["-d", path + ".gz", str(tmp_path / "bad.gz"), str(tmp_path / "none")]).collect()}
    assert both == {"a.txt.gz": ("a.txt", 5000, None), "bad.gz": ("bad", None, "the trailer is missing"), "none": (None, None, "does not exist")}
    assert {os.path.basename(r.path): r.ok for r in execute(spark, ["-t", path + ".gz", str(tmp_path / "bad")]).collect()} == {"a.txt.gz": True, "bad.gz": False}


def test_text_files(spark, tmp_path):
    lines = [f"line {i}" for i in range(100)] + ["A" * 70_000]
    d = spark.createDataFrame([(x,) for x in lines], "value string")
    files.write_gzip_lines(d, str(tmp_path / "t"))
    assert sorted(r.value for r in files.read_gzip_lines(spark, str(tmp_path / "t")).collect()) == sorted(lines)
    with pytest.raises(Exception, match="exists"):
        files.write_gzip_lines(d, str(tmp_path / "t"))
    (tmp_path / "m.gz").write_bytes(gzip.compress(b"one\n") + gzip.compress(b"two\n"))
    assert [r.value for r in files.read_gzip_lines(spark, str(tmp_path / "m.gz")).collect()] == ["one", "two"]
    assert files.read_gzip_text(spark, str(tmp_path / "m.gz")).first().value == "one\ntwo\n"
    one = spark.createDataFrame([("x.gz", "some text")], "name string, text string")
    assert files.write_text(one, str(tmp_path / "w"), 9) == 1 and gzip.decompress((tmp_path / "w/x.gz").read_bytes()) == b"some text"
    with pytest.raises(Exception, match="exists"):
        files.write_text(one, str(tmp_path / "w"), mode="x")
    with pytest.raises(CodecError):
        files.write_text(one, str(tmp_path / "w"), mode="r")
    (tmp_path / "bad.gz").write_bytes(b"junk")
    assert {os.path.basename(r.path): r.ok for r in files.test_files(spark, str(tmp_path / "*.gz")).collect()} == {"m.gz": True, "bad.gz": False}


def test_length_filters_reach_the_scan(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 20)
    plan = files.read_blobs(spark, str(tmp_path)).where("length > 10")._jdf.queryExecution().toString()
    assert "GreaterThan(length,10)" in plan


def test_image_files(spark, tmp_path):
    a = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    d = spark.createDataFrame([("p.png", 4, 4, 3, bytearray(a.tobytes()))], "name string, width int, height int, channels int, pixels binary")
    assert files.save_images(d, str(tmp_path / "i"), preset_name="small") == 1
    assert (png.decode_array((tmp_path / "i/p.png").read_bytes()) == a).all()
    assert bytes(files.load_images(spark, str(tmp_path / "i")).first().pixels) == a.tobytes()


def run(query):
    query.processAllAvailable()
    query.stop()


def test_file_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"A" * 100)
    packed = streams.compress_stream(streams.stream_blobs(spark, str(tmp_path / "in"), "*.txt"))
    run(packed.writeStream.format("memory").queryName("packed").start())
    content = bytes(spark.table("packed").first().content)
    assert gzip.decompress(content) == b"A" * 100
    (tmp_path / "z").mkdir()
    (tmp_path / "z/a.gz").write_bytes(content)
    (tmp_path / "z/b.gz").write_bytes(content[:-5])
    run(streams.decompress_stream(streams.stream_blobs(spark, str(tmp_path / "z"))).writeStream.format("memory").queryName("unpacked").start())
    got = {os.path.basename(r.path): (r.data and bytes(r.data), r.error) for r in spark.table("unpacked").collect()}
    assert got == {"a.gz": (b"A" * 100, None), "b.gz": (None, "the trailer is missing")}


def test_chunk_streams(spark, tmp_path):
    data = gzip.compress(os.urandom(1000))
    parts = [(1, k, k == 3, bytearray(data[k * 300 : (k + 1) * 300])) for k in range(4)]
    schema = "stream_id long, seq int, is_last boolean, chunk binary"
    source = tmp_path / "c"
    source.mkdir()
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    for own in ([parts[3], parts[1]], [parts[0], (2, 0, True, bytearray(b"bad"))], [parts[2]]):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(source))
    run(streams.inflate_chunks(chunks).writeStream.format("memory").queryName("joined").outputMode("append").start())
    got = {r.stream_id: (r.data and bytes(r.data), r.error) for r in spark.table("joined").collect()}
    assert got == {1: (gzip.decompress(data), None), 2: (None, "no known format")}


def test_archive_rows_of_files(spark, tmp_path):
    import io
    import zipfile

    from pyspark.sql import functions as F

    from bytelode.operators import containers

    (tmp_path / "in/sub dir").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"a" * 500)
    (tmp_path / "in/sub dir/é%20.bin").write_bytes(b"x")
    os.utime(tmp_path / "in/a.txt", (981_173_106, 981_173_106))
    rows = files.archive_rows(spark, f"file://{tmp_path}/in", root=f"{tmp_path}/in", arcroot="top").withColumn("archive", F.lit("x"))
    z = zipfile.ZipFile(io.BytesIO(bytes(containers.zip_build(rows, ["archive"]).first().content)))
    assert z.namelist() == ["top/a.txt", "top/sub dir/é%20.bin"] and z.read("top/a.txt") == b"a" * 500
    assert z.getinfo("top/a.txt").date_time == (2001, 2, 3, 4, 5, 6)
