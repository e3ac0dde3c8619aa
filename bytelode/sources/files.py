"""Files of blobs, of compressed text and of images."""

from __future__ import annotations

import glob
import os
import stat

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns, paths
from ..functions.options import CodecError, Options

#: Rows that cross to Python at once, for blobs.
BLOB_BATCH = 64


def read_blobs(spark: SparkSession, path: str | list[str], recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files. Filters on length and time reach the listing."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOB_BATCH))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def archive_rows(spark: SparkSession, path: str | list[str], root: str = "", arcroot: str = "", pattern: str | None = None) -> DataFrame:
    """(ordinal, filename, data, mtime) of files, as zip_build takes them, in order of their names.

    A file's name in the archive is its path below ``root``, put below ``arcroot``; its date is the file's. Spark's
    readers leave out empty files.
    """
    own = read_blobs(spark, path, True, pattern)
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.\-]*:/*", "/")
    start = root.rstrip("/") + "/"
    below = F.when(plain.startswith(start), plain.substr(F.lit(len(start) + 1), F.length(plain))).otherwise(F.ltrim(plain, F.lit("/")))
    name = F.concat(F.lit(arcroot.rstrip("/") + "/" if arcroot else ""), below)
    rows = own.select(name.alias("filename"), F.col("content").alias("data"), F.unix_timestamp("modificationTime").alias("mtime"))
    # names alone are put in order
    order = own.select(name.alias("filename")).distinct().select("filename", (F.row_number().over(Window.orderBy("filename")) - 1).cast("long").alias("ordinal"))
    return rows.join(order, "filename").select("ordinal", "filename", "data", "mtime")


def file_kinds(spark: SparkSession, names: list[str], recursive: bool = False) -> DataFrame:
    """(path, kind, mtime, size) of names on a mounted path: what skip_reason asks for."""
    rows = []
    todo = list(names)
    while todo:
        path = todo.pop(0)
        try:
            s = os.lstat(path)
        except OSError:
            rows.append((path, "missing", None, None))
            continue
        kind = "file" if stat.S_ISREG(s.st_mode) or stat.S_ISFIFO(s.st_mode) else "link" if stat.S_ISLNK(s.st_mode) else "directory" if stat.S_ISDIR(s.st_mode) else "special"
        rows.append((path, kind, int(s.st_mtime), s.st_size))
        if kind == "directory" and recursive:
            todo += sorted(glob.glob(os.path.join(glob.escape(path), "*")))
    return spark.createDataFrame(rows, "path string, kind string, mtime long, size long")


def resolve(path: str, missing: bool = False) -> str:
    """The name, or the name with the first known suffix under which a file exists; without one an error, or the name."""
    for name in (path, *(path + s for s in paths.ALL_SUFFIXES)):
        if os.path.lexists(name):
            return name
    if missing:
        return path
    raise CodecError(f"{path} does not exist")


def compress_files(spark: SparkSession, names: list[str], opts: Options = Options(), recursive: bool = False, force: bool = False, comment: Column | None = None) -> DataFrame:
    """(path, output, content, reason): compressed files, and those left alone with the reason. Nothing is deleted."""
    listed = file_kinds(spark, names, recursive).withColumn("reason", paths.skip_reason(F.col("kind"), F.col("path"), "compress", recursive, force))
    good = [r.path for r in listed.where("reason IS NULL AND kind != 'directory'").collect()]
    rejected = listed.where("reason IS NOT NULL").select("path", F.lit(None).cast("string").alias("output"), F.lit(None).cast("binary").alias("content"), "reason")
    if not good:
        return rejected
    own = read_blobs(spark, good).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    done = own.select("path", F.concat("path", F.lit(opts.suffix)).alias("output"), columns.compress("content", opts, paths.basename(F.col("path")), comment, F.unix_timestamp("modificationTime")).alias("content"), F.lit(None).cast("string").alias("reason"))
    return done.unionByName(rejected)


def write_blobs(df: DataFrame, folder: str, name: str = "output", content: str = "content", overwrite: bool = False) -> int:
    """Writes each value to a file under a mounted folder and returns their number; an existing file is an error unless overwritten."""
    rows = df.select(F.col(name).alias("name"), F.col(content).alias("content"))

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                target = os.path.join(folder, r["name"].lstrip("/"))
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.part-{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(r["content"])
                if overwrite:
                    os.replace(part, target)
                else:
                    try:
                        os.link(part, target)  # fails where the target exists
                    finally:
                        os.remove(part)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_gzip_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file's whole text, of all members."""
    return read_blobs(spark, path).select("path", F.decode(columns.inflate_auto("content"), "UTF-8").alias("value"))


def read_gzip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of gzip or .deflate text, of any length."""
    return spark.read.text(path)


def read_zlib_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, value): lines of files in zlib framing under any suffix."""
    text = F.decode(columns.inflate_auto("content"), "UTF-8")
    return read_blobs(spark, path).select("path", F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("pos", "value"))


def write_gzip_lines(df: DataFrame, path: str, column: str = "value", mode: str = "errorifexists") -> None:
    """Text lines in gzip files, by Spark's writer."""
    df.select(F.col(column).cast("string")).write.mode(mode).option("compression", "gzip").text(path)


def write_text(df: DataFrame, folder: str, level: int = 6, mode: str = "w", name: str = "name", text: str = "text") -> int:
    """One gzip file of each row's text at a level. Modes w, wt and wb replace, x doesn't."""
    if mode not in ("w", "wt", "wb", "x"):
        raise CodecError(f"unknown mode {mode!r}")
    rows = df.select(F.col(name).alias("output"), columns.gzip_compress(F.encode(text, "UTF-8"), level).alias("content"))
    return write_blobs(rows, folder, overwrite=mode != "x")


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, pixels) of PNG files."""
    from ..operators.images import decode_images

    return decode_images(read_blobs(spark, path, pattern="*.png").select("path", "content"))


def save_images(images: DataFrame, folder: str, name: str = "name", overwrite: bool = False, **options) -> int:
    from ..operators.images import encode_images

    return write_blobs(encode_images(images, **options), folder, name, "content", overwrite)


def test_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ok, error) of compressed files; nothing is written."""
    return read_blobs(spark, path).select("path", columns.verify("content").alias("v")).select("path", "v.ok", "v.error")


