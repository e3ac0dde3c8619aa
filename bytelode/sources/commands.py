"""Compression commands over files, with a row for each file instead of a file for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, paths
from ..functions.flags import parse
from ..operators.streams import list_members
from . import files


def execute(spark: SparkSession, args: list[str]) -> DataFrame:
    """What a command's flags and paths ask for.

    compress: (path, output, content, reason). decompress: (path, output, data, reason). test: (path, ok, error).
    list: a row for each member. Names without a file are looked for with the known suffixes, except to compress.
    """
    opts, command = parse(args)
    if command.mode == "compress":
        return files.compress_files(spark, command.paths, opts, command.recursive, command.force or command.to_stdout, F.lit(command.comment))
    names = [files.resolve(p, missing=True) for p in command.paths]
    listed = files.file_kinds(spark, names, command.recursive)
    listed = listed.withColumn("reason", paths.skip_reason(F.col("kind"), F.col("path"), "decompress", command.recursive, command.force, command.to_stdout or command.mode != "decompress"))
    good = [r.path for r in listed.where("reason IS NULL AND kind != 'directory'").collect()]
    blobs = files.read_blobs(spark, good) if good else spark.createDataFrame([], "path string, content binary")
    blobs = blobs.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content")
    if command.mode == "test":
        return blobs.select("path", columns.verify("content").alias("v")).select("path", "v.ok", "v.error")
    if command.mode == "list":
        return list_members(blobs, ["path"])
    done = blobs.select("path", paths.strip_suffix(F.col("path")).alias("output"), columns.try_inflate("content").alias("t")).select("path", "output", F.col("t.data").alias("data"), F.col("t.error").alias("reason"))
    none = F.lit(None)
    return done.unionByName(listed.where("reason IS NOT NULL").select("path", none.cast("string").alias("output"), none.cast("binary").alias("data"), "reason"))
