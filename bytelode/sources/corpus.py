"""Corpora for measurements: text repeated to a size, and bytes that don't compress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def repeated(text: Column, size: int) -> Column:
    """The text's bytes over and over, to a size, the last time cut off; null for an empty text."""
    times = F.ceil(F.lit(size) / F.octet_length(text)).cast("int")
    return F.when(F.octet_length(text) > 0, F.substring(F.repeat(text, times).cast("binary"), 1, size))


def repeated_text(spark: SparkSession, text: str, size: int, files: int = 1) -> DataFrame:
    """(id, content) of ``files`` blobs of ``size`` bytes: the text's bytes over and over, the last time cut off."""
    if not text:
        raise ValueError("an empty text can't be repeated")
    return spark.range(files).select("id", repeated(F.lit(text), size).alias("content"))


def random_bytes(spark: SparkSession, size: int, files: int = 1, seed: int = 0) -> DataFrame:
    """(id, content) of blobs of digests of a running number: as good as random, and the same every time."""
    digests = F.transform(F.sequence(F.lit(0), F.lit(max(0, size - 1) // 32)), lambda k: F.sha2(F.concat_ws(",", F.lit(str(seed)), F.col("id").cast("string"), k.cast("string")).cast("binary"), 256))
    return spark.range(files).select("id", F.substring(F.unhex(F.array_join(digests, "")), 1, size).alias("content"))
