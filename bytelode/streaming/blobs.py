"""Streams of files: compressed as they arrive, and decoded from chunks.

``compress_stream`` and ``decompress_stream`` are stateless. ``inflate_chunks`` takes a stream that comes in pieces over
time: of each key it keeps the pieces that can't be decoded yet, and puts out the text once its last piece is there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import codec, columns
from ..functions.options import CodecError, Options

BLOB_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_blobs(spark: SparkSession, path: str, pattern: str = "*", files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(BLOB_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).load(path)


def compress_stream(blobs: DataFrame, opts: Options = Options(), content: str = "content") -> DataFrame:
    return blobs.withColumn(content, columns.compress(content, opts))


def decompress_stream(blobs: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``data`` and ``error`` of each stream; one that is broken doesn't stop the query."""
    return blobs.withColumn("__t", columns.try_inflate(content)).drop(content).select("*", F.col("__t.data").alias("data"), F.col("__t.error").alias("error")).drop("__t")


def inflate_chunks(chunks: DataFrame, key: str = "stream_id") -> DataFrame:
    """(key, data, error) of streams that arrive as rows (key, seq, is_last, chunk), in any order and over any time."""

    def fold(group, frames, state: GroupState):
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        last = -1
        for frame in frames:
            for seq, is_last, chunk in zip(frame["seq"], frame["is_last"], frame["chunk"], strict=True):
                held[int(seq)] = (b"\1" if is_last else b"\0") + bytes(chunk)
        for seq, chunk in held.items():
            last = seq if chunk[:1] == b"\1" else last
        if last >= 0 and all(s in held for s in range(last + 1)):
            state.remove()
            try:
                data, error = codec.decompress(b"".join(held[s][1:] for s in range(last + 1))), None
            except CodecError as e:
                data, error = None, str(e)
            yield pd.DataFrame({key: [group[0]], "data": [data], "error": [error]})
        else:
            state.update((list(held), list(held.values())))

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, data binary, error string", "seqs array<int>, parts array<binary>", "append", GroupStateTimeout.NoTimeout)
