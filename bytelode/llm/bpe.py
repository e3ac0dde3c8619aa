"""Byte-level BPE encoding and decoding with overlapping chunks.

Every text is cut into chunks of ``chunk`` characters, each with ``overlap`` characters of the next. Chunks are dealt
over the cluster and pre-tokenised there on their own. Neighbours are stitched where their pre-token boundaries meet
again: a scan depends only on what follows its position, so from a shared boundary on both scans are one. What lies
between two stitches is a piece; pieces are dealt anew and encoded, and a text's ids are those of its pieces in order.
Where neighbours share no boundary in their overlap (one endless pre-token, say) their chunks are one piece. A text of
one chunk is one piece and needs no boundary: it is encoded by the same function where it lies.

A boundary counts only if a character other than white space is before it, for the pattern looks ahead at what
follows white space; so a piece has the same pre-tokens alone as in its text.

Null and empty texts have no ids. Rows with equal ids, equal texts or both each get a row: long texts are numbered
by a written table, so that no two rows meet under one key. Extra columns are kept in the order of the input for
``encode``; one named like a result column gives way to it.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ._arrow import add_columns, column, grouped, texts_of
from ._shared import table, tuned, written

CHUNK, OVERLAP = 1 << 15, 1 << 11
#: Characters before a chunk's end within which its last matches are not sure (the pattern looks ahead by up to three).
MARGIN = 4


@lru_cache(4)
def encoding(path: str):
    """The tiktoken encoding of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(path: str, text: str) -> np.ndarray:
    return encoding(path).encode_to_numpy(text, disallowed_special=()).astype("<u4") if text else np.zeros(0, "<u4")


def pretokens(text: str) -> np.ndarray:
    """Character positions at which pre-tokens end."""
    import public_tokenizers
    import regex

    return np.fromiter((m.end() for m in regex.finditer(public_tokenizers.PATTERN, text)), np.int64)


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """Overlapping chunks: (first character, text)."""
    return [(at, text[at : at + chunk + overlap]) for at in range(0, max(len(text) - overlap, 1), chunk)]


def boundaries(text: str) -> np.ndarray:
    """The sure boundaries of a chunk that pieces can end at, as places in it."""
    ends = pretokens(text)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    sure = ends[(ends < len(text)) & (starts + MARGIN <= len(text))]
    return sure[[not text[e - 1].isspace() for e in sure.tolist()]] if len(sure) else sure


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` without the text, with ``ids``: its token ids as little-endian unsigned 32-bit integers (binary)."""
    tuned(docs.sparkSession)
    # what ``cut`` leaves in one chunk
    whole = F.coalesce(F.length(text_col), F.lit(0)) <= chunk + overlap

    def make():
        def run(part: pa.RecordBatch) -> list:
            return [pa.array([ids_of(vocabulary, t).tobytes() for t in texts_of(part, text_col)], pa.binary())]

        return run

    direct = add_columns(docs.where(whole), text_col, "ids binary", make, (text_col,))
    others = [c for c in docs.columns if c.lower() not in (text_col.lower(), "ids")]
    long = docs.where(~whole).select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    row_type = long.schema["row"].dataType.simpleString()

    def spread(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            kept = column(batch, "row")
            for i, text in enumerate(texts_of(batch, "text")):
                pieces = cut(text, chunk, overlap)
                for k, (at, own) in enumerate(pieces):
                    row = kept.take(pa.array([i if k == 0 else None], pa.int64()))  # the row rides with its first chunk
                    yield pa.RecordBatch.from_arrays([row, pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([k], pa.int32()), pa.array([at], pa.int64()), pa.array([own])], names=["row", "part", "number", "k", "at", "text"])
                n += 1

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at, text = column(batch, "at")[i].as_py(), column(batch, "text")[i].as_py()
                marks = boundaries(text) + at
                left, right = marks[(marks > at) & (marks <= at + overlap)], marks[marks >= at + chunk]
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([left.tolist()], pa.list_(pa.int64())), pa.array([right.tolist()], pa.list_(pa.int64()))], names=[*one.schema.names, "left", "right"])

    key = ["part", "number"]
    # written, so that a text keeps its number whatever is computed anew
    chunks = written(long.mapInArrow(spread, f"row {row_type}, part int, number int, k int, at long, text string"), "chunks")
    scanned = chunks.repartition(*key, "k").mapInArrow(scan, f"row {row_type}, part int, number int, k int, at long, text string, left array<long>, right array<long>")
    order = Window.partitionBy(*key).orderBy("k")
    begin = F.when(F.col("k") > 0, F.array_min(F.array_intersect(F.lag("right").over(order), "left"))).otherwise(0)
    opened = scanned.withColumn("begin", begin).withColumn("next", F.lead("begin").over(order)).withColumn("more", F.lead("k").over(order).isNotNull())
    # a chunk gives its piece the characters up to the stitch with the next, or up to where the next one's own begin
    end = F.coalesce("next", F.when(F.col("more"), F.col("at") + chunk))
    start = F.coalesce("begin", "at")
    own = F.when(end.isNull(), F.substring("text", start - F.col("at") + 1, F.length("text"))).otherwise(F.substring("text", start - F.col("at") + 1, end - start))
    piece = F.sum(F.col("begin").isNotNull().cast("int")).over(order)
    pieces = opened.select("row", *key, "k", piece.alias("piece"), own.alias("text"))

    def fold_piece(parts):
        texts = "".join(t for p in parts for t in texts_of(p, "text"))
        first = parts[0].slice(0, 1)
        yield pa.RecordBatch.from_arrays([column(first, c) for c in ("row", *key, "piece")] + [pa.array([ids_of(vocabulary, texts).tobytes()], pa.binary())], names=["row", *key, "piece", "ids"])

    def fold_text(parts):
        first = parts[0].slice(0, 1)
        yield pa.RecordBatch.from_arrays([column(first, "row"), pa.array([b"".join(x for p in parts for x in column(p, "ids").to_pylist())], pa.binary())], names=["row", "ids"])

    encoded = grouped(pieces, [*key, "piece"], f"row {row_type}, part int, number int, piece long, ids binary", fold_piece, ["k"])
    joined = grouped(encoded, key, f"row {row_type}, ids binary", fold_text, ["piece"])
    return direct.unionByName(joined.select("row.*", "ids").select(*others, "ids"))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the raw bytes of the ids, concatenated (a null column of ids: no bytes)."""

    def make():
        table_ = encoding(vocabulary)

        def run(part: pa.RecordBatch) -> list:
            return [pa.array([table_.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in column(part, ids_col).to_pylist()], pa.binary())]

        return run

    return add_columns(encoded, ids_col, "decoded binary", make)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(docs, path), path)
    return both.select(*(c for c in both.columns if c not in ("ids", "decoded")), (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
