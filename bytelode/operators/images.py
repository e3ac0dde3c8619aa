"""Images as tables: pixels, scanlines and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import png
from ..functions.options import CodecError
from .streams import explode_bytes

CHUNK_SCHEMA = "ordinal int, type string, length int, data binary, crc long"
LINE_SCHEMA = "row_idx int, filter int, score long, bytes binary"


def encode_images(images: DataFrame, **options) -> DataFrame:
    """Adds ``content``, the PNG of (width, height, channels, pixels)."""
    return images.withColumn("content", C.png_encode("pixels", "width", "height", "channels", **options))


def decode_images(files: DataFrame, content: str = "content") -> DataFrame:
    """Replaces ``content`` by width, height, channels and pixels."""
    return files.withColumn("__i", C.png_decode(content)).select(*(c for c in files.columns if c != content), "__i.*")


def image_chunks(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row for each chunk, its CRC checked."""
    return explode_bytes(files, keys, content, CHUNK_SCHEMA, lambda d: [{"ordinal": i, "type": k.decode("latin-1"), "length": len(b), "data": b, "crc": c} for i, (k, b, c) in enumerate(png.chunks(d))])


def scanlines(images: DataFrame, keys: list[str], mode: str = "adaptive-all") -> DataFrame:
    """Each row of each image under the filter that ``mode`` chooses, with its score."""
    if mode not in png.FILTERS:
        raise CodecError(f"unknown filter {mode!r}")
    head = F.concat(*(C.pack_big_endian(F.col(c).cast("long"), 4) for c in ("width", "height", "channels")), F.col("pixels"))

    def rows(data: bytes) -> list[dict]:
        w, h, c = (int.from_bytes(data[4 * k : 4 * k + 4], "big") for k in range(3))
        kinds, lines = png.choose(data[12:], w, h, c, mode)
        scores = png.scores(lines)
        return [{"row_idx": i, "filter": int(kinds[i]), "score": int(scores[i]), "bytes": lines[i].tobytes()} for i in range(h)]

    return explode_bytes(images.select(*keys, head.alias("__image")), keys, "__image", LINE_SCHEMA, rows)


def vector_images(vectors: DataFrame, vector: str, width: int, height: int) -> DataFrame:
    """Adds one-channel images of vectors of numbers from -1 to 1."""
    value = lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255))
    pixels = F.unhex(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(value(x)), 2, "0")), ""))
    return vectors.withColumns({"width": F.lit(width), "height": F.lit(height), "channels": F.lit(1), "pixels": pixels})
