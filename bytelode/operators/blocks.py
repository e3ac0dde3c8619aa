"""Streams in blocks: split, deflate in parallel, put together in order.

A blob becomes rows of blocks by SQL; each is deflated on its own, with the bytes before it as a window or without;
CRC and Adler values are folded by commutative aggregates, as each block's share in the whole depends only on the bytes
that follow it, so they combine before the shuffle. The shuffle carries compressed bytes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.framing import zlib_head
from ..functions.options import PARALLEL_FROM, WINDOW, CodecError, Options


def split_blocks(blobs: DataFrame, content: str = "content", opts: Options = Options()) -> DataFrame:
    """``blobs`` with content replaced by seq, off, raw_len, total, is_last, raw and dict. An empty blob has one empty block.

    Blocks are cut, and the total taken, before they become rows, so that no row carries the whole blob with it. With
    ``threads``, a blob's size decides on that of its blocks.
    """
    size, c = F.octet_length(content), F.col(content)
    if opts.rsyncable:
        ends = C.block_ends(content, opts)
    else:
        step = C.adaptive_block(size, opts.threads) if opts.threads else F.lit(opts.block_size)
        ends = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), step), lambda off: F.least(off + step, size))
    keep = [x for x in blobs.columns if x != content]
    cut = blobs.select(*keep, c, size.cast("long").alias("total"), ends.alias("__ends"))

    def block(end: Column, i: Column) -> Column:
        off = F.when(i == 0, F.lit(0)).otherwise(F.get("__ends", i - 1))
        before = F.least(off, F.lit(WINDOW))
        window = F.unhex(F.lit("")) if opts.independent else c.substr(off - before + 1, before)
        return F.struct(off.cast("long").alias("off"), (end - off).cast("long").alias("raw_len"), c.substr(off + 1, end - off).alias("raw"), window.alias("dict"))

    rows = cut.select(*keep, "total", F.posexplode(F.transform("__ends", block)).alias("seq", "__b"))
    off, raw_len = F.col("__b.off"), F.col("__b.raw_len")
    return rows.select(*keep, "seq", off.alias("off"), raw_len.alias("raw_len"), "total", (off + raw_len == F.col("total")).alias("is_last"), F.col("__b.raw").alias("raw"), F.col("__b.dict").alias("dict"))


def deflate_blocks(blocks: DataFrame, opts: Options = Options()) -> DataFrame:
    """Adds comp, crc and adler to blocks."""
    return blocks.withColumns({"comp": C.deflate_block("raw", "dict", "is_last", opts), "crc": F.crc32("raw"), "adler": C.adler32("raw")}).drop("raw", "dict")


def fold_checksums(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, crc, adler, raw_len) of whole blobs from blocks with off, raw_len, total, crc and adler, in any order."""
    after = F.col("total") - F.col("off") - F.col("raw_len")
    shares = blocks.withColumns({"__after": after, "__share": C.crc32_shift(F.col("crc"), after)})
    return shares.groupBy(*keys).agg(F.bit_xor("__share").alias("crc"), C.adler32_total(F.col("adler"), F.col("__after")).alias("adler"), F.sum("raw_len").alias("raw_len"))


def stream_header(opts: Options, name: Column, comment: Column, mtime: Column) -> Column:
    """The header of a gzip, zlib or raw stream, in SQL."""
    if opts.format == "raw":
        return F.unhex(F.lit(""))
    if opts.format == "zlib":
        return F.unhex(F.lit(zlib_head(opts.zlib_level).hex()))
    if opts.format == "zip":
        raise CodecError("a ZIP's blocks are put together by zip_build")
    name = name if opts.store_name else F.lit("")
    zero = F.unhex(F.lit("00"))
    flags = F.when(name != "", 8).otherwise(0) + F.when(comment != "", 16).otherwise(0)
    effort = "02" if opts.zlib_level >= 9 else "04" if opts.zlib_level == 1 else "00"
    tail = [F.when(x != "", F.concat(F.encode(x, "UTF-8"), zero)).otherwise(F.unhex(F.lit(""))) for x in (name, comment)]
    return F.concat(F.unhex(F.lit("1F8B08")), C.pack_little_endian(flags, 1), C.pack_little_endian(mtime if opts.store_time else F.lit(0).cast("long"), 4), F.unhex(F.lit(effort + "03")), *tail)


def assemble(blocks: DataFrame, keys: list[str], opts: Options = Options(), name: Column | None = None, comment: Column | None = None, mtime: Column | None = None) -> DataFrame:
    """(keys, content, crc, adler, raw_len): the stream of each blob. One stream is one value, so at most 2 GiB."""
    after = F.col("total") - F.col("off") - F.col("raw_len")
    shares = blocks.withColumns({"__after": after, "__share": C.crc32_shift(F.col("crc"), after)})
    whole = shares.groupBy(*keys).agg(F.expr("listagg(comp) WITHIN GROUP (ORDER BY seq)").alias("__body"), F.bit_xor("__share").alias("crc"), C.adler32_total(F.col("adler"), F.col("__after")).alias("adler"), F.sum("raw_len").alias("raw_len"))
    head = stream_header(opts, F.lit("") if name is None else name, F.lit("") if comment is None else comment, F.lit(0).cast("long") if mtime is None else mtime)
    tail = {"raw": F.unhex(F.lit("")), "zlib": C.pack_big_endian(F.col("adler"), 4), "gzip": F.concat(C.pack_little_endian(F.col("crc"), 4), C.pack_little_endian(F.col("raw_len"), 4))}[opts.format]
    return whole.select(*keys, F.concat(head, F.col("__body"), tail).alias("content"), "crc", "adler", "raw_len")


def compress_in_blocks(blobs: DataFrame, keys: list[str], content: str = "content", opts: Options = Options()) -> DataFrame:
    """(keys, content, crc, adler, raw_len) by the block pipeline.

    With ``threads``, a blob's blocks are dealt over as many tasks, or fewer where it is small; else they stay in its own.
    """
    cut = split_blocks(blobs.select(*keys, content), content, opts)
    if opts.threads > 1:
        cut = cut.repartition(*keys, F.pmod("seq", C.thread_cap(F.col("total"), C.adaptive_block(F.col("total"), opts.threads), opts.threads)))
    return assemble(deflate_blocks(cut, opts), keys, opts)


def compress_blobs(blobs: DataFrame, keys: list[str], content: str = "content", opts: Options = Options(), parallel_from: int = PARALLEL_FROM) -> DataFrame:
    """(keys, content): small blobs are compressed where they lie, large ones in blocks over the cluster. Keys are unique."""
    if opts.format == "zip":
        return blobs.select(*keys, C.compress(content, opts).alias("content"))
    own = blobs.select(*keys, content)
    small = own.where(F.coalesce(F.octet_length(content), F.lit(0)) < parallel_from).select(*keys, C.compress(content, opts).alias("content"))
    large = compress_in_blocks(own.where(F.octet_length(content) >= parallel_from), keys, content, opts)
    return small.unionByName(large.select(*keys, "content"))
