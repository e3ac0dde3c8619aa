"""ZIP archives as tables: a row for each member.

Members are deflated and inflated in parallel. An archive is put together from its members' records by aggregates:
offsets are a running sum over lengths, so only metadata pass through the window. An archive is read by its directory:
SQL cuts the directory and then each member out of the value, so that Python gets these and never a whole archive.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import archive as A
from ..functions import columns as C
from ..functions.options import CodecError, Options
from ..functions.paths import is_unsafe, normalize_member, safe_path
from .streams import explode_rows, small_batches

ENTRY_SCHEMA = "ordinal int, filename string, file_size long, compress_size long, crc long, compress_type int, mtime long, comment binary, external_attr long, header_offset long, is_dir boolean"
MEMBER_SCHEMA = ENTRY_SCHEMA + ", data binary, error string"
#: 1980-01-01, the first date that an archive can hold.
EPOCH = 315_532_800


def _entry(e: A.Entry) -> dict:
    return {"ordinal": e.ordinal, "filename": e.filename, "file_size": e.file_size, "compress_size": e.compress_size, "crc": e.crc, "compress_type": e.compress_type, "mtime": e.mtime, "comment": e.comment, "external_attr": e.external_attr, "header_offset": e.header_offset, "is_dir": e.is_dir}


def entry_rows(data: bytes) -> list[dict]:
    return [_entry(e) for e in A.catalog(data)[0]]


def _read(data: bytes, e: A.Entry) -> dict:
    try:
        return {"data": A.read_member(data, e)}
    except CodecError as error:
        return {"error": str(error)}


def _explained(f, problem: str):
    """``f`` with ``problem`` before what it says of a bad archive."""

    def run(*args):
        try:
            return f(*args)
        except CodecError as e:
            raise CodecError(problem + str(e)) from None

    return run


_ENTRY_TYPES = [(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]]) for x in ENTRY_SCHEMA.split(", ")]


def _directory_entries(problem: str) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """From directories and where they begin: lists of their entries, column by column."""
    read = _explained(A.catalog, problem)

    def run(directories: pa.Array, starts: pa.Array) -> pa.Array:
        offsets, columns, n = [], [[] for _ in _ENTRY_TYPES], 0
        for data, start in zip(directories, starts, strict=True):
            offsets.append(n if data.is_valid else None)
            entries = read(data.as_py(), start.as_py())[0] if data.is_valid else []
            for own, (name, _) in zip(columns, _ENTRY_TYPES, strict=True):
                own += [getattr(e, name) for e in entries]
            n += len(entries)
        fields = pa.StructArray.from_arrays([pa.array(own, t) for own, (_, t) in zip(columns, _ENTRY_TYPES, strict=True)], names=[name for name, _ in _ENTRY_TYPES])
        return pa.ListArray.from_arrays(pa.array([*offsets, n], pa.int32()), fields)

    return run


def _with_directory(archives: DataFrame, keys: list[str], content: str, problem: str = "") -> DataFrame:
    """(keys, content, __size, __start, __directory): archives with the bytes from the beginning of their directories."""
    small_batches(archives.sparkSession)
    size = F.octet_length(content)
    gap = F.greatest(size - A.TAIL, F.lit(0))
    found = archives.select(*keys, content, size.alias("__size"), gap.alias("__gap"), F.substr(F.col(content), gap + 1, F.lit(A.TAIL)).alias("__tail"))
    found = found.withColumn("__start", C.arrow_function("long", _explained(A.directory_start, problem), "__tail", "__gap"))
    return found.select(*keys, content, "__size", "__start", F.substr(F.col(content), F.col("__start").cast("int") + 1, F.col("__size")).alias("__directory"))


def _entries(problem: str = "") -> Column:
    """The list of entries of a __directory."""
    return F.arrow_udf(_directory_entries(problem), f"array<struct<{', '.join(x.replace(' ', ': ') for x in ENTRY_SCHEMA.split(', '))}>>")("__directory", "__start")


def _number(data: Column, at: Column) -> Column:
    """Two bytes, the lower one first."""
    low, high = (F.conv(F.hex(F.substr(data, at + k, F.lit(1))), 16, 10).cast("int") for k in (1, 2))
    return low + 256 * high


def _record(data: Column, size: Column, e: Column) -> Column:
    """A member's local header and its stored bytes; less where the archive ends before."""
    at = F.least(e["header_offset"], size.cast("long")).cast("int")
    left = size - at
    names = F.when(left >= 30, _number(data, at + 26) + _number(data, at + 28)).otherwise(0)
    return F.substr(data, at + 1, F.least(30 + names + F.least(e["compress_size"], left.cast("long")), left.cast("long")).cast("int"))


def _each_member(archives: DataFrame, keys: list[str], content: str, schema: str, f, problem: str = "") -> DataFrame:
    """Rows that ``f`` makes of each member's record and entry."""
    names = [name for name, _ in _ENTRY_TYPES if name != "is_dir"]
    # the outer lambda holds the value of the column, which the inner one would copy for each member
    cut = F.transform(F.array(content), lambda c: F.transform("__entries", lambda e: F.struct(_record(c, F.col("__size"), e).alias("__record"), *(e[name].alias(name) for name in names))))
    found = _with_directory(archives, keys, content, problem).withColumn("__entries", _entries(problem))
    members = found.select(*keys, F.explode(cut[0]).alias("__m")).select(*keys, F.col("__m.__record").alias("__record"), *(F.col(f"__m.{name}").alias(f"__{name}") for name in names))
    return explode_rows(members, keys, ["__record", *(f"__{name}" for name in names)], schema, lambda record, *own: [f(record, A.Entry(*own))])


def zip_entries(archives: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """The catalog of each archive; no member is read."""
    found = _with_directory(archives, keys, content)
    return found.select(*keys, F.explode(_entries()).alias("__e")).select(*keys, "__e.*")


def zip_members(archives: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """The catalog with each member's data, or the error of reading it."""
    return _each_member(archives, keys, content, MEMBER_SCHEMA, lambda record, e: _entry(e) | _read(record, replace(e, header_offset=0)))


def date_time(mtime: Column) -> Column:
    """The six fields of a member's date."""
    t = F.timestamp_seconds(mtime)
    return F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).alias("second"))


def last_of_each_name(entries: DataFrame, keys: list[str]) -> DataFrame:
    """What a lookup by name sees: of equal names the last."""
    own = [c for c in entries.columns if c not in keys]
    return entries.groupBy(*keys, F.col("filename").alias("__name")).agg(F.max_by(F.struct(*own), F.col("ordinal")).alias("__e")).select(*keys, "__e.*")


def lookup(entries: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The entry of a name in each archive; none where it is missing."""
    return last_of_each_name(entries.where(F.col("filename") == normalize_member(F.lit(name))), keys)


def contains(entries: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(keys, found) of each archive: whether a name, normalised, is in its catalog."""
    return entries.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("filename") == normalize_member(F.lit(name))), F.lit(False)).alias("found"))


def read_by_name(members: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(keys, data) of the last member of a name; an error where an archive has none, or it can't be read."""
    wanted = normalize_member(F.lit(name))
    last = F.max_by(F.struct("data", "error"), F.when(F.col("filename") == wanted, F.col("ordinal")))
    return _read_or_raise(members.groupBy(*keys).agg(last.alias("__m")), keys, F.concat(F.lit("no such member: "), wanted))


def read_by_index(members: DataFrame, index: int, keys: list[str]) -> DataFrame:
    """(keys, data) of the member at a place; an error where an archive ends before it, or it can't be read."""
    at = F.max_by(F.struct("data", "error"), F.when(F.col("ordinal") == index, F.col("ordinal")))
    return _read_or_raise(members.groupBy(*keys).agg(at.alias("__m")), keys, F.lit(f"no member at {index}"))


def _read_or_raise(found: DataFrame, keys: list[str], missing: Column) -> DataFrame:
    problem = F.when(F.col("__m").isNull(), missing).otherwise(F.col("__m.error"))
    return found.select(*keys, F.when(problem.isNotNull(), F.raise_error(problem).cast("binary")).otherwise(F.col("__m.data")).alias("data"))


def info(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The catalog as an info record: filename, file_size, compress_size, CRC, compress_type, date_time, is_dir, comment."""
    return entries.select(*keys, "filename", "file_size", "compress_size", F.col("crc").alias("CRC"), "compress_type", date_time(F.col("mtime")).alias("date_time"), "is_dir", "comment")


def short_info(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The catalog under the names that browsers are given."""
    return entries.select(*keys, F.col("filename").alias("name"), F.col("file_size").alias("size"), F.col("compress_size").alias("compressedSize"), F.col("crc").alias("crc32"), F.col("compress_type").alias("method"), F.col("is_dir").alias("isDir"))


def names(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Names in archive order, repeated ones included."""
    return entries.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "filename"))), lambda e: e["filename"]).alias("names"))


def test_archives(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_bad): the first member, folders aside, that can't be read."""
    return members.groupBy(*keys).agg(F.min_by("filename", F.when(F.col("error").isNotNull() & ~F.col("is_dir"), F.col("ordinal"))).alias("first_bad"))


def checked_members(rows: DataFrame) -> DataFrame:
    """Rows to archive (filename, data; optional compress_type, compress_level, mtime, comment, is_dir) with names normalised."""
    name = normalize_member(F.col("filename"))
    if "is_dir" in rows.columns:
        name = F.when(F.col("is_dir") & ~name.endswith("/"), F.concat(name, F.lit("/"))).otherwise(name)
    name = F.when(F.coalesce(name, F.lit("")).isin("", "/"), F.raise_error(F.lit("a member needs a name")).cast("string")).otherwise(name)
    defaults = {"compress_type": F.lit(A.DEFLATE), "mtime": F.lit(EPOCH).cast("long"), "comment": F.unhex(F.lit(""))}
    own = {k: F.coalesce(F.col(k), v) if k in rows.columns else v for k, v in defaults.items()}
    return rows.withColumns({**own, "filename": name}).withColumn("data", F.when(F.col("filename").endswith("/"), F.unhex(F.lit(""))).otherwise(F.coalesce("data", F.unhex(F.lit("")))))


def packed_members(rows: DataFrame, keys: list[str], opts: Options = Options()) -> DataFrame:
    """(keys, ordinal, filename, method, crc, raw_len, stored, mtime, comment, external_attr) of rows to archive.

    A member's own compress_type and compress_level go before the options; its external_attr may be null.
    """
    level = F.col("compress_level").cast("int") if "compress_level" in rows.columns else F.lit(None).cast("int")
    attr = F.col("external_attr").cast("long") if "external_attr" in rows.columns else F.lit(None).cast("long")
    packed = checked_members(rows).withColumn("__p", C.zip_pack("data", "filename", "compress_type", level, opts))
    return packed.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), "filename", "__p.method", "__p.crc", F.octet_length("data").cast("long").alias("raw_len"), "__p.stored", "mtime", "comment", attr.alias("external_attr"))


#: Where a central header has its member's offset. An archive is one value, so that offsets never need 64 bits.
_OFFSET_AT = 42


def _directory_end(n: Column, size: Column, at: Column, comment: Column) -> Column:
    """``framing.directory_end`` in SQL, for archives of at most 2 GiB."""
    wide = F.concat(F.lit(struct.pack("<IQHHII", 0x06064B50, 44, 45, 45, 0, 0)), *(C.pack_little_endian(x, 8) for x in (n, n, size, at)), F.lit(struct.pack("<II", 0x07064B50, 0)), C.pack_little_endian(at + size, 8), F.lit(struct.pack("<I", 1)))
    count, length = C.pack_little_endian(F.least(n, F.lit(0xFFFF)), 2), F.octet_length(comment)
    length = F.when(length > 0xFFFF, F.raise_error(F.lit("an archive's comment is too long")).cast("int")).otherwise(length)
    end = F.concat(F.lit(struct.pack("<IHH", 0x06054B50, 0, 0)), count, count, C.pack_little_endian(size, 4), C.pack_little_endian(at, 4), C.pack_little_endian(length, 2), comment)
    return F.concat(F.when(n > 0xFFFE, wide).otherwise(F.unhex(F.lit(""))), end)


def zip_assemble(packed: DataFrame, keys: list[str], comments: DataFrame | None = None) -> DataFrame:
    """(keys, content, members): an archive for each key of packed members. comments: (keys, comment) of archives."""
    size = F.octet_length("stored").cast("long")
    local = C.arrow_function("binary", A.local_header, "filename", "method", "mtime", "crc", size, "raw_len")
    central = C.arrow_function("binary", A.central_header, "filename", "method", "mtime", "crc", size, "raw_len", F.lit(0).cast("long"), "comment", "external_attr")
    packed = packed.withColumns({"__size": size, "__local": local, "__central": central})
    # no Python behind the window: its partitions serve the aggregate too, so that members are shuffled once
    order = Window.partitionBy(*keys).orderBy("ordinal")
    before = F.coalesce(F.sum(F.octet_length("__local") + F.col("__size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    packed = packed.withColumn("__offset", before)
    header = F.concat(F.substr("__central", F.lit(1), F.lit(_OFFSET_AT)), C.pack_little_endian(F.col("__offset"), 4), F.substr("__central", F.lit(_OFFSET_AT + 5)))
    packed = packed.select(*keys, "ordinal", header.alias("__header"), F.concat("__local", "stored").alias("__record"))
    whole = packed.groupBy(*keys).agg(F.expr("listagg(__record) WITHIN GROUP (ORDER BY ordinal)").alias("__body"), F.expr("listagg(__header) WITHIN GROUP (ORDER BY ordinal)").alias("__dir"), F.count("*").alias("members"))
    whole = whole.withColumn("__comment", F.unhex(F.lit(""))) if comments is None else whole.join(comments.withColumnRenamed("comment", "__comment"), keys, "left")
    end = _directory_end(F.col("members"), F.octet_length("__dir").cast("long"), F.octet_length("__body").cast("long"), F.coalesce("__comment", F.unhex(F.lit(""))))
    return whole.select(*keys, F.concat("__body", "__dir", end).alias("content"), "members")


def zip_build(rows: DataFrame, keys: list[str], opts: Options = Options(), comment: Column | None = None) -> DataFrame:
    """(keys, content, members): an archive for each key of rows (ordinal, filename, data, ...). At most 2 GiB each."""
    comments = None if comment is None else rows.select(*keys).distinct().withColumn("comment", comment)
    return zip_assemble(packed_members(rows, keys, opts), keys, comments)


PACKED_SCHEMA = "ordinal long, filename string, method int, crc long, raw_len long, stored binary, mtime long, comment binary, external_attr long"


_CORRUPT = "can't append to a corrupt archive: "


def _packed(record: bytes, e: A.Entry) -> dict:
    """A member as it lies in its archive, read once to see that it is whole."""
    own = replace(e, header_offset=0)
    _explained(A.read_member, _CORRUPT)(record, own)
    return {"ordinal": e.ordinal, "filename": e.filename, "method": e.compress_type, "crc": e.crc, "raw_len": e.file_size, "stored": A.stored_member(record, own), "mtime": e.mtime or 0, "comment": e.comment, "external_attr": e.external_attr}


def zip_append(archives: DataFrame, rows: DataFrame, keys: list[str], opts: Options = Options(), content: str = "content") -> DataFrame:
    """Archives with further members behind those that they have; a key without an archive begins one.

    The old members keep their stored bytes, dates, comments and attributes, and the archive its comment. Extra fields of
    headers are written anew.
    """
    old = _each_member(archives, keys, content, PACKED_SCHEMA, _packed, _CORRUPT)
    last = old.groupBy(*keys).agg(F.max("ordinal").alias("__last"))
    new = rows.join(last, keys, "left").withColumn("ordinal", F.col("ordinal").cast("long") + F.coalesce(F.col("__last") + 1, F.lit(0))).drop("__last")
    return zip_assemble(old.unionByName(packed_members(new, keys, opts)), keys, archive_comments(archives, keys, content))


def archive_comments(archives: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, comment) of each archive."""
    comment = C.arrow_function("binary", lambda d, start: A.catalog(d, start)[2], "__directory", "__start")
    return _with_directory(archives, keys, content).select(*keys, comment.alias("comment"))


def extract(members: DataFrame, folder: str) -> int:
    """Writes members (filename, data, is_dir, error) under a folder that all executors mount; returns their number.

    Names are judged before anything is written: one unsafe name, or one broken member, fails the call.
    """
    if not members.where(is_unsafe(F.col("filename")) | F.col("error").isNotNull()).isEmpty():
        raise CodecError("an unsafe path or a broken member")

    def write(batches):
        for batch in batches:
            for r in batch.to_pylist():
                target = os.path.join(folder, r["path"])
                if r["is_dir"]:
                    os.makedirs(target, exist_ok=True)
                else:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.part-{os.getpid()}"
                    with open(part, "wb") as f:
                        f.write(r["data"])
                    os.replace(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = members.select(safe_path(F.col("filename")).alias("path"), "data", "is_dir")
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL: zip_entries, zip_members, gzip_members and png_chunks, used with LATERAL."""
    from pyspark.sql.functions import udtf

    from ..functions import png
    from .streams import MEMBER_SCHEMA as STREAM_SCHEMA
    from .streams import member_rows

    def table_function(name: str, schema: str, f) -> None:
        fields = [x.strip().split()[0] for x in schema.split(",")]

        class Rows:
            def eval(self, data):
                if data is not None:
                    for r in f(bytes(data)):
                        yield tuple(r.get(n) for n in fields)

        spark.udtf.register(name, udtf(Rows, returnType=schema))

    table_function("zip_entries", ENTRY_SCHEMA, entry_rows)
    table_function("zip_members", MEMBER_SCHEMA, lambda d: (_entry(e) | _read(d, e) for e in A.catalog(d)[0]))
    table_function("gzip_members", STREAM_SCHEMA, member_rows)
    table_function("png_chunks", "ordinal int, type string, length int, data binary, crc long", lambda d: [{"ordinal": i, "type": k.decode("latin-1"), "length": len(b), "data": b, "crc": c} for i, (k, b, c) in enumerate(png.chunks(d))])
