"""The data source ``ziparchive``: members of ZIP files as rows.

Catalogs are read on the driver from the ends of the files, by ranged reads; members are dealt to partitions by their
stored bytes, and a task seeks straight to its own. Equality on filename or ordinal is pushed down, so a lookup
reads one member. Option ``content`` false leaves data out. Writing makes one archive of each partition.

Paths are ones that the driver and all executors mount. For other stores read ``binaryFile`` and use zip_members.
"""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from ..functions import archive as A
from ..functions.options import CodecError, Options

SCHEMA = "archive string, ordinal int, filename string, file_size long, compress_size long, crc long, compress_type int, mtime long, comment binary, external_attr long, header_offset long, is_dir boolean, data binary"
TAIL = 22 + 0xFFFF + 20
PARTITION_BYTES = 32 << 20


def read_catalog(path: str) -> list[A.Entry]:
    """A file's catalog, without reading its members: the end, then as much before it as the directory takes."""
    with open(path, "rb") as f:
        size = f.seek(0, os.SEEK_END)
        held = min(size, TAIL)
        while True:
            f.seek(size - held)
            try:
                return A.catalog(f.read(held), size - held)[0]
            except A.NeedsMore as e:
                held = size - e.at


@dataclass
class Members(InputPartition):
    path: str
    entries: list


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.content = options["path"], str(options.get("content", "true")).lower() != "false"
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted: dict[str, object] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("filename",), ("ordinal",)):
                self.wanted[f.attribute[0]] = f.value
            yield f  # Spark checks them again: both kinds of null stay Spark's

    def partitions(self):
        out = []
        for path in paths_of(self.path):
            own = [e for e in read_catalog(path) if all(getattr(e, k) == v for k, v in self.wanted.items())]
            part, used = [], 0
            for e in own:
                if part and used + e.compress_size > self.size:
                    out.append(Members(path, part))
                    part, used = [], 0
                part.append(e)
                used += e.compress_size
            if part:
                out.append(Members(path, part))
        return out or [Members("", [])]

    def read(self, partition):
        if not partition.entries:
            return
        with open(partition.path, "rb") as f:
            for e in partition.entries:
                data = None
                if self.content:
                    f.seek(e.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise CodecError(f"bad local header of {e.filename}")
                    rest = f.read(int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little") + e.compress_size)
                    data = A.read_member(head + rest, A.Entry(**{**e.__dict__, "header_offset": 0}))
                yield (partition.path, e.ordinal, e.filename, e.file_size, e.compress_size, e.crc, e.compress_type, e.mtime, e.comment, e.external_attr, e.header_offset, e.is_dir, data)


def paths_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "**", "*.zip"), recursive=True))
    found = sorted(glob.glob(path))
    if not found:
        raise CodecError(f"{path} does not exist")
    return found


@dataclass
class Written(WriterCommitMessage):
    part: str
    name: str


class ZipWriter(DataSourceWriter):
    def __init__(self, options, schema, overwrite: bool):
        self.folder = options["path"].removeprefix("file://")
        self.names, self.overwrite = schema.names, overwrite
        self.options = Options(level=int(options.get("level", -1)))
        missing = {"filename", "data"}.difference(self.names)
        if missing:
            raise CodecError(f"columns {sorted(missing)} are needed")
        if not overwrite and os.path.isdir(self.folder) and glob.glob(os.path.join(self.folder, "*.zip")) and str(options.get("exclusive", "false")).lower() == "true":
            raise CodecError(f"{self.folder} exists")

    def write(self, rows):
        members = []
        for r in rows:
            own = dict(zip(self.names, r, strict=True))
            name = own["filename"].replace("\\", "/").lstrip("/")
            members.append((name, bytes(own["data"] or b""), own.get("compress_type", A.DEFLATE)))
        if not members:
            return Written("", "")
        os.makedirs(self.folder, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.zip"
        with open(part := os.path.join(self.folder, f".{name}.tmp"), "wb") as f:
            f.write(A.build(members, self.options))
        return Written(part, os.path.join(self.folder, name))

    def commit(self, messages):
        old = glob.glob(os.path.join(self.folder, "*.zip")) if self.overwrite else []
        for m in messages:
            if m and m.part:
                os.replace(m.part, m.name)
        for path in old:
            os.remove(path)

    def abort(self, messages):
        for m in messages:
            if m and m.part and os.path.exists(m.part):
                os.remove(m.part)


class ZipArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ziparchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return ZipReader(self.options)

    def writer(self, schema, overwrite):
        return ZipWriter(self.options, schema, overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipArchiveSource)
