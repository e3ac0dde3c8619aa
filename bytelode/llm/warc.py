"""WARC archives, each record a Zstandard frame of its own, all with one dictionary.

A dictionary is built from at most ``DICTIONARY_RECORDS`` archived records (those of the smallest hash of the id, of
at most ``DICTIONARY_RECORD_BYTES`` each); it only affects sizes. Every archive starts with a skippable frame that
holds it, as archives of the kind do, so any reader finds it there. Archives are written by Spark's own text writer:
a row is a frame, and the line separator is an empty skippable frame, which decoders skip. So files are committed as
any Spark output is, on any file system, survive a lost executor, and have the names that the writer gives.

They are read back by Spark's text reader with that separator, which splits large archives between tasks; a task holds
a record at a time. The writer sees to it that no frame holds the separator's bytes. Frames name their dictionary by
its number, so that each is decoded with that of its archive. ``frames`` reads any archive of this kind in memory,
with separators or without.

Of records with equal payloads of ``least`` bytes or more, that of the largest id is a response and the others are
revisits of it. A null payload is empty. A null url has no target header; a row without id is no record's largest,
and is a response where no row of its payload has an id. Rows that repeat the largest id with its payload are all
responses. Columns other than the three named are left out.

Html is not shuffled while at most ``BROADCAST_ROWS`` rows are revisits, which are then broadcast (three small fields
each); beyond that, revisits and rows meet in a join by id and digest, which shuffles the html once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import column
from ._shared import bounded_sample, scratch, table, tuned, written

DICTIONARY_RECORDS, DICTIONARY_RECORD_BYTES, DICTIONARY_BYTES = 400, 1 << 16, 1 << 16
#: Magic of the frame with the dictionary, and an empty skippable frame.
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
SEPARATOR_BYTES = SEPARATOR.encode()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("a57a3f0e-6d0b-5d43-9a52-0d6f1f6f2b11")
#: Rows of revisits up to which they are broadcast.
BROADCAST_ROWS = 50_000
FEED = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}:{payload_digest}')}>"


def record(page: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, date: str) -> bytes:
    """A WARC/1.1 record."""
    name = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page, name), "WARC-Date": date, "WARC-Payload-Digest": f"sha1:{name}"}
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if page is not None:
        head["WARC-Page-ID"] = str(page)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, name), "WARC-Refers-To-Page-ID": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; the digest of a whole payload is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out = {"record_type": fields["WARC-Type"], "page_id": fields.get("WARC-Page-ID"), "refers_to": fields.get("WARC-Refers-To-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_id": fields["WARC-Record-ID"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(re.search(rb"(?im)^content-length: *(\d+)", http)[1]), "payload": None}
    if digest(payload) != out["payload_digest"]:
        raise ValueError(f"payload digest of {out['record_id']} differs")
    return out | {"payload_bytes": len(payload), "payload": payload}


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples' own bytes (none: no dictionary)."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] if sum(map(len, samples)) >= 8 else b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary


def frames(archive: bytes):
    """The decoded frames of an archive, with the dictionary of its leading frame."""
    import zstandard

    view, at = memoryview(archive), 0
    decoder = zstandard.ZstdDecompressor()
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == 0x184D2A5D and at == 0:
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        one, parts, fed = decoder.decompressobj(), [], at
        while not one.eof:
            if fed >= len(view):
                raise ValueError("the archive ends inside a frame")
            parts.append(one.decompress(view[fed : fed + FEED]))
            fed = min(fed + FEED, len(view))
        at = fed - len(one.unused_data)
        yield b"".join(parts)


def framed(record_bytes: bytes, encoders: list) -> bytes:
    """A record's frame, by the first encoder whose frame doesn't hold the separator (in practice the first)."""
    for encoder in encoders:
        out = encoder.compress(record_bytes)
        if SEPARATOR_BYTES not in out:
            return out
    raise ValueError("no encoding of a record is free of the separator")


def find_revisits(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """(id, sha, refers_to) of the rows that are revisits."""
    own = pages.select(F.col(id_col).alias("id"), F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary")).alias("sha"), F.coalesce(F.octet_length(payload_col), F.lit(0)).alias("size")).where(F.col("size") >= least)
    last = own.groupBy("sha", "size").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    last = written(last.select("sha", "size", "refers_to"), "equal-payloads")
    return written(own.join(last, ["sha", "size"]).where(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "sha", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> None:
    """Writes a folder of archives, one for each partition of ``pages``."""
    spark = tuned(pages.sparkSession)
    sample = pages.where((F.octet_length(payload_col) > 0) & (F.octet_length(payload_col) <= DICTIONARY_RECORD_BYTES)).select(id_col, url_col, payload_col)
    sample = bounded_sample(sample, id_col, DICTIONARY_RECORDS)
    dictionary = build_dictionary([record(r[0], r[1], r[2].encode(), None, False, date) for r in sample.collect()])
    revisits = find_revisits(pages, id_col, payload_col, least)
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    own = pages.select(F.col(id_col).alias("own"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")).withColumn("own_sha", F.sha1(F.col("payload").cast("binary")))
    rows = own.join(revisits, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha")), "left").select("own", "url", "payload", "refers_to", F.col("sha").isNotNull().alias("revisit"))

    def run(batches):
        import zstandard

        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoders = [zstandard.ZstdCompressor(level=k, dict_data=own, write_checksum=True) for k in (level, *range(1, 10))]
        first = True
        for batch in batches:
            for i in range(batch.num_rows):
                if first and dictionary:
                    yield pa.RecordBatch.from_arrays([pa.array([dictionary_frame(dictionary)], pa.binary())], names=["frame"])
                first = False
                page, url, payload, refers_to, revisit = (column(batch, c)[i].as_py() for c in ("own", "url", "payload", "refers_to", "revisit"))
                yield pa.RecordBatch.from_arrays([pa.array([framed(record(page, url, payload.encode(), refers_to, revisit, date), encoders)], pa.binary())], names=["frame"])

    rows.mapInArrow(run, "frame binary").select(F.expr("cast(frame AS string)").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark, path: str, id_type: str = "long", payload: bool = True) -> DataFrame:
    """One row for each record of the archives in a folder that ``write_archives`` made."""
    schema = "page_id string, refers_to string, url string, record_id string, record_type string, payload_bytes long, payload_digest string" + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    rows = tuned(spark).read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("frame"))
    leading = F.col("frame").substr(1, 4) == F.lit(DICTIONARY_MAGIC)
    # a folder has one dictionary, however many archives; of folders read together each has its own
    dictionaries = [bytes(r.frame) for r in rows.where(leading).distinct().collect()]

    def run(batches):
        import zstandard

        held = [zstandard.ZstdCompressionDict(d[8:]) for d in dictionaries]
        decoders = {d.dict_id(): zstandard.ZstdDecompressor(dict_data=d) for d in held}
        plain = zstandard.ZstdDecompressor()

        def decoded(frame: bytes) -> bytes:
            decoder = decoders.get(zstandard.get_frame_parameters(frame).dict_id, plain).decompressobj()
            out = decoder.decompress(frame)
            if not decoder.eof or decoder.unused_data:
                raise ValueError("an archive's frame is broken")
            return out

        for batch in batches:
            found, size = [], 0
            for frame in batch.column(0):
                found.append(parse(decoded(frame.as_py())))
                size += found[-1]["payload_bytes"] if payload else 0
                if size > FEED * 16:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds.get(n, pa.string())) for n in names], names=names)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds.get(n, pa.string())) for n in names], names=names)

    return rows.where(~leading).mapInArrow(run, schema).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` archived and read back."""
    path = scratch(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
