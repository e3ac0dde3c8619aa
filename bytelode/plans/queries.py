"""Registered queries: the engine's operators over the driver's tables, and the same results in SQL.

Encoded bytes are never compared: parity is of decoded bytes, checksums, catalogs and errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import archive, paths
from ..functions import columns as C
from ..functions.options import STRATEGIES, Options
from ..functions.png import PRESETS, preset
from ..operators import blocks as B
from ..operators import containers as Z
from ..operators import images as I
from ..operators import streams as S
from ..operators.summary import split_members, summarize_runs
from ..sources import corpus

SMALL_BLOCK = 4096
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def small(**fields) -> Options:
    """Options with blocks small enough that the tables' texts have several."""
    return Options(block_size=SMALL_BLOCK, min_block=1, **fields)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    S.small_batches(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # dates in archives have no zone; they are taken in UTC
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(c: str) -> Column:
    return F.encode(c, "UTF-8")


def text(c: Column) -> Column:
    return F.decode(c, "UTF-8")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", utf8("text").alias("content"))


# SQL: the bytes of a string s, and CRC-32 and Adler-32 of a list of bytes

BYTES = "list_transform(range(octet_length(encode({s}))), lambda i: ('0x' || substr(hex(encode({s})), (2 * i + 1)::BIGINT, 2))::BIGINT)"


def _table() -> str:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return "[" + ", ".join(map(str, out)) + "]::BIGINT[]"


def sql_crc(s: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {BYTES.format(s=s)}), lambda c, x: xor(c >> 8, ({_table()})[(xor(c, x) & 255) + 1])), 4294967295)"


def sql_adler(s: str) -> str:
    b, n = BYTES.format(s=s), f"octet_length(encode({s}))"
    return f"((({n} + coalesce(list_sum(list_transform({b}, lambda v, i: ({n} - i + 1) * v)), 0)) % 65521) * 65536 + (1 + coalesce(list_sum({b}), 0)) % 65521)::BIGINT"


DOCUMENTS = "SELECT doc_id, text FROM documents"

# round trips


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS raw_len, true AS ok FROM documents")
def gzip_guarantee(spark, sf_dir):
    d = blobs(spark, sf_dir).withColumn("back", C.inflate_auto(C.gzip_compress("content")))
    return d.select("doc_id", F.octet_length("content").cast("long").alias("raw_len"), ((F.col("back") == F.col("content")) & (F.crc32("back") == F.crc32("content"))).alias("ok"))


@query(DOCUMENTS)
def gzip_roundtrip(spark, sf_dir):
    return blobs(spark, sf_dir).select("doc_id", text(C.inflate_auto(C.gzip_compress("content"))).alias("text"))


@query(DOCUMENTS)
def zlib_roundtrip(spark, sf_dir):
    return blobs(spark, sf_dir).select("doc_id", text(C.inflate_auto(C.zlib_compress("content"))).alias("text"))


@query(DOCUMENTS)
def raw_roundtrip(spark, sf_dir):
    return blobs(spark, sf_dir).select("doc_id", text(C.inflate_raw(C.raw_deflate("content"))).alias("text"))


@query(DOCUMENTS)
def zip_stream_roundtrip(spark, sf_dir):
    packed = C.compress("content", Options(format="zip"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return blobs(spark, sf_dir).select("doc_id", text(C.inflate_auto(packed)).alias("text"))


@query(f"SELECT r_name AS name, strategy FROM (SELECT r_name FROM region UNION ALL SELECT n_name FROM nation) CROSS JOIN (VALUES {', '.join(f'({s!r})' for s in STRATEGIES)}) AS v(strategy)")
def strategy_roundtrip(spark, sf_dir):
    names = read(spark, sf_dir, "region").select(F.col("r_name").alias("name")).unionAll(read(spark, sf_dir, "nation").select("n_name"))
    out = None
    for s in STRATEGIES:
        one = names.select(text(C.inflate_auto(C.zlib_compress(utf8("name"), strategy=s))).alias("name"), F.lit(s).alias("strategy"))
        out = one if out is None else out.unionAll(one)
    return out


LEVELS = (-1, *range(10), 11)


@query(f"SELECT n_name AS name, level FROM nation CROSS JOIN (VALUES {', '.join(f'({k})' for k in LEVELS)}) AS v(level)")
def level_roundtrip(spark, sf_dir):
    names = read(spark, sf_dir, "nation")
    out = None
    for k in LEVELS:
        one = names.select(text(C.inflate_auto(C.gzip_compress(utf8("n_name"), k))).alias("name"), F.lit(k).alias("level"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT doc_id, true AS smaller FROM documents")
def level_order(spark, sf_dir):
    """Level 9 is never larger than level 1 by more than a block's overhead."""
    d = blobs(spark, sf_dir)
    return d.select("doc_id", (F.octet_length(C.gzip_compress("content", 9)) <= F.octet_length(C.gzip_compress("content", 1)) + 16).alias("smaller"))


# blocks


@query(f"""SELECT doc_id, (off // {SMALL_BLOCK})::INT AS seq, off::BIGINT AS off, least({SMALL_BLOCK}, n - off)::BIGINT AS raw_len, off + {SMALL_BLOCK} >= n AS is_last
FROM (SELECT doc_id, octet_length(encode(text)) AS n, unnest(range(0, greatest(octet_length(encode(text)), 1), {SMALL_BLOCK})) AS off FROM documents)""")
def block_plan(spark, sf_dir):
    return B.split_blocks(blobs(spark, sf_dir), opts=small()).select("doc_id", "seq", "off", "raw_len", "is_last")


@query(f"""SELECT doc_id, (off // {SMALL_BLOCK})::INT AS seq, least(off, 32768)::BIGINT AS dict_len
FROM (SELECT doc_id, unnest(range(0, greatest(octet_length(encode(text)), 1), {SMALL_BLOCK})) AS off FROM documents)""")
def block_dict_len(spark, sf_dir):
    return B.split_blocks(blobs(spark, sf_dir), opts=small()).select("doc_id", "seq", F.octet_length("dict").cast("long").alias("dict_len"))


def in_blocks(spark, sf_dir, opts: Options) -> DataFrame:
    done = B.compress_in_blocks(blobs(spark, sf_dir), ["doc_id"], opts=opts)
    back = C.inflate_raw("content") if opts.format == "raw" else C.inflate_auto("content")
    return done.select("doc_id", text(back).alias("text"))


@query(DOCUMENTS)
def block_gzip_roundtrip(spark, sf_dir):
    return in_blocks(spark, sf_dir, small())


@query(DOCUMENTS)
def block_zlib_roundtrip(spark, sf_dir):
    return in_blocks(spark, sf_dir, small(format="zlib"))


@query(DOCUMENTS)
def independent_roundtrip(spark, sf_dir):
    return in_blocks(spark, sf_dir, small(independent=True))


@query(DOCUMENTS)
def rsync_roundtrip(spark, sf_dir):
    return in_blocks(spark, sf_dir, small(rsyncable=True))


@query(DOCUMENTS)
def planned_roundtrip(spark, sf_dir):
    """Small blobs whole, large ones in blocks."""
    done = B.compress_blobs(blobs(spark, sf_dir), ["doc_id"], opts=small(), parallel_from=SMALL_BLOCK)
    return done.select("doc_id", text(C.inflate_auto("content")).alias("text"))


@query(DOCUMENTS)
def independent_block_decode(spark, sf_dir):
    opts = small(independent=True)
    packed = B.deflate_blocks(B.split_blocks(blobs(spark, sf_dir), opts=opts), opts).withColumn("raw", C.inflate_part("comp"))
    return packed.groupBy("doc_id").agg(text(F.expr("listagg(raw) WITHIN GROUP (ORDER BY seq)")).alias("text"))


@query(f"""WITH b AS (SELECT conv_id, turn, unnest({BYTES.format(s='text')}) AS v, unnest(range(octet_length(encode(text)))) AS i FROM conversations),
h AS (SELECT conv_id, turn, i, {", ".join(f"lag(v, {k}, 0) OVER w AS v{k}" for k in range(12))} FROM b WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
x AS (SELECT conv_id, turn, i, {"xor(" * 12 + "0::BIGINT" + "".join(f", (v{k} << {k}) & 4095)" for k in range(12))} AS x FROM h),
c AS (SELECT conv_id, turn, count(*) AS n_cuts, sum(i + 1) AS sum_cuts FROM x WHERE (CASE WHEN i < 12 THEN xor(x, (2047 << (i + 1)::INT) & 4095) ELSE x END) = 2047 GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(n_cuts, 0)::BIGINT AS n_cuts, coalesce(sum_cuts, 0)::BIGINT AS sum_cuts FROM conversations LEFT JOIN c USING (conv_id, turn)""")
def rsync_cuts(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").withColumn("cuts", C.rolling_cuts(utf8("text")))
    return d.select("conv_id", "turn", F.size("cuts").cast("long").alias("n_cuts"), F.aggregate("cuts", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_cuts"))


@query("""SELECT doc_id, n AS size, CASE WHEN n // 2097152 >= 32 THEN 2097152 WHEN n // 1048576 >= 32 THEN 1048576 WHEN n // 524288 >= 32 THEN 524288 WHEN n // 262144 >= 32 THEN 262144 ELSE 131072 END::BIGINT AS block,
least(8, greatest(1, n // 262144))::BIGINT AS threads FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents)""")
def adaptive_blocks(spark, sf_dir):
    d = blobs(spark, sf_dir).select("doc_id", F.octet_length("content").cast("long").alias("size"))
    return d.select("doc_id", "size", C.adaptive_block(F.col("size"), 8).cast("long").alias("block"), C.thread_cap(F.col("size"), F.lit(131072), 8).cast("long").alias("threads"))


# checksums


@query(f"SELECT p_partkey, {sql_crc('p_name')}::BIGINT AS crc FROM part")
def crc32_col(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.crc32(utf8("p_name")).alias("crc"))


@query(f"SELECT p_partkey, {sql_adler('p_name')} AS adler FROM part")
def adler32_col(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", C.adler32(utf8("p_name")).alias("adler"))


def folded(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", utf8("text").alias("content"))
    opts = Options(block_size=64, min_block=1)
    parts = B.split_blocks(rows, opts=opts).withColumns({"crc": F.crc32("raw"), "adler": C.adler32("raw")})
    return B.fold_checksums(parts, ["item_id"])


@query(f"SELECT item_id, {sql_crc('text')}::BIGINT AS crc FROM benchmark")
def crc_combine_blocks(spark, sf_dir):
    return folded(spark, sf_dir).select("item_id", "crc")


@query(f"SELECT item_id, {sql_adler('text')} AS adler FROM benchmark")
def adler_combine_blocks(spark, sf_dir):
    return folded(spark, sf_dir).select("item_id", "adler")


# framing


@query("SELECT doc_id, 0 AS member, 'gzip' AS form, doc_id || '.txt' AS name, source AS comment, 1700000000 + doc_id AS mtime, octet_length(encode(text))::BIGINT AS raw_len FROM documents")
def gzip_header_fields(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("content", C.gzip_compress(utf8("text"), name=F.concat(F.col("doc_id"), F.lit(".txt")), comment=F.col("source"), mtime=F.col("doc_id") + 1700000000))
    return S.list_members(d, ["doc_id"]).select("doc_id", "member", "form", "name", "comment", "mtime", "raw_len")


@query("SELECT doc_id, form AS made, nullif(form, 'none') AS detected FROM documents CROSS JOIN (VALUES ('gzip'), ('zlib'), ('zip'), ('none')) AS v(form)")
def detect_format(spark, sf_dir):
    d, out = blobs(spark, sf_dir), None
    for form in ("gzip", "zlib", "zip", "none"):
        content = F.concat(F.unhex(F.lit("00")), F.col("content")) if form == "none" else C.compress("content", Options(format=form))
        one = d.select("doc_id", F.lit(form).alias("made"), C.detect_format(content).alias("detected"))
        out = one if out is None else out.unionAll(one)
    return out


@query("""WITH o AS (SELECT o_orderkey, o_orderdate + to_seconds((o_orderkey % 86400)::INT) AS t FROM orders)
SELECT o_orderkey, ((year(t) - 1980) * 33554432 + month(t) * 2097152 + day(t) * 65536 + hour(t) * 2048 + minute(t) * 32 + second(t) // 2)::BIGINT AS dos, (epoch(date_trunc('second', t))::BIGINT // 2 * 2)::BIGINT AS unix FROM o""")
def dos_time(spark, sf_dir):
    t = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    d = read(spark, sf_dir, "orders").select("o_orderkey", C.unix_to_dos(t).alias("dos"))
    return d.select("o_orderkey", "dos", F.unix_timestamp(C.dos_to_unix(F.col("dos"))).alias("unix"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS isize FROM documents")
def isize_hint(spark, sf_dir):
    return blobs(spark, sf_dir).select("doc_id", C.gzip_isize(C.gzip_compress("content")).alias("isize"))


@query("SELECT doc_id, text || source || text AS all_members, text AS first_member FROM documents")
def multi_member(spark, sf_dir):
    one = C.gzip_compress(utf8("text"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(one, C.gzip_compress(utf8("source")), C.gzip_compress(utf8("text"), 1)).alias("content"))
    return d.select("doc_id", text(C.inflate_auto("content")).alias("all_members"), text(C.inflate_auto("content", "first")).alias("first_member"))


@query("SELECT doc_id, member, name, raw_len::BIGINT AS raw_len FROM (SELECT doc_id, 0 AS member, 'a' AS name, octet_length(encode(text)) AS raw_len FROM documents UNION ALL SELECT doc_id, 1, lang, octet_length(encode(lang)) FROM documents)")
def gzip_list(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    content = F.concat(C.gzip_compress(utf8("text"), name=F.lit("a")), C.gzip_compress(utf8("lang"), name=F.col("lang")), F.unhex(F.lit("0000")))
    return S.list_members(d.select("doc_id", content.alias("content")), ["doc_id"]).select("doc_id", "member", "name", "raw_len")


FLIP = "CASE WHEN doc_id % 2 = 0 THEN 'CRC-32 mismatch' END"


@query(f"SELECT doc_id, doc_id % 2 = 1 AS ok, {FLIP} AS error FROM documents")
def verify_corrupt(spark, sf_dir):
    """The trailer of every other stream is broken; all streams are verified."""
    whole = blobs(spark, sf_dir).select("doc_id", C.gzip_compress("content").alias("z"))
    n = F.octet_length("z")
    bad = F.concat(F.col("z").substr(F.lit(1), n - 8), F.unhex(F.lpad(F.hex(C.little_endian(F.col("z"), n - 8, 4).bitwiseXOR(1)), 8, "0")), F.col("z").substr(n - 3, F.lit(4)))
    checked = whole.select("doc_id", C.verify(F.when(F.col("doc_id") % 2 == 0, bad).otherwise(F.col("z"))).alias("v"))
    return checked.select("doc_id", "v.ok", "v.error")


@query("SELECT doc_id, true AS failed FROM documents")
def truncated_streams(spark, sf_dir):
    z = C.gzip_compress("content")
    d = blobs(spark, sf_dir).select("doc_id", z.alias("z"))
    return d.select("doc_id", C.try_inflate(F.col("z").substr(F.lit(1), F.octet_length("z") - 9)).alias("t")).select("doc_id", F.col("t.error").isNotNull().alias("failed"))


# archives


def archives(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("ordinal"), F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("filename"), utf8("text").alias("data"))
    return Z.zip_build(rows, ["source"])


def small_archives(spark, sf_dir) -> DataFrame:
    """One archive for each conversation, with a folder in front."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("ordinal"), F.concat(F.lit("turns/"), "turn", F.lit("-"), "role", F.lit(".txt")).alias("filename"), utf8("text").alias("data"))
    folders = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("ordinal"), F.lit("turns/").alias("filename"), F.unhex(F.lit("")).alias("data"))
    return Z.zip_build(turns.unionByName(folders), ["conv_id"])


@query("SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS ordinal, lang || '/' || doc_id || '.txt' AS filename, octet_length(encode(text))::BIGINT AS file_size, false AS is_dir FROM documents")
def zip_catalog(spark, sf_dir):
    return Z.zip_entries(archives(spark, sf_dir), ["source"]).select("source", "ordinal", "filename", "file_size", "is_dir")


@query(f"""WITH m AS (SELECT conv_id, turn + 1 AS o, 'turns/' || turn || '-' || role || '.txt' AS filename, {sql_crc('text')}::BIGINT AS crc, false AS is_dir FROM conversations
UNION ALL SELECT DISTINCT conv_id, -1, 'turns/', 0, true FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1)::INT AS ordinal, filename, crc, is_dir, 1980 AS year FROM m""")
def zip_conversations(spark, sf_dir):
    found = Z.zip_entries(small_archives(spark, sf_dir), ["conv_id"])
    return found.select("conv_id", "ordinal", "filename", "crc", "is_dir", Z.date_time(F.col("mtime"))["year"].alias("year"))


@query(DOCUMENTS)
def zip_roundtrip(spark, sf_dir):
    found = Z.zip_members(archives(spark, sf_dir), ["source"])
    return found.select(F.regexp_extract("filename", r"/(\d+)\.", 1).cast("long").alias("doc_id"), text(F.col("data")).alias("text"))


@query("""SELECT conv_id, turn, kind, CASE WHEN kind IN ('stored', 'folder', 'empty', 'tiny') THEN 0 ELSE 8 END AS compress_type
FROM (SELECT DISTINCT conv_id, turn FROM conversations) CROSS JOIN (VALUES ('stored'), ('folder'), ('empty'), ('tiny'), ('deflated')) AS v(kind)""")
def zip_store_rule(spark, sf_dir):
    keys = read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    kinds = F.explode(F.array(*map(F.lit, ("stored", "folder", "empty", "tiny", "deflated")))).alias("kind")
    rows = keys.select("conv_id", "turn", kinds)
    filler = F.repeat(F.lit("again "), 50)
    data = F.when(F.col("kind").isin("stored", "deflated"), filler).when(F.col("kind") == "tiny", F.lit("x")).otherwise("")
    name = F.when(F.col("kind") == "folder", "folder/").otherwise(F.col("kind"))
    rows = rows.withColumns({"ordinal": F.xxhash64("kind"), "filename": name, "data": F.encode(data, "UTF-8"), "compress_type": F.when(F.col("kind") == "stored", archive.STORE).otherwise(archive.DEFLATE)})
    found = Z.zip_entries(Z.zip_build(rows.drop("kind"), ["conv_id", "turn"]), ["conv_id", "turn"])
    return found.select("conv_id", "turn", F.rtrim("filename", F.lit("/")).alias("kind"), "compress_type")


@query("SELECT conv_id, 'same.txt' AS filename, arg_max(octet_length(encode(text)), turn)::BIGINT AS file_size FROM conversations GROUP BY conv_id")
def zip_lookup(spark, sf_dir):
    """Of equal names a lookup sees the last."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.lit("/same.txt").alias("filename"), utf8("text").alias("data"))
    found = Z.lookup(Z.zip_entries(Z.zip_build(rows, ["conv_id"]), ["conv_id"]), "\\same.txt", ["conv_id"])
    return found.select("conv_id", "filename", "file_size")


@query("SELECT conv_id, max(turn) >= 2 AS found FROM conversations GROUP BY conv_id")
def zip_contains(spark, sf_dir):
    """Whether each conversation's archive has a third turn."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.col("turn").cast("string").alias("filename"), utf8("text").alias("data"))
    return Z.contains(Z.zip_entries(Z.zip_build(rows, ["conv_id"]), ["conv_id"]), "/2", ["conv_id"])


@query("SELECT conv_id, arg_min(text, turn) AS by_index, arg_max(text, turn) AS by_name FROM conversations GROUP BY conv_id")
def zip_read(spark, sf_dir):
    """The first member by its place, and the last of those that share a name."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.lit("turn").alias("filename"), utf8("text").alias("data"), (F.col("turn") % 10).alias("compress_level"))
    members = Z.zip_members(Z.zip_build(rows, ["conv_id"]), ["conv_id"])
    first = Z.read_by_index(members, 0, ["conv_id"]).select("conv_id", text(F.col("data")).alias("by_index"))
    return first.join(Z.read_by_name(members, "turn", ["conv_id"]).select("conv_id", text(F.col("data")).alias("by_name")), "conv_id")


@query(f"SELECT conv_id, turn || '.txt' AS name, octet_length(encode(text))::BIGINT AS size, {sql_crc('text')}::BIGINT AS crc32, false AS \"isDir\", 1980 AS year FROM conversations")
def zip_info(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.concat("turn", F.lit(".txt")).alias("filename"), utf8("text").alias("data"))
    entries = Z.zip_entries(Z.zip_build(rows, ["conv_id"]), ["conv_id"])
    dates = Z.info(entries, ["conv_id"]).select("conv_id", F.col("filename").alias("name"), F.col("date_time.year").alias("year"))
    return Z.short_info(entries, ["conv_id"]).select("conv_id", "name", "size", "crc32", "isDir").join(dates, ["conv_id", "name"])


@query("SELECT n_nationkey, left(repeat(n_name || ' ', 50), 333) AS text FROM nation")
def corpus_roundtrip(spark, sf_dir):
    """Names repeated to a size, as a corpus for measurements is, compressed and decoded."""
    content = corpus.repeated(F.concat("n_name", F.lit(" ")), 333)
    return read(spark, sf_dir, "nation").select("n_nationkey", text(C.inflate_auto(C.gzip_compress(content))).alias("text"))


@query("SELECT conv_id, array_to_string(list('turns/' || turn || '-' || role || '.txt' ORDER BY turn), ',') AS names FROM conversations GROUP BY conv_id")
def zip_names(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.concat(F.lit("turns\\"), "turn", F.lit("-"), "role", F.lit(".txt")).alias("filename"), utf8("text").alias("data"))
    return Z.names(Z.zip_entries(Z.zip_build(rows, ["conv_id"]), ["conv_id"]), ["conv_id"]).select("conv_id", F.array_join("names", ",").alias("names"))


@query("SELECT conv_id, min(turn) FILTER (WHERE turn % 3 = 2 AND octet_length(encode(text)) > 0)::VARCHAR AS first_bad FROM conversations GROUP BY conv_id")
def zip_testzip(spark, sf_dir):
    """Every third turn's data are stored and then damaged; the first damaged member of each archive is found."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.col("turn").cast("string").alias("filename"), utf8("text").alias("data"), F.lit(archive.STORE).alias("compress_type"))

    def damage(content: bytes, offset: int, name: str) -> bytes:
        at = offset + 30 + len(name.encode())
        return content[:at] + bytes([content[at] ^ 255]) + content[at + 1 :]

    def damage_all(content: bytes) -> bytes:
        for e in archive.catalog(content)[0]:
            if int(e.filename) % 3 == 2 and e.file_size:
                content = damage(content, e.header_offset, e.filename)
        return content

    broken = Z.zip_build(rows, ["conv_id"]).select("conv_id", C.arrow_function("binary", damage_all, "content").alias("content"))
    return Z.test_archives(Z.zip_members(broken, ["conv_id"]), ["conv_id"])


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY k, turn) - 1)::INT AS ordinal, name AS filename, octet_length(encode(s))::BIGINT AS file_size,
  CASE WHEN k = 0 THEN 33261 ELSE 33188 END::BIGINT AS mode, CASE WHEN k = 0 THEN role ELSE '' END AS comment, 'first ' || conv_id AS archive_comment, md5(s) AS digest
FROM (SELECT conv_id, turn, 0 AS k, turn::VARCHAR AS name, text AS s, role FROM conversations UNION ALL SELECT conv_id, turn, 1, 'roles/' || turn, role, role FROM conversations)""")
def zip_append(spark, sf_dir):
    """Old members keep their attributes and comments, and the archive its own."""
    d = read(spark, sf_dir, "conversations")
    first = d.select("conv_id", F.col("turn").alias("ordinal"), F.col("turn").cast("string").alias("filename"), utf8("text").alias("data"), F.lit(0o100755 << 16).cast("long").alias("external_attr"), utf8("role").alias("comment"))
    more = d.select("conv_id", F.col("turn").alias("ordinal"), F.concat(F.lit("roles/"), "turn").alias("filename"), utf8("role").alias("data"))
    done = Z.zip_append(Z.zip_build(first, ["conv_id"], comment=utf8(F.concat(F.lit("first "), "conv_id"))), more, ["conv_id"])
    found = Z.zip_members(done, ["conv_id"]).join(Z.archive_comments(done, ["conv_id"]).withColumnRenamed("comment", "__c"), "conv_id")
    return found.select("conv_id", "ordinal", "filename", "file_size", F.shiftright("external_attr", 16).alias("mode"), text(F.col("comment")).alias("comment"), text(F.col("__c")).alias("archive_comment"), F.md5("data").alias("digest"))


MEMBER_NAMES = ("a//./b.txt", "/abs/c.txt", "win\\\\d.txt", "../up.txt", "in/../up.txt", "dots...txt", "folder/")


@query(f"""WITH m AS (SELECT n_nationkey, ltrim(replace(n_name || '/' || v.s, '\\', '/'), '/') AS name FROM nation CROSS JOIN (VALUES {', '.join(f"('{s.replace(chr(92) * 2, chr(92))}')" for s in MEMBER_NAMES)}) AS v(s))
SELECT n_nationkey, name, list_contains(string_split(name, '/'), '..') AS unsafe, CASE WHEN NOT list_contains(string_split(name, '/'), '..') THEN array_to_string(list_filter(string_split(name, '/'), lambda x: x NOT IN ('', '.')), '/') END AS safe FROM m""")
def zip_safe_path(spark, sf_dir):
    names = F.explode(F.array(*(F.lit(s.replace("\\\\", "\\")) for s in MEMBER_NAMES))).alias("s")
    d = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", names).select("n_nationkey", F.concat("n_name", F.lit("/"), "s").alias("raw"))
    unsafe = paths.is_unsafe(F.col("raw"))
    return d.select("n_nationkey", paths.normalize_member(F.col("raw")).alias("name"), unsafe.alias("unsafe"), F.when(~unsafe, paths.safe_path(F.when(~unsafe, F.col("raw")))).alias("safe"))


FILE_SUFFIXES = (*paths.ALL_SUFFIXES, "", ".txt", ".gz.bak", ".tar")


@query(f"""WITH f AS (SELECT p_partkey, '/data/' || p_name || v.s AS path, v.s FROM part CROSS JOIN (VALUES {', '.join(f"('{s}')" for s in FILE_SUFFIXES)}) AS v(s))
SELECT p_partkey, path, string_split(path, '/')[-1] AS base, CASE WHEN s = '.tgz' THEN left(path, length(path) - 4) || '.tar' WHEN s IN ({', '.join(f"'{s}'" for s in paths.ALL_SUFFIXES)}) THEN left(path, length(path) - length(s)) ELSE path END AS output FROM f""")
def suffix_rules(spark, sf_dir):
    suffix = F.explode(F.array(*map(F.lit, FILE_SUFFIXES))).alias("s")
    d = read(spark, sf_dir, "part").select("p_partkey", "p_name", suffix).select("p_partkey", F.concat(F.lit("/data/"), "p_name", "s").alias("path"))
    return d.select("p_partkey", "path", paths.basename(F.col("path")).alias("base"), paths.strip_suffix(F.col("path")).alias("output"))


KINDS = ("file", "link", "directory", "special", "missing")


@query(f"""SELECT p_partkey, kind, mode, CASE WHEN kind = 'missing' THEN 'does not exist' WHEN kind = 'special' THEN 'is a special file' WHEN kind = 'link' THEN 'is a symbolic link' WHEN kind = 'directory' THEN 'is a directory'
WHEN mode = 'compress' AND p_partkey % 2 = 0 THEN 'already has a compressed suffix' WHEN mode = 'decompress' AND p_partkey % 2 = 1 THEN 'has no compressed suffix' END AS reason
FROM part CROSS JOIN (VALUES {', '.join(f"('{k}')" for k in KINDS)}) AS v(kind) CROSS JOIN (VALUES ('compress'), ('decompress')) AS w(mode)""")
def skip_rules(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".gz").otherwise(".txt"))
    d = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    both = [d.select("p_partkey", "kind", F.lit(m).alias("mode"), paths.skip_reason(F.col("kind"), F.col("name"), m).alias("reason")) for m in ("compress", "decompress")]
    return both[0].unionAll(both[1])


# images

QUANT = "[least(greatest(floor((x::DOUBLE + 1) * 127.5), 0), 255)::BIGINT FOR x IN embedding[1:64]]"
PIXELS = f"(SELECT vec_id, unnest({QUANT}) AS v, unnest(range(64)) AS i FROM embeddings)"


def vectors(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 64).alias("embedding"))
    return I.vector_images(d, "embedding", 8, 8).drop("embedding")


@query(f"SELECT vec_id, 8 AS width, 8 AS height, 1 AS channels, string_agg(printf('%02X', v), '' ORDER BY i) AS pixels FROM {PIXELS} GROUP BY vec_id")
def png_roundtrip(spark, sf_dir):
    done = I.decode_images(I.encode_images(vectors(spark, sf_dir).select("vec_id", "width", "height", "channels", "pixels"), preset_name="small").select("vec_id", "content"))
    return done.select("vec_id", "width", "height", "channels", F.hex("pixels").alias("pixels"))


@query(f"""SELECT vec_id, (i // 8)::INT AS row_idx, kind, string_agg(printf('%02X', f), '' ORDER BY i) AS bytes FROM (
SELECT vec_id, i, unnest(['sub', 'up']) AS kind, unnest([(v - coalesce(lag(v) OVER (PARTITION BY vec_id, i // 8 ORDER BY i), 0) + 256) % 256, (v - coalesce(lag(v) OVER (PARTITION BY vec_id, i % 8 ORDER BY i), 0) + 256) % 256]) AS f FROM {PIXELS}) GROUP BY ALL""")
def png_filter_rows(spark, sf_dir):
    both = [I.scanlines(vectors(spark, sf_dir), ["vec_id"], k).select("vec_id", "row_idx", F.lit(k).alias("kind"), F.hex("bytes").alias("bytes")) for k in ("sub", "up")]
    return both[0].unionAll(both[1])


@query(f"""WITH f AS (SELECT vec_id, i // 8 AS r, v, (v - coalesce(lag(v) OVER (PARTITION BY vec_id, i // 8 ORDER BY i), 0) + 256) % 256 AS s, (v - coalesce(lag(v) OVER (PARTITION BY vec_id, i % 8 ORDER BY i), 0) + 256) % 256 AS u FROM {PIXELS}),
c AS (SELECT vec_id, r, sum(least(v, 256 - v)) AS s0, sum(least(s, 256 - s)) AS s1, sum(least(u, 256 - u)) AS s2 FROM f GROUP BY 1, 2)
SELECT vec_id, r::INT AS row_idx, CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END AS filter, least(s0, s1, s2)::BIGINT AS score FROM c""")
def png_adaptive_choice(spark, sf_dir):
    return I.scanlines(vectors(spark, sf_dir), ["vec_id"], "adaptive-fast").select("vec_id", "row_idx", "filter", "score")


@query("SELECT vec_id, ordinal, type, length FROM embeddings CROSS JOIN (VALUES (0, 'IHDR', 13), (1, 'IDAT', NULL), (2, 'IEND', 0)) AS v(ordinal, type, length)")
def png_chunks(spark, sf_dir):
    found = I.image_chunks(I.encode_images(vectors(spark, sf_dir)), ["vec_id"])
    return found.select("vec_id", "ordinal", "type", F.when(F.col("type") != "IDAT", F.col("length")).alias("length"))


@query("SELECT preset, level, strategy, filter FROM (VALUES " + ", ".join(f"('{p}', {v[0]}, '{v[1]}', '{v[2]}')" for p, v in PRESETS.items()) + ") AS v(preset, level, strategy, filter)")
def png_presets(spark, sf_dir):
    return spark.createDataFrame([(p, *preset(p)) for p in PRESETS], "preset string, level int, strategy string, filter string")


@query("SELECT vec_id, channels, true AS ok FROM embeddings CROSS JOIN (VALUES (1), (2), (4)) AS v(channels)")
def png_channels(spark, sf_dir):
    """The same bytes as images of one, two and four channels, under every filter."""
    d, out = vectors(spark, sf_dir).select("vec_id", "pixels"), None
    for n in (1, 2, 4):
        ok = F.lit(True)
        for kind in ("none", "sub", "up", "average", "paeth", "adaptive-all"):
            packed = C.png_encode("pixels", F.lit(8 // n), F.lit(8), F.lit(n), filter=kind)
            ok = ok & (C.png_decode(packed)["pixels"] == F.col("pixels"))
        one = d.select("vec_id", F.lit(n).alias("channels"), ok.alias("ok"))
        out = one if out is None else out.unionAll(one)
    return out


# tables of runs, and compositions

TIMES = "(SELECT event_type, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query(f"""WITH s AS (SELECT event_type AS method, count(*)::BIGINT AS runs, max(value) FILTER (WHERE k = n // 2) AS median_s, min(value) AS best_s FROM {TIMES} GROUP BY 1),
m AS (SELECT *, 1e6 / median_s / 1e6 AS mb_s FROM s), b AS (SELECT mb_s AS base FROM m ORDER BY method LIMIT 1)
SELECT method, runs, round(median_s, 6) AS median_s, round(best_s, 6) AS best_s, round(mb_s, 6) AS mb_s, round(mb_s / base, 6) AS speedup, rank() OVER (ORDER BY mb_s DESC)::INT AS rank FROM m, b""")
def bench_summary(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select(F.lit("all").alias("corpus"), F.col("event_type").alias("method"), F.col("value").alias("seconds"), F.lit(1_000_000).cast("long").alias("raw_bytes"), F.lit(500_000).cast("long").alias("comp_bytes"))
    first = runs.agg(F.min("method")).first()[0]
    return summarize_runs(runs, ["corpus"], first).select("method", "runs", *(F.round(c, 6).alias(c) for c in ("median_s", "best_s", "mb_s", "speedup")), "rank")


@query("""SELECT doc_id, k::INT AS ordinal, (CASE WHEN k = 3 THEN n - 3 * (n // 4) ELSE n // 4 END)::BIGINT AS size FROM (SELECT doc_id, octet_length(encode(text)) AS n, unnest(range(4)) AS k FROM documents)""")
def split_into_members(spark, sf_dir):
    return split_members(blobs(spark, sf_dir), 4).select("doc_id", "ordinal", F.octet_length("data").cast("long").alias("size"))


@query("SELECT lang, source, count(*)::BIGINT AS blobs, sum(octet_length(encode(text)))::BIGINT AS raw_len, max(octet_length(encode(text)))::BIGINT AS largest FROM documents GROUP BY 1, 2")
def blob_profile(spark, sf_dir):
    """From compressed blobs: their number, and the sizes that their trailers give."""
    d = read(spark, sf_dir, "documents").select("lang", "source", C.gzip_isize(C.gzip_compress(utf8("text"), level=1)).alias("size"))
    return d.groupBy("lang", "source").agg(F.count("*").alias("blobs"), F.sum("size").alias("raw_len"), F.max("size").alias("largest"))


@query("SELECT source, quality, count(*)::BIGINT AS members, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def rel_catalog_labels(spark, sf_dir):
    found = Z.zip_entries(archives(spark, sf_dir), ["source"]).withColumn("doc_id", F.regexp_extract("filename", r"/(\d+)\.", 1).cast("long"))
    return found.join(read(spark, sf_dir, "labels"), "doc_id").groupBy("source", "quality").agg(F.count("*").alias("members"), F.sum("file_size").alias("bytes"))


@query("SELECT doc_id, 'en' AS lang FROM documents WHERE lang <> 'en'")
def rel_missing_members(spark, sf_dir):
    """Documents that no archive holds under the folder ``en``."""
    found = Z.zip_entries(archives(spark, sf_dir), ["source"]).select("filename")
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit("en").alias("lang"), F.concat(F.lit("en/"), "doc_id", F.lit(".txt")).alias("filename"))
    return d.join(found, "filename", "left_anti").select("doc_id", "lang")


@query("SELECT source, lang, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*)::BIGINT AS members FROM documents GROUP BY ROLLUP (source, lang)")
def rel_size_rollup(spark, sf_dir):
    found = Z.zip_entries(archives(spark, sf_dir), ["source"]).withColumn("lang", F.split("filename", "/")[0])
    return found.rollup("source", "lang").agg(F.sum("file_size").alias("bytes"), F.count("*").alias("members"))


@query("SELECT filename, file_size FROM (SELECT lang || '/' || doc_id || '.txt' AS filename, octet_length(encode(text))::BIGINT AS file_size FROM documents) ORDER BY file_size DESC, filename LIMIT 10")
def rel_largest_members(spark, sf_dir):
    return Z.zip_entries(archives(spark, sf_dir), ["source"]).select("filename", "file_size").orderBy(F.desc("file_size"), "filename").limit(10)


@query("SELECT source, doc_id, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM documents")
def rel_member_offsets(spark, sf_dir):
    """Where each member's decoded bytes begin when those of an archive are read one after the other, from its catalog."""
    w = Window.partitionBy("source").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    found = Z.zip_entries(archives(spark, sf_dir), ["source"])
    return found.select("source", F.regexp_extract("filename", r"/(\d+)\.", 1).cast("long").alias("doc_id"), F.coalesce(F.sum("file_size").over(w), F.lit(0).cast("long")).alias("off"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*)::BIGINT AS n, sum(octet_length(encode(coalesce(props, ''))))::BIGINT AS bytes FROM events GROUP BY 1, 2")
def rel_event_batches(spark, sf_dir):
    """Tumbling batches of events, compressed and decoded again."""
    d = read(spark, sf_dir, "events").withColumn("p", C.inflate_auto(C.gzip_compress(F.encode(F.coalesce("props", F.lit("")), "UTF-8"))))
    return d.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum(F.octet_length("p").cast("long")).alias("bytes")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "n", "bytes")


def nation_stream(spark, sf_dir) -> DataFrame:
    """The small table as a stream; a stream's path is a folder, and the option picks the file in it."""
    schema = spark.read.parquet(f"{sf_dir}/nation.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "nation.parquet").parquet(sf_dir)


@query("SELECT n_nationkey, n_name, true AS ok FROM nation")
def stream_roundtrip(spark, sf_dir):
    """The small table ``nation`` as a stream, compressed and decoded on the way to a table in memory."""
    import uuid

    from ..streaming.blobs import compress_stream, decompress_stream

    rows = nation_stream(spark, sf_dir)
    packed = compress_stream(rows.select("n_nationkey", utf8("n_name").alias("content")))
    name = f"stream_{uuid.uuid4().hex}"
    running = decompress_stream(packed).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).select("n_nationkey", text(F.col("data")).alias("n_name"), F.col("error").isNull().alias("ok"))


@query("SELECT n_nationkey, n_name FROM nation")
def chunk_stream_roundtrip(spark, sf_dir):
    """Streams that arrive in chunks, put together with state: each nation's name in three pieces."""
    import uuid

    from ..streaming.blobs import inflate_chunks

    rows = nation_stream(spark, sf_dir)
    packed = rows.select(F.col("n_nationkey").alias("stream_id"), C.gzip_compress(utf8("n_name")).alias("z"))
    at = lambda k: F.floor(F.octet_length("z") * k / 3).cast("int")
    pieces = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(k == 2).alias("is_last"), F.col("z").substr(at(k) + 1, at(k + 1) - at(k)).alias("chunk")) for k in (2, 0, 1)))
    chunks = packed.select("stream_id", F.inline(pieces))
    name = f"chunks_{uuid.uuid4().hex}"
    running = inflate_chunks(chunks).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).select(F.col("stream_id").alias("n_nationkey"), text(F.col("data")).alias("n_name"))
