"""Substring deduplication on a compacted De Bruijn graph of words.

Nodes are runs of ``window`` - 1 words; every run of ``window`` words of a document is an edge between two of them.
Edges carry the minimizer, the smallest hash among the ``anchor``-word runs inside, so equal edges have equal ones.
Consecutive edges of a document under one minimizer are taken together from the start as a path (first word, edges,
hash of all its words, and the path that comes next). Then, in joins and groups:

* Paths are grouped by (minimizer, hash); one that repeats keeps its first coordinate, its count and, if it is the same
  wherever the path stands, its next path.
* Where a path's only next path stands as often as it does, no node between the two branches. These pairs are found by
  a join; runs of them, lined up by their first coordinates, are compacted to one long path, and copies of its first
  part stand for copies of the whole.
* Only under minimizers where different paths meet, so where the graph may branch, is the first copy of each path opened
  into single edges; again the first coordinate wins.
* A copy's source is the copy of the same before it in its document, or else the first coordinate. Copies that overlap
  or touch, and whose sources do so in step, are made one span: lines that a document repeats are one, not one each time.
* Hashes only propose. The words at the sources are read again, as are those of each span, in one pass over the texts,
  and a join compares them. Sources are read in cells, each once however many copies it has. If any span differs
  in words, all copies are compared one by one, and those that differ are grouped anew by their words.

What starts elsewhere, earlier, removes the words it covers. Coordinates order by (id, digest of the text, first word); a
null id comes first. So rows that share an id but not the text are documents of their own, in order of the digest;
rows equal in both are one document that stands there several times: each keeps or loses the same. Documents
with fewer words than the window, null and empty texts keep all they have. A column of the input named like a result
column gives way to it.

All joins deal rows by hashes or coordinates, and none is followed by work that needs its rows in place, so that
adaptive execution can split a hot key. Aggregates combine before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import add_columns, bytes_of, column
from ._shared import forget, table, tuned, written
from ._text import SLICE_BYTES, Ranges, Words, flat, grams, i64, mix, slices, union_of_spans

WINDOW, ANCHOR = 20, 8
#: Words of a source that are read and compared together.
CELL = 256
#: A row of the documents: its id and the digest of its text.
ROW = ["id", "digest"]


def pieces_of(words: Words, h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Paths of a flat sequence: row, first word, edges, minimizer, hash."""
    n = len(h) - window + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    v = grams(h, anchor)
    # the first smallest of growing runs, each from two that overlap or touch
    best, where, wide = v, np.zeros(len(v), np.int8), 1
    while wide < window - anchor + 1:
        step = min(wide, window - anchor + 1 - wide)
        less = best[step:] < best[:-step]
        best, where = np.where(less, best[step:], best[:-step]), np.where(less, where[step:] + np.int8(step), where[:-step])
        wide += step
    row = words.row()
    at = np.flatnonzero(row[:n] == row[window - 1 :][:n])
    if not len(at):
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    place, row = at + where[at], row[at]
    opens = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    start = at[opens]
    edges = np.diff(np.concatenate([opens, [len(at)]]))
    return row[opens], start, edges, best[start], Ranges(h).hash(start, start + edges - 1 + window)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, text) of each row."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))


def paths(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(minimizer, h, next, id, digest, at, edges): next is a hash of the following path of the row, null at its end."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*flat(column(part, "text")))
                row, start, edges, key, h = pieces_of(words, words.hashes(), window, anchor)
                own = i64(mix(key ^ mix(h)))
                follows = np.concatenate([row[1:] == row[:-1], [False]]) if len(row) else np.zeros(0, bool)
                following = pa.array(np.asarray(own)[np.minimum(np.arange(len(row)) + 1, max(len(row) - 1, 0))], mask=~follows)
                yield pa.RecordBatch.from_arrays([i64(key), i64(h), own, following, *(column(part, c).take(pa.array(row)) for c in ROW), pa.array(start - words.first[row], pa.int32()), pa.array(edges, pa.int32())], names=["minimizer", "h", "path", "next", *ROW, "at", "edges"])

    return rows.mapInArrow(run, f"minimizer long, h long, path long, next long, id {kind}, digest long, at int, edges int")


def minimizers(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(minimizer, n, low, high): its paths and their smallest and largest hash."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*flat(column(part, "text")))
                *_, key, h = pieces_of(words, words.hashes(), window, anchor)
                if not len(key):
                    continue
                order = np.argsort(key)
                key, h = key[order], h[order].view(np.int64)
                opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                n = np.diff(np.concatenate([opens, [len(key)]]))
                yield pa.RecordBatch.from_arrays([i64(key[opens]), pa.array(n), pa.array(np.minimum.reduceat(h, opens)), pa.array(np.maximum.reduceat(h, opens))], names=["minimizer", "n", "low", "high"])

    found = rows.select("text").mapInArrow(run, "minimizer long, n long, low long, high long")
    return found.groupBy("minimizer").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def joined_to_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of documents, distinct, with what is wanted of them (id, digest, ...), null ids included."""
    other = wanted.withColumnsRenamed({c: f"__{c}" for c in ROW})
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    return rows.join(other, same).drop("__id", "__digest")


def per_row(frame: DataFrame, *fields: str) -> DataFrame:
    """(id, digest, wanted): what lies in each row of the documents, every place once; at most one for each word."""
    return frame.groupBy(*ROW).agg(F.collect_set(F.struct(*fields)).alias("wanted"))


def single_edges(rows: DataFrame, opened: DataFrame, window: int) -> DataFrame:
    """(h, g, id, digest, at): the edges of paths (id, digest, at, edges), hashed twice from their words."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*flat(column(part, "text")))
                own = column(part, "wanted")
                row = np.repeat(np.arange(len(own)), np.diff(np.asarray(own.offsets)))
                at, edges = (np.asarray(own.flatten().field(c)).astype(np.int64) for c in ("at", "edges"))
                which = np.repeat(np.arange(len(at)), edges)
                start = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(edges) - edges, edges)
                row = row[which]
                place = words.first[row] + start
                two = [Ranges(words.hashes(seed)).hash(place, place + window) for seed in (0, 1)]
                yield pa.RecordBatch.from_arrays([*map(i64, two), *(column(part, c).take(pa.array(row)) for c in ROW), pa.array(start, pa.int32())], names=["h", "g", *ROW, "at"])

    return joined_to_rows(rows, per_row(opened, "at", "edges")).mapInArrow(run, f"h long, g long, id {kind}, digest long, at int")


def words_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (id, digest, at, n, key, of) with ``words``, the n words from there, joined by one space; where ``of``
    is null, ``starts`` has the byte at which each begins, and that after a space behind the last."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts, own = bytes_of(part, "text"), column(part, "wanted")
                row = np.repeat(np.arange(len(own)), np.diff(np.asarray(own.offsets)))
                wanted = own.flatten()
                at, n, of = (wanted.field(c).to_pylist() for c in ("at", "n", "of"))
                held, starts, size, low, last = [], [], 0, 0, None
                for k, r in enumerate(row.tolist()):
                    if r != last:
                        words, last = texts[r].split(), r
                    held.append(b" ".join(words[at[k] : at[k] + n[k]]))
                    if of[k] is None:
                        starts.append(np.concatenate([[0], np.flatnonzero(np.frombuffer(held[-1], np.uint8) == 0x20) + 1, [len(held[-1]) + 1]]).astype(np.int32))
                    else:
                        starts.append(np.zeros(0, np.int32))
                    size += len(held[-1])
                    if size >= SLICE_BYTES or k + 1 == len(row):
                        some, own_row = wanted.slice(low, k + 1 - low), pa.array(row[low : k + 1])
                        begin = pa.ListArray.from_arrays(np.cumsum([0, *map(len, starts)]).astype(np.int32), np.concatenate(starts))
                        yield pa.RecordBatch.from_arrays([*(column(part, c).take(own_row) for c in ROW), *(some.field(c) for c in ("at", "n", "key", "of")), pa.array(held, pa.binary()), begin], names=[*ROW, "at", "n", "key", "of", "words", "starts"])
                        held, starts, size, low = [], [], 0, k + 1

    return joined_to_rows(rows, per_row(places, "at", "n", "key", "of")).mapInArrow(run, f"id {kind}, digest long, at int, n int, key string, of int, words binary, starts array<int>")


def place(*prefix: str) -> Column:
    return F.struct(*(F.col(f"{'.'.join(prefix)}.{c}" if prefix else c) for c in (*ROW, "at")))


def compacted(repeated: DataFrame) -> DataFrame:
    """Long paths (minimizer, h, path, first, edges) of repeated ones (and n, next): of a run without branches only the
    first part is left, with the edges of all."""
    before = repeated.where("next IS NOT NULL").select(F.col("next").alias("path"), F.col("n").alias("n_before"))
    # a path whose only next one is this, and stands as often
    inner = written(repeated.join(before, "path").where("n = n_before").select("path").distinct(), "inner-paths", compact=True)
    marked = repeated.join(inner.withColumn("inner", F.lit(True)), "path", "left")
    line = Window.partitionBy("first.id", "first.digest").orderBy("first.at")
    lined = marked.withColumn("run", F.sum(F.col("inner").isNull().cast("int")).over(line))
    long = lined.groupBy("first.id", "first.digest", "run").agg(F.min_by(F.struct("minimizer", "h", "path", "first"), F.col("first.at")).alias("head"), F.sum("edges").alias("edges"))
    out = written(long.select("head.*", F.col("edges").cast("int").alias("edges")), "long-paths", compact=True)
    forget(inner)
    return out


def merged(copies: DataFrame) -> DataFrame:
    """(id, digest, at, n, from_id, from_digest, from_at): spans of copies (id, digest, at, n, first) and where they come from,
    the copy before in the row or the first place. Those that overlap or touch in step with their sources are one."""
    kind = copies.schema["id"].dataType.simpleString()
    other = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest")))
    fields = ("at", "n", "from_id", "from_digest", "from_at")
    # without from_digest: the row itself
    lines = copies.select(*ROW, "at", "n", F.when(other, F.col("first.id")).alias("from_id"), F.when(other, F.col("first.digest")).alias("from_digest"), F.col("first.at").alias("from_at"))

    def run(batches):
        for batch in batches:
            wanted = column(batch, "wanted")
            row = np.repeat(np.arange(len(wanted)), np.diff(np.asarray(wanted.offsets)))
            wanted = wanted.flatten()
            at, n, source = (np.asarray(wanted.field(c)).astype(np.int64) for c in ("at", "n", "from_at"))
            own = np.asarray(wanted.field("from_digest").is_null())
            digest = np.asarray(wanted.field("from_digest").fill_null(0)).astype(np.int64)
            order = np.lexsort((at, n, source, digest, own, row))
            now, before = order[1:], order[:-1]
            again = np.all([x[now] == x[before] for x in (row, own, digest, source, n)], axis=0)
            source[now[again]] = at[before[again]]
            own[now[again]], digest[now[again]] = True, 0
            shift = source - at
            order = np.lexsort((at, shift, digest, own, row))
            row, at, n, own, digest, shift = (x[order] for x in (row, at, n, own, digest, shift))
            opens = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (row, own, digest, shift)], axis=0)])[: len(row)]
            line, start, end = union_of_spans(np.cumsum(opens) - 1, at, at + n)
            which = np.flatnonzero(opens)[line]
            at_row, at_copy = pa.array(row[which]), pa.array(order[which], mask=own[which])
            yield pa.RecordBatch.from_arrays([*(column(batch, c).take(at_row) for c in ROW), pa.array(start, pa.int32()), pa.array(end - start, pa.int32()), *(wanted.field(c).take(at_copy) for c in ("from_id", "from_digest")), pa.array(start + shift[which], pa.int32())], names=[*ROW, *fields])

    spans = per_row(lines, *fields).mapInArrow(run, f"id {kind}, digest long, at int, n int, from_id {kind}, from_digest long, from_at int")
    from_id = F.when(F.col("from_digest").isNull(), F.col("id")).otherwise(F.col("from_id"))
    return spans.select(*ROW, "at", "n", from_id.alias("from_id"), F.coalesce("from_digest", "digest").alias("from_digest"), "from_at")


def named(*columns: str) -> Column:
    """128 bits of a hash."""
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *columns)))


def differing(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, digest, at), written: where ``spans`` (of ``merged``) have other words than their source."""
    cells = F.sequence(F.expr(f"from_at DIV {CELL}"), F.expr(f"(from_at + n - 1) DIV {CELL}"))
    cut = spans.withColumn("cell", F.explode(cells)).withColumn("low", F.greatest(F.col("from_at"), (F.col("cell") * CELL).cast("int")))
    high = F.least(F.col("from_at") + F.col("n"), ((F.col("cell") + 1) * CELL).cast("int"))
    cut = cut.select(*ROW, (F.col("at") - F.col("from_at") + F.col("low")).alias("at"), (high - F.col("low")).alias("n"), named("from_id", "from_digest", "cell").alias("key"), F.col("low").alias("of"), "from_id", "from_digest")
    # a cell is read as far as any copy of it goes
    sources = cut.groupBy("from_id", "from_digest", "key").agg(F.min("of").alias("at"), F.max(F.col("of") + F.col("n")).alias("end"))
    sources = sources.select(F.col("from_id").alias("id"), F.col("from_digest").alias("digest"), "at", (F.col("end") - F.col("at")).alias("n"), "key", F.lit(None).cast("int").alias("of"))
    read = written(words_at(rows, cut.drop("from_id", "from_digest").unionByName(sources)), "words")
    # rows equal in id and text all have the source; not grouped by the join's key alone, so that it can split a hot one
    there = read.where("of IS NULL").groupBy(*ROW, "at", "key").agg(F.first(F.struct("words", "starts")).alias("source"))
    there = there.select("key", F.struct("at", "source.words", "source.starts").alias("source"))
    skip = F.col("of") - F.col("source.at")
    begin, end = (F.get("source.starts", i) for i in (skip, skip + F.col("n")))
    same = F.col("words") == F.substring("source.words", begin + 1, end - begin - 1)
    held = read.where("of IS NOT NULL").join(there, "key", "left").where(~F.coalesce(same, F.lit(False)))
    out = written(held.select(*ROW, "at"), "differing", compact=True)
    forget(read)
    return out


def settled(rows: DataFrame, spans: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, digest, at, n) of ``spans`` (of ``merged``) if all have the words of their sources, else of the ``copies`` verified one by one."""
    differ = differing(rows, spans)
    same = differ.isEmpty()
    forget(differ)
    return spans if same else verified(rows, copies)


def verified(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, digest, at, n), written: the copies (key, id, digest, at, n, first) whose words are those at their first place."""
    alone = F.lit(None).cast("int").alias("of")
    sources = copies.select("key", "first.*", "n", alone).distinct()
    # rows equal in id and text all have the first place
    there = written(words_at(rows, sources).groupBy("key").agg(F.first("words").alias("source")), "sources")
    here = words_at(rows, copies.select("key", *ROW, "at", "n", alone))
    held = here.join(there, "key").select(*ROW, "at", "n", "key", (F.col("words") == F.col("source")).alias("same"), F.when(F.col("words") != F.col("source"), F.col("words")).alias("other"))
    held = written(held, "compared")
    good = held.where("same").select(*ROW, "at", "n")
    # equal hashes of different words: their own first place counts
    differ = held.where("NOT same")
    own_first = differ.groupBy("key", "other").agg(F.min(place()).alias("first"))
    anew = differ.join(own_first, ["key", "other"]).where(~place().eqNullSafe(F.col("first"))).select(*ROW, "at", "n")
    out = written(good.unionByName(anew), "verified", compact=True)
    forget(there, held)
    return out


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, digest, spans), written: of each row that has any, the spans of words (start, end) that equal words starting earlier."""
    rows = keyed(docs, id_col, text_col)
    found = paths(rows, window, anchor)
    keys = minimizers(rows, window, anchor)
    shared = written(keys.where("n > 1").select("minimizer", (F.col("low") != F.col("high")).alias("branches")), "minimizers", compact=True)
    met = written(found.join(shared, "minimizer"), "paths")
    only_next = F.when((F.count("next") == F.count("*")) & (F.min("next") == F.max("next")), F.min("next"))
    grouped = met.groupBy("minimizer", "h", "path", "branches").agg(F.min(F.struct(*ROW, "at", "edges")).alias("f"), F.count("*").alias("n"), only_next.alias("next"))
    grouped = written(grouped.select("minimizer", "h", "path", "branches", place("f").alias("first"), F.col("f.edges").alias("edges"), "n", "next"), "distinct-paths")
    long = compacted(grouped.where("n > 1"))
    heads = long.select("minimizer", "h", "first", (F.col("edges") + (window - 1)).alias("n"), F.concat(F.lit("p"), F.hex("minimizer"), F.hex("h")).alias("key"))
    whole = met.select("minimizer", "h", *ROW, "at").join(heads, ["minimizer", "h"]).where(~place().eqNullSafe(F.col("first"))).select("key", *ROW, "at", "n", "first")
    edges = written(single_edges(rows, grouped.where("branches").select("first.*", "edges"), window), "edges")
    first_edge = edges.groupBy("h", "g").agg(F.min(place()).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first")
    first_edge = written(first_edge, "first-edges")
    single = edges.join(first_edge, ["h", "g"]).where(~place().eqNullSafe(F.col("first"))).select(F.concat(F.lit("e"), F.hex("h"), F.hex("g")).alias("key"), *ROW, "at", F.lit(window).alias("n"), "first")
    copies = whole.unionByName(single)
    merge = written(merged(copies), "copies")
    forget(shared, grouped)
    sure = settled(rows, merge, copies)
    spans = written(per_row(sure.select(*ROW, F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end")), "start", "end").withColumnRenamed("wanted", "spans"), "spans")
    forget(met, long, edges, first_edge, merge, sure)
    return spans


def remove_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with ``n_words``, ``removed_spans`` (merged, half-open, in words) and ``kept_text``, the words left joined by one space."""
    tuned(docs.sparkSession)
    spans = later_copies(docs, id_col, text_col, window, anchor).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("spans").alias("__spans"))
    own = docs.withColumn("__own", F.xxhash64(text_col))
    joined = own.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest")), "left").drop("__id", "__own", "__digest")

    def make():
        def run(part: pa.RecordBatch) -> list:
            own = column(part, "__spans")
            row = np.repeat(np.arange(len(own)), np.asarray(own.value_lengths().fill_null(0)))
            start, end = (np.asarray(own.flatten().field(c)).astype(np.int64) for c in ("start", "end"))
            row, start, end = union_of_spans(row, start, end)
            bounds = np.searchsorted(row, np.arange(len(own) + 1))
            low, high, of = start.tolist(), end.tolist(), bounds.tolist()
            sizes, texts = [], []
            for i, text in enumerate(bytes_of(part, text_col)):
                words = (text or b"").split()
                sizes.append(len(words))
                if of[i] < of[i + 1]:
                    kept, at = [], 0
                    for k in range(of[i], of[i + 1]):
                        kept += words[at : low[k]]
                        at = high[k]
                    words = kept + words[at:]
                texts.append(b" ".join(words))
            gone = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["start", "end"])
            return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), gone), pa.array(texts, pa.string())]

        return run

    return add_columns(joined, text_col, "n_words long, removed_spans array<struct<start: int, end: int>>, kept_text string", make, ("__spans",))


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, windows of 20 words."""
    done = remove_later_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
