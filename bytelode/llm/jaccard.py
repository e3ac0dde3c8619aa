"""N-gram Jaccard join by chosen paths.

A document's set holds the hashes of its ``shingle``-word runs (words are runs of digits, letters and non-ASCII
characters, A-Z lower-cased; a text of fewer words, but not none, is one shingle). Equal sets are one node from the
start, named by a 128-bit hash of the set.

Each of several runs starts from sampled coordinates of a minhash signature: nodes that share the sampled token (the
minimum there) share a bucket. A bucket of more than ``limit`` nodes chooses, by its own hash, further coordinates among
those of its run and level, which no other run uses, and splits again. When the coordinates of all levels are used up,
fresh ones are drawn. A bucket is done when it is small, or when it keeps ``ALIKE`` of the bucket before it: then most
of its pairs are links, and are compared because they are to be counted.

In small buckets signatures are compared by brute force, loosely; nodes that this connects are a group, and the same
group from several buckets is one. The nodes of a bucket that is done by likeness are a group as well. The buckets of
several runs give much the same groups, so those that share nodes with one group are made one where all their nodes fit
in a block; where they don't, only groups by likeness are, and the others stay as they are, so that loose resemblance
never chains to large groups. In each group all pairs are compared exactly, on whole sets, in blocks of
bounded items, so that no task holds more than two blocks and nothing is emitted for a pair. A pair that several groups
hold counts in the first of them only: each node brings the list of its groups. Links connect classes.

With c choices a pair of the least similarity t survives a run with the probability s = 1 - (1 - t s)^c of its depth;
c is chosen so that c t is at least 1.5, and runs are repeated until the chance that all fail is below 1 - ``recall``.
(Tests measure recall in deep buckets.)

Every row is a document of its own, whatever its id. Documents without words and rows without id have no links and are
classes of their own. Columns other than the id and the text are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import column, grouped
from ._shared import forget, table, tuned, written
from ._text import Ranges, grams, i64, mix, odd_constants, plain_words, slices
from .components import connected_components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Coordinates that buckets of one run and level choose among, and levels before fresh ones are drawn.
LEVEL, LEVELS = 5, 6
#: Nodes of a small bucket; nodes and items of a block.
LIMIT, BLOCK, BLOCK_ITEMS = 128, 256, 1 << 20
#: A part that keeps this share of its bucket is compared as it is.
ALIKE = 0.7
COLUMNS_AT_ONCE, ITEMS_AT_ONCE = 8192, 1 << 20
NODE = "binary"
#: Runtime filters for scans of any size, from sides of up to 256 MB.
FILTERED_SCANS = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256m"}


def choices_for(similarity: float) -> int:
    return max(2, math.ceil(1.5 / similarity))


def runs_for(similarity: float, recall: float) -> int:
    s, c = 1.0, choices_for(similarity)
    for _ in range(100):
        s = 1 - (1 - similarity * s) ** c
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - s)))


def sets_of(col: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, flat, and their offsets."""
    words = plain_words(col)
    h = words.hashes()
    g = grams(h, shingle)
    short = np.flatnonzero((words.count > 0) & (words.count < shingle))
    whole = dict(zip(short.tolist(), Ranges(h).hash(words.first[short], words.first[short + 1]), strict=True))
    out = []
    for r, (a, n) in enumerate(zip(words.first[:-1].tolist(), words.count.tolist(), strict=True)):
        out.append(np.unique(g[a : a + n - shingle + 1]) if n >= shingle else np.array([whole[r]], np.uint64) if n else np.zeros(0, np.uint64))
    sizes = np.array([len(x) for x in out], np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, runs: int, choices: int, epoch: int = 0) -> DataFrame:
    """(id, digest, node, n, minhash, roots) of rows with words: digest of the text, size of the set, signature and first
    buckets. Epochs have different coordinates."""
    roots = runs * choices
    width = roots + runs * LEVEL * LEVELS
    a, b, c = odd_constants(width, 11 + 100 * epoch), odd_constants(width, 13 + 100 * epoch), odd_constants(2, 17)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                g, off = sets_of(column(part, text_col), shingle)
                some = np.flatnonzero(np.diff(off))
                size = np.diff(off)[some]
                at = off[:-1][some]
                sig = np.empty((len(some), width), np.uint32)
                prints = np.empty((len(some), 2), np.uint64)
                if len(some):
                    for j in range(width):
                        sig[:, j] = np.minimum.reduceat((g * a[j] + b[j]) >> np.uint64(32), at)
                    for k in range(2):
                        prints[:, k] = np.add.reduceat(mix(g * c[k]), at)
                first = mix(sig[:, :roots].astype(np.uint64) ^ (np.arange(1, roots + 1, dtype=np.uint64) << np.uint64(40)))
                rows = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "id").take(rows), column(part, "digest").take(rows), pa.array([x.tobytes() for x in prints], pa.binary()), pa.array(size), pa.array([x.tobytes() for x in sig], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * roots, pa.int32()), i64(first.ravel()))],
                    names=["id", "digest", "node", "n", "minhash", "roots"],
                )

    return keyed(docs, id_col, text_col).mapInArrow(run, f"id {kind}, digest long, node {NODE}, n long, minhash binary, roots array<long>")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, text) of rows that have an id."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col))


def split(rows: DataFrame, level: int, runs: int, choices: int) -> DataFrame:
    """The parts of buckets (bucket, run, node, size, minhash) by the coordinates that each chooses; levels count from 1."""
    base = runs * choices + (level - 1) % LEVELS * runs * LEVEL

    def run(batches):
        for batch in batches:
            bucket = np.asarray(column(batch, "bucket")).view(np.uint64)
            own = np.asarray(column(batch, "run")).astype(np.int64)
            sig = np.frombuffer(b"".join(column(batch, "minhash").to_pylist()), np.uint32).reshape(len(bucket), -1)
            # the coordinates in an order that the bucket's hash gives; the first ones are its choice
            order = np.argsort(mix(bucket[:, None] ^ odd_constants(LEVEL, level)[None, :]), axis=1)
            for k in range(choices):
                choice = order[:, k % LEVEL]
                value = sig[np.arange(len(bucket)), base + own * LEVEL + choice].astype(np.uint64)
                part = mix(bucket * odd_constants(1, level)[0] + mix(value ^ ((choice + 1).astype(np.uint64) << np.uint64(40))))
                yield pa.RecordBatch.from_arrays([i64(part), column(batch, "run"), column(batch, "node"), column(batch, "size")], names=["bucket", "run", "node", "parent"])

    return rows.select("bucket", "run", "node", "size", "minhash").mapInArrow(run, f"bucket long, run int, node {NODE}, parent long")


def connected_in_bucket(rows: DataFrame, similarity: float) -> DataFrame:
    """(g, node): groups of nodes of a small bucket that resemble each other by signature, directly or not."""

    def fold(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = [x for p in parts for x in column(p, "node").to_pylist()]
        sig = np.frombuffer(b"".join(x for p in parts for x in column(p, "minhash").to_pylist()), np.uint32).reshape(len(nodes), -1)
        width = sig.shape[1]
        least = (similarity - 5 * math.sqrt(similarity * (1 - similarity) / width)) * width
        label = closed(np.stack([(sig == row).sum(1) for row in sig]) >= least)
        for k in np.flatnonzero(np.bincount(label) > 1).tolist():
            own = sorted(nodes[i] for i in np.flatnonzero(label == k).tolist())
            g = int.from_bytes(hashlib.blake2b(b"".join(own), digest_size=8).digest(), "little", signed=True)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["g", "node"])

    return grouped(rows.select("bucket", "node", "minhash"), ["bucket"], f"g long, node {NODE}", fold)


def closed(near: np.ndarray) -> np.ndarray:
    """The first member of each one's component under a symmetric relation."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def merged(groups: DataFrame, block: int, block_items: int) -> DataFrame:
    """(node, groups), the groups as structs (g, blocks): those around a common one made one where that is no more work.

    groups: (node, n, groups), the groups as structs (loose, g). A group is dealt to the first of the groups that it
    shares a node with, one by likeness if there is any. This is one step and no search for components: groups that still
    share nodes afterwards do no harm. A node is in no more groups than its runs have leaves.
    """
    first = groups.select(F.explode("groups.g").alias("g"), F.array_min("groups").alias("first"))
    label = written(first.groupBy("g").agg(F.min("first").alias("first")).select("g", F.col("first.g").alias("label")), "group-labels")
    flat = groups.select("node", "n", F.explode("groups").alias("x")).select("node", "n", "x.g", "x.loose")
    held = flat.join(label, "g").groupBy("label", "node").agg(F.first("n").alias("n"), F.bool_or(~F.col("loose")).alias("alike"), F.collect_set(F.when(F.col("loose"), F.col("g"))).alias("own"))
    held = held.select("node", "n", F.xxhash64("label").alias("whole"), F.concat("own", F.when(F.col("alike"), F.array(F.xxhash64("label", F.lit(1)))).otherwise(F.array().cast("array<bigint>"))).alias("parts"))
    held = written(held, "labelled-groups")
    # the merged groups and their parts are counted at once; which of them are taken shows afterwards
    sizes = held.select(F.explode(F.concat(F.array("whole"), "parts")).alias("g"), "n").groupBy("g").agg(F.count("*").alias("nodes"), F.sum("n").alias("items"))
    sizes = written(sizes.select("g", (F.col("nodes") <= block).alias("fits"), F.greatest(F.ceil(F.col("nodes") / block), F.ceil(F.col("items") / block_items)).cast("int").alias("blocks")), "group-sizes")
    taken = held.join(sizes.select(F.col("g").alias("whole"), "fits"), "whole").select("node", F.explode(F.when(F.col("fits"), F.array("whole")).otherwise(F.col("parts"))).alias("g"))
    out = written(taken.join(sizes.drop("fits"), "g").groupBy("node").agg(F.collect_list(F.struct("g", "blocks")).alias("groups")), "merged-groups")
    forget(label, held, sizes)
    return out


def groups_of(nodes: DataFrame, similarity: float, runs: int, choices: int, limit: int, block: int, block_items: int, fresh) -> DataFrame:
    """(node, groups), written: groups that hold all similar pairs, up to the recall. fresh(epoch): (node, minhash) with
    coordinates that no epoch before had."""
    roots = nodes.select(F.posexplode("roots").alias("k", "bucket"), "node")
    rows = roots.select("bucket", F.floor(F.col("k") / choices).cast("int").alias("run"), "node", F.lit(None).cast("long").alias("parent"))
    minhash, alike_groups, leaves, held, level = nodes.select("node", "minhash"), [], [], [], 1
    while True:
        sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("size"), F.max("parent").alias("parent")).where("size > 1"), "buckets")
        met = written(rows.drop("parent").join(sizes, "bucket"), "bucketed")
        held += [sizes, met]
        leaves.append(met.where(F.col("size") <= limit).select("bucket", "node"))
        large = met.where(F.col("size") > limit)
        if sizes.where(F.col("size") > limit).isEmpty():
            break
        alike = F.coalesce(F.col("size") >= ALIKE * F.col("parent"), F.lit(False))
        alike_groups.append(large.where(alike).select(F.col("bucket").alias("g"), "node"))
        if level > 1 and (level - 1) % LEVELS == 0:
            minhash = fresh((level - 1) // LEVELS)
            held.append(minhash)
        if (level - 1) % LEVELS == 0:
            # the nodes of deeper buckets are among these, so the whole table is shuffled once and not for each level
            minhash = written(minhash.join(large.where(~alike).select("node").distinct(), "node"), "split-signatures")
            held.append(minhash)
        # written, as both the sizes and the join with them read it
        rows = written(split(large.where(~alike).join(minhash, "node"), level, runs, choices), "parts")
        held.append(rows)
        level += 1
    small = leaves[0]
    for x in leaves[1:]:
        small = small.unionByName(x)
    found = connected_in_bucket(small.join(nodes.select("node", "minhash"), "node"), similarity).withColumn("alike", F.lit(False))
    for x in alike_groups:
        found = found.unionByName(x.withColumn("alike", F.lit(True)))
    found = found.groupBy("node").agg(F.collect_set(F.struct((~F.col("alike")).alias("loose"), "g")).alias("groups"))
    found = written(found.join(nodes.select("node", "n"), "node"), "groups")
    forget(*held)
    out = merged(found, block, block_items)
    forget(found)
    return out


def compared(docs: DataFrame, nodes: DataFrame, groups: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Exact links inside the groups. docs: (id, digest, text); nodes: (node, rep, copies), rep an id and digest; groups:
    (node, groups).

    Rows (vertex, root, links): of one comparison of blocks, the first node that a node is joined to and the documents it
    links to. Nodes go by their rep, a struct (id, digest), so that the smallest of a class is its name.
    """
    kind = docs.schema["id"].dataType.simpleString()
    t = Fraction(similarity).limit_denominator(10_000)
    live = written(groups.join(nodes.select("node", "rep", "copies"), "node").select("node", "rep.*", "groups", "copies"), "live")

    # rows equal in id and text all have a node's set; one is enough
    asked = live.where("copies > 0").select("id", "digest", "node", "groups", "copies")
    texts = docs.join(asked, ["id", "digest"]).groupBy("id", "digest").agg(*[F.first(c).alias(c) for c in (text_col, "node", "groups", "copies")])

    def spread(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                g, off = sets_of(column(part, text_col), shingle)
                for r in range(part.num_rows):
                    yield from sent(column(part, "node")[r].as_py(), column(part, "groups")[r].as_py(), part.select(["id", "digest", "copies"]).slice(r, 1), g[off[r] : off[r + 1]].tobytes())

    def sent(node, groups_, row, items):
        number = int.from_bytes(node[:8], "little")
        for x in groups_:
            g, n = x["g"], x["blocks"]
            k = (number ^ (g & (1 << 63) - 1)) % n
            before = [y["g"] for y in groups_ if y["g"] < g]
            # a few rows at a time: each holds the whole set
            for low in range(0, n, 8):
                other = np.arange(low, min(n, low + 8))
                m = len(other)
                same = row.take(pa.array(np.zeros(m, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * m, pa.int64()), pa.array(np.minimum(other, k), pa.int32()), pa.array(np.maximum(other, k), pa.int32()), *same.columns, pa.array(np.full(m, k), pa.int32()), pa.array([before] * m, pa.list_(pa.int64())), pa.array([items] * m, pa.binary())],
                    names=["g", "i", "j", "id", "digest", "copies", "own", "before", "items"],
                )

    def fold(parts):
        ids, digests = (pa.concat_arrays([column(p, c) for p in parts]) for c in ("id", "digest"))
        own, copies = (np.concatenate([np.asarray(column(p, c)) for p in parts]) for c in ("own", "copies"))
        sets_ = [np.frombuffer(x, np.uint64) for p in parts for x in column(p, "items").to_pylist()]
        size = np.array([len(x) for x in sets_])
        near = (t.numerator + t.denominator) * overlaps(sets_) >= t.numerator * (size[:, None] + size[None, :])
        np.fill_diagonal(near, False)
        if own.min() != own.max():
            near &= own[:, None] != own[None, :]
        before = [x for p in parts for x in column(p, "before").to_pylist()]
        if near.any() and any(before):
            # pairs that an earlier group holds as well count there
            numbers = {g: k for k, g in enumerate(sorted({g for x in before for g in x}))}
            held = [np.array(sorted(numbers[g] for g in x), np.uint64) for x in before]
            near &= overlaps(held) == 0
        some = np.flatnonzero(near.any(1))
        if len(some):
            root = pa.array(closed(near)[some])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), digests.take(pa.array(some)), ids.take(root), digests.take(root), pa.array((near @ copies)[some].astype(np.int64))], names=["id", "digest", "root_id", "root_digest", "links"])

    rows = texts.mapInArrow(spread, f"g long, i int, j int, id {kind}, digest long, copies long, own int, before array<long>, items binary")
    with filtered_scans(docs.sparkSession):
        # in order of nodes, so that a root is the smallest of what it stands for
        found = grouped(rows, ["g", "i", "j"], f"id {kind}, digest long, root_id {kind}, root_digest long, links long", fold, ["id", "digest"])
        links = written(found.select(F.struct("id", "digest").alias("vertex"), F.struct(F.col("root_id").alias("id"), F.col("root_digest").alias("digest")).alias("root"), "links"), "links")
    forget(live)
    return links


@contextmanager
def filtered_scans(spark: SparkSession) -> Iterator[None]:
    """Lets Spark drop rows that a join can't need before they are shuffled, by a Bloom filter of the other side's keys.

    The filter's size is bounded by Spark (8 MB); where the keys are too many for it, all rows are shuffled.
    """
    was = {k: spark.conf.get(k, None) for k in FILTERED_SCANS}
    for k, v in FILTERED_SCANS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets; what is on the diagonal means nothing.

    Ranges of hashes are taken one after the other, so that the room this takes doesn't grow with the sets.
    """
    if not sum(map(len, sets)):
        return np.zeros((len(sets), len(sets)), np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[0, both], [both, 0]])
    pieces = -(-sum(map(len, sets)) // ITEMS_AT_ONCE) or 1
    bounds = np.arange(1, pieces, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // pieces)
    cuts = [[0, *np.searchsorted(s, bounds), len(s)] for s in sets]
    out = np.zeros((len(sets), len(sets)))
    for k in range(pieces):
        out += _shared_items([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)])
    return np.rint(out).astype(np.int64)


def _shared_items(sets: list[np.ndarray]) -> np.ndarray:
    """The same by products of the items' incidence, some columns at a time."""
    n = len(sets)
    items = np.concatenate(sets)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(items, kind="stable")
    items, row = items[order], row[order]
    out = np.zeros((n, n))
    if not len(items):
        return out
    which = np.cumsum(np.concatenate([[True], items[1:] != items[:-1]])) - 1
    often = np.bincount(which)[which] > 1
    which, row = which[often], row[often]
    if len(which):
        which = np.cumsum(np.concatenate([[True], which[1:] != which[:-1]])) - 1
        for low in range(0, int(which[-1]) + 1, COLUMNS_AT_ONCE):
            at = slice(np.searchsorted(which, low), np.searchsorted(which, low + COLUMNS_AT_ONCE))
            dense = np.zeros((n, min(COLUMNS_AT_ONCE, int(which[-1]) + 1 - low)), np.float32)
            dense[row[at], which[at] - low] = 1
            out += dense @ dense.T
    return out


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, limit: int = LIMIT, block: int = BLOCK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(id_col, digest, class_id, class_digest, n_links, n_copies) for each row of ``docs``; digest is xxhash64 of the text.

    class_id: the smallest id among the rows that the row is linked to, directly or not, and class_digest the smallest
    digest among those of that id; the two together name the class. n_links: the other rows of at
    least the similarity, exact copies included. n_copies: the rows with its very set, itself included.
    """
    tuned(docs.sparkSession)
    runs, choices = runs_for(similarity, recall), choices_for(similarity)
    marked = written(signatures(docs, id_col, text_col, shingle, runs, choices), "signatures")
    nodes = written(marked.groupBy("node").agg(F.min(F.struct("id", "digest")).alias("rep"), F.first("n").alias("n"), F.first("minhash").alias("minhash"), F.first("roots").alias("roots"), F.count("*").alias("copies")), "nodes")

    def fresh(epoch: int) -> DataFrame:
        again = signatures(docs, id_col, text_col, shingle, runs, choices, epoch)
        return written(again.groupBy("node").agg(F.first("minhash").alias("minhash")), "signatures")

    groups = groups_of(nodes, similarity, runs, choices, limit, block, block_items, fresh)
    links = compared(keyed(docs, id_col, text_col), nodes, groups, text_col, shingle, similarity)
    classes = connected_components(links.select(F.col("vertex").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("vertex").agg(F.sum("links").alias("links"))
    graph = nodes.select("node", F.col("rep").alias("vertex"), "copies").join(classes.withColumnRenamed("id", "vertex"), "vertex", "left").join(linked, "vertex", "left")
    label = F.coalesce("label", "vertex")
    graph = written(graph.select("node", label["id"].alias("class_id"), label["digest"].alias("class_digest"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("copies").alias("n_copies")), "classes")
    forget(nodes, groups, links)
    rows = marked.select("id", "digest", "node").join(graph, "node").select(F.col("id").alias(id_col), "digest", "class_id", "class_digest", "n_links", "n_copies")
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    alone = docs.where(F.col(id_col).isNull() | ~has_words).select(id_col, F.xxhash64(text_col).alias("digest"), F.col(id_col).alias("class_id"), F.xxhash64(text_col).alias("class_digest"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return rows.unionByName(alone)


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: five-word shingles, similarity of 0.8 or more."""
    return similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("digest", "class_digest")
