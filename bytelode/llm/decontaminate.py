"""Benchmark decontamination by Wu-Manber search over words.

The patterns are all windows of ``window`` consecutive words of the benchmark's items; an item of fewer
words is one shorter pattern. Patterns of one length are searched together: a table of shifts, indexed by
a hash of a block of two words, tells how far no pattern can end; where the shift is zero, the bucket of
that suffix block's hash gives the patterns to try, and their words are compared one by one, byte for byte.
Cursors of many stretches of text move in lockstep, so that the loop runs in numpy.

The benchmark is the query set. Tasks cut it into blocks of ``block_bytes`` of text and build each block's tables
once, as flat arrays; the driver passes on one block at a time as a broadcast. Documents are read in one narrow pass
for every ``BLOCKS_AT_ONCE`` blocks, and never shuffled. If one pass is not all, each pass writes what it found under
the texts' digests, and a last pass joins that to the documents.

Null and empty texts have no words; an item whose id is null is named "null". Repeated rows each get a row;
repeated items count once for each id. A column named like a result column gives way to it.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import add_columns, column
from ._shared import forget, table, tuned, written
from ._text import ALNUM, LOWER, Words, grams, mix, odd_constants, plain_words, spans_to_mask

#: Benchmark text in a block; its tables take at most 14 times as much and 4 MB (see tests/llm), in the driver and in each
#: worker.
BLOCK_BYTES = 2 << 20
#: Blocks that a pass over the documents holds.
BLOCKS_AT_ONCE = 4
#: Windows that one cursor goes through.
STRETCH = 256
#: Candidates whose words are compared at once.
COMPARED_AT_ONCE = 1 << 16
SPANS = "array<struct<start: int, end: int>>"
_A, _B = odd_constants(2, 77)


def _slots(h: np.ndarray, end: np.ndarray, block: int, mask: np.uint64) -> np.ndarray:
    """The table slot of the block of words that ends at each place."""
    return (mix(h[end] * _B) if block == 1 else mix(h[end - 1] * _A + h[end] * _B)) & mask


def same_words(a: Words, at: np.ndarray, b: Words, to: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from each place of one sequence have the bytes of those from a place of another."""
    sure = np.ones(len(at), bool)
    for j in range(m):
        live = np.flatnonzero(sure)
        if not len(live):
            break
        x, y = at[live] + j, to[live] + j
        size = a.end[x] - a.start[x]
        equal = size == b.end[y] - b.start[y]
        live, x, y, size = live[equal], x[equal], y[equal], size[equal].astype(np.int64)
        sure[:] = False
        if not len(live):
            break
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        bytes_equal = a.buf[np.repeat(a.start[x], size) + step] == b.buf[np.repeat(b.start[y], size) + step]
        sure[live[np.logical_and.reduceat(bytes_equal, np.cumsum(size) - size)]] = True
    return sure


class Patterns:
    """Wu-Manber tables of patterns of one length: places in the words of a block."""

    ARRAYS = ("starts", "owners_at", "owners", "shift", "by_suffix", "suffix")

    def __init__(self, length: int, **arrays: np.ndarray):
        self.length, self.block = length, min(2, length)
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.mask = np.uint64(len(self.shift) - 1)

    @classmethod
    def build(cls, length: int, words: Words, h: np.ndarray, starts: np.ndarray, item: np.ndarray) -> Patterns:
        """From windows (first word, item); windows of equal words are one pattern, which all their items own."""
        g = grams(h, length)[starts]
        order = np.lexsort((starts, g))
        starts, item, g = starts[order], item[order], g[order]
        opens = np.concatenate([[True], g[1:] != g[:-1]])
        # what has another's hash but other words is a pattern of its own
        group = np.cumsum(opens) - 1
        odd = np.flatnonzero(~same_words(words, starts, words, starts[opens][group], length))
        group[odd] = len(starts) + np.arange(len(odd))
        order = np.argsort(group, kind="stable")
        starts, item, group = starts[order], item[order], group[order]
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        own = starts[at].astype(np.int32)
        block = min(2, length)
        bits = min(22, max(12, int(math.log2(len(own) * length + 1)) + 3))
        mask = np.uint64((1 << bits) - 1)
        shift = np.full(1 << bits, min(255, length - block + 1), np.uint8)
        for j in range(block - 1, length):
            np.minimum.at(shift, _slots(h, own + j, block, mask), min(255, length - 1 - j))
        suffix = _slots(h, own + length - 1, block, mask).astype(np.uint32)
        by = np.argsort(suffix, kind="stable")
        return cls(length, starts=own, owners_at=np.concatenate([at, [len(starts)]]).astype(np.int32), owners=item.astype(np.int32), shift=shift, by_suffix=by.astype(np.int32), suffix=suffix[by])

    def search(self, words: Words, h: np.ndarray, bench: Words, bench_h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences: first word, pattern."""
        m = self.length
        # stretches: windows that start in [s, e)
        n = np.maximum(words.count - m + 1, 0)
        pieces = -(-n // STRETCH)
        row = np.repeat(np.arange(len(n)), pieces)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = words.first[row] + k * STRETCH + m - 1
        stop = np.minimum(words.first[row] + (k + 1) * STRETCH, words.first[row] + n[row]) + m - 1
        found = []
        while len(at):
            slot = _slots(h, at, self.block, self.mask)
            step = self.shift[slot]
            hit = step == 0
            if hit.any():
                found.append((at[hit], slot[hit].astype(np.uint32)))
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, slot = (np.concatenate(x) for x in zip(*found, strict=True))
        low, high = np.searchsorted(self.suffix, slot), np.searchsorted(self.suffix, slot, "right")
        some = high > low
        at, low, size = at[some] - (m - 1), low[some], (high - low)[some]
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), COMPARED_AT_ONCE), "right")
        places, patterns = [], []
        for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
            n = size[a:b]
            place = np.repeat(at[a:b], n)
            pattern = self.by_suffix[np.repeat(low[a:b], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
            for j in range(m):
                same = h[place + j] == bench_h[self.starts[pattern] + j]
                place, pattern = place[same], pattern[same]
            sure = same_words(words, place, bench, self.starts[pattern].astype(np.int64), m)
            places.append(place[sure])
            patterns.append(pattern[sure])
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, patterns))


class Block:
    """The words and patterns of some items."""

    def __init__(self, names: list[str], words: Words, h: np.ndarray, patterns: list[Patterns]):
        self.names, self.words, self.h, self.patterns = names, words, h, patterns

    @classmethod
    def build(cls, names: list[str], texts: pa.Array, window: int) -> Block:
        words = plain_words(texts)
        h = words.hashes()
        size = np.minimum(window, words.count)
        patterns = []
        for length in np.unique(size[size > 0]).tolist():
            items = np.flatnonzero(size == length)
            n = words.count[items] - length + 1
            item = np.repeat(items, n)
            starts = words.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            patterns.append(Patterns.build(length, words, h, starts, item))
        return cls(names, words, h, patterns)

    def dump(self) -> bytes:
        arrays = {"buf": self.words.buf, "offsets": self.words.offsets, "names": np.frombuffer("\0".join(x.replace("\0", "\1") for x in self.names).encode(), np.uint8)}
        arrays["lengths"] = np.array([p.length for p in self.patterns], np.int64)
        arrays |= {f"{k}_{name}": getattr(p, name) for k, p in enumerate(self.patterns) for name in Patterns.ARRAYS}
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Block:
        a = np.load(io.BytesIO(raw))
        words = Words(LOWER[a["buf"]], a["offsets"], ALNUM)
        patterns = [Patterns(int(n), **{name: a[f"{k}_{name}"] for name in Patterns.ARRAYS}) for k, n in enumerate(a["lengths"])]
        return cls(a["names"].tobytes().decode().split("\0"), words, words.hashes(), patterns)

    def mark(self, words: Words, h: np.ndarray, hit: np.ndarray, names: dict[int, set[str]]) -> None:
        """Marks the words of all occurrences, and notes the items of each row."""
        for p in self.patterns:
            at, pattern = p.search(words, h, self.words, self.h)
            hit |= spans_to_mask(len(words), at, at + p.length)
            row = np.searchsorted(words.first, at, "right") - 1
            both = np.unique(np.stack([row, pattern], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            for r, k in both.tolist():
                names.setdefault(r, set()).update(self.names[i] for i in p.owners[p.owners_at[k] : p.owners_at[k + 1]].tolist())


def build_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> DataFrame:
    """(block): tables of blocks of items, each of at most block_bytes of text or of one item; written."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    total = benchmark.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where(size > 0)
    # a block's number comes from its items and not from the task they are dealt to; a tenth stays free for what hashes deal unevenly
    n = 1 if total <= block_bytes else -(-total // max(1, block_bytes * 9 // 10))
    rows = rows.withColumn("number", F.pmod(F.xxhash64("id", "text"), F.lit(n)))

    def made(names: list[str], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([Block.build(names, pa.array(texts, pa.large_string()), window).dump()], pa.binary())], names=["block"])

    def run(batches):
        names, texts, used, at = [], [], 0, None
        for batch in batches:
            for name, text, number in zip(*(column(batch, c).to_pylist() for c in ("id", "text", "number")), strict=True):
                own = len(text.encode())
                if texts and (number != at or used + own > block_bytes):
                    yield made(names, texts)
                    names, texts, used = [], [], 0
                names.append(name)
                texts.append(text)
                used += own
                at = number
        if texts:
            yield made(names, texts)

    return written(rows.repartition(n, "number").sortWithinPartitions("number").mapInArrow(run, "block binary"), "benchmark-blocks")


def _spans(words: Words, hit: np.ndarray) -> pa.Array:
    """Runs of marked words of each row."""
    inner = np.ones(len(hit), bool)
    inner[words.first[:-1][words.count > 0]] = False
    before = np.concatenate([[False], hit[:-1]]) & inner
    opens = np.flatnonzero(hit & ~before)
    after = np.concatenate([hit[1:] & inner[1:], [False]]) if len(hit) else hit
    closes = np.flatnonzero(hit & ~after) + 1
    row = np.searchsorted(words.first, opens, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(opens - words.first[row], pa.int32()), pa.array(closes - words.first[row], pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(opens, words.first), pa.int32()), spans)


def _search(docs: DataFrame, text_col: str, held: list) -> DataFrame:
    """One pass: ``docs`` with n_words, hit_spans and hit_items of some broadcast blocks."""

    def make():
        blocks = [Block.load(b.value) for b in held]

        def run(part: pa.RecordBatch) -> list:
            words = plain_words(column(part, text_col))
            h, hit, names = words.hashes(), np.zeros(len(words), bool), {}
            for block in blocks:
                block.mark(words, h, hit, names)
            return [pa.array(words.count, pa.int64()), _spans(words, hit), pa.array([sorted(names.get(r, ())) for r in range(part.num_rows)], pa.list_(pa.string()))]

        return run

    return add_columns(docs, text_col, f"n_words long, hit_spans {SPANS}, hit_items array<string>", make)


def _merged(docs: DataFrame, text_col: str) -> DataFrame:
    """The last pass: spans of several passes (__spans, of a row's text) made one."""

    def make():
        def run(part: pa.RecordBatch) -> list:
            words = plain_words(column(part, text_col))
            found = column(part, "__spans")
            row = words.first[np.repeat(np.arange(len(found)), pa.compute.fill_null(pa.compute.list_value_length(found), 0).to_numpy(zero_copy_only=False))]
            flat_spans = found.flatten()
            start, end = (np.asarray(flat_spans.field(k)).astype(np.int64) + row for k in ("start", "end"))
            items = [sorted(set(x or ())) for x in column(part, "__items").to_pylist()]
            return [pa.array(words.count, pa.int64()), _spans(words, spans_to_mask(len(words), start, end)), pa.array(items, pa.list_(pa.string()))]

        return run

    return add_columns(docs, text_col, f"n_words long, hit_spans {SPANS}, hit_items array<string>", make, ("__spans", "__items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, blocks_at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged, half-open, in words) and ``hit_items`` (sorted ids as strings)."""
    spark = tuned(docs.sparkSession)
    blocks = build_blocks(benchmark, item_id, item_text, window, block_bytes)
    n = blocks.count()
    texts = docs if n <= blocks_at_once else docs.where(F.length(text_col) > 0).select(F.sha2(F.col(text_col).cast("binary"), 256).alias("__digest"), F.col(text_col))
    held, passes = [], []
    for k, row in enumerate(blocks.toLocalIterator(), 1):
        held.append(spark.sparkContext.broadcast(bytes(row.block)))
        if n > blocks_at_once and (len(held) == blocks_at_once or k == n):
            found = _search(texts, text_col, held).where(F.size("hit_spans") > 0).select("__digest", "hit_spans", "hit_items")
            passes.append(written(found.groupBy("__digest").agg(F.first("hit_spans").alias("spans"), F.first("hit_items").alias("items")), "contaminated"))
            for b in held:
                b.destroy()
            held = []
    forget(blocks)
    if n <= blocks_at_once:
        return _search(docs, text_col, held)
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    # a row for each pass at most
    found = written(found.groupBy("__digest").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items")), "contaminated")
    forget(*passes)
    own = docs.withColumn("__own", F.sha2(F.col(text_col).cast("binary"), 256))
    return _merged(own.join(found, F.col("__own") == F.col("__digest"), "left").drop("__own", "__digest"), text_col)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` against all of ``benchmark``, in windows of ten words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
