"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import SPACES, bench_words, classes_of, corpus, removed, words

from pyspark.sql import functions as F

from bytelode.llm import bpe, decontaminate, jaccard, licenses, quality, substrings, tokens
from bytelode.llm._text import Ranges, Words, flat, grams

@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([(i, t, f"n{i}", i) for i, t in rows], "doc_id long, text string, n_words string, ids long").repartition(3), dict(rows)


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a bb ccc", None, "", "  x", "longer-than-eight-bytes longer-than-eight-bytez", "a bb"]
    w = Words(*flat(pa.array(texts)))
    raw = w.buf.tobytes()
    found = [raw[s:e].decode() for s, e in zip(w.start, w.end, strict=True)]
    assert found == [x for t in texts for x in words(t)] and w.count.tolist() == [len(words(t)) for t in texts]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(found)) and h[0] == h[6] and h[1] == h[7]
    assert grams(h, 2)[0] == grams(h, 2)[6] and Ranges(h).hash(np.array([0]), np.array([2])) == Ranges(h).hash(np.array([6]), np.array([8]))
    assert not len(Words(*flat(pa.array([], pa.string()))).hashes())


@pytest.fixture(scope="module")
def joined(docs):
    return {r.doc_id: r for r in jaccard.similarity_classes(docs[0], block=8, limit=6, block_items=20_000).collect()}


def test_jaccard_join(docs, joined):
    root, degree = classes_of(docs[1])
    assert {i: (r.class_id, r.n_links) for i, r in joined.items()} == {i: (root[i], degree[i]) for i in root}
    assert sum(root[i] != i for i in root) > 15


def test_jaccard_overlaps_and_runs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(9)]
    got = jaccard.overlaps(sets)
    wide = [jaccard.mix(s) for s in sets]
    monkeypatch.setattr(jaccard, "ITEMS_AT_ONCE", 100)
    assert (jaccard.overlaps([np.sort(s) for s in wide]) == got)[~np.eye(9, dtype=bool)].all()
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)
    assert jaccard.runs_for(0.8, 0.9999) <= jaccard.runs_for(0.8, 0.999999) and jaccard.runs_for(0.5, 0.99) > jaccard.runs_for(0.9, 0.99)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similarity_classes(empty).collect() == []
    rows = jaccard.similarity_classes(spark.createDataFrame([(None, "a b", 1), (4, "a b", 1), (4, "a b", 1), (3, "a b", 1), (9, None, 1)], "doc_id long, text string, class_id int")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in rows) == [(0, 0, 0, 1), (3, 3, 2, 3), (4, 3, 2, 3), (4, 3, 2, 3), (9, 9, 0, 1)]


def test_jaccard_join_of_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = jaccard.similarity_classes(spark.createDataFrame([(4, text), (4, text + " more"), (5, text), (4, "none of it"), (6, "b " * 400_000)], "doc_id long, text string"), limit=1).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in rows) == [(4, 4, 0, 1), (4, 4, 2, 1), (4, 4, 2, 2), (5, 4, 2, 2), (6, 6, 0, 1)]


@pytest.mark.parametrize("similarity, shared", [(0.5, 24), (0.8, 60), (0.9, 120)])
def test_jaccard_recall_in_deep_buckets(spark, similarity, shared):
    """Pairs just above the threshold, in buckets far over the limit: all texts share a passage."""
    rng = random.Random(int(100 * similarity))
    passage = [f"p{k}" for k in range(shared)]
    rows, pairs = [], 0
    for i in range(350):
        own = [f"o{i}x{k}" for k in range(shared)]
        rows.append((2 * i, " ".join(passage + own)))
        # words of the pair's second text are changed from the end until it is just above the threshold
        both = len(passage + own) - 4
        n = int(both * (1 - similarity) / (1 + similarity))
        rows.append((2 * i + 1, " ".join(passage + own[: shared - n] + [f"n{i}x{k}" for k in range(n)])))
        pairs += 1
    rng.shuffle(rows)
    got = {r.doc_id: r for r in jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity, limit=12).collect()}
    found = sum(got[2 * i].class_id == got[2 * i + 1].class_id == 2 * i for i in range(pairs))
    assert found >= 0.99 * pairs and all(r.n_links <= 1 for r in got.values())


def test_substrings(docs):
    rows = substrings.remove_later_copies(docs[0]).collect()
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.removed_spans), r.kept_text) for r in rows}
    assert got == removed(docs[1]) and len(rows) == len(docs[1])
    assert "ids" in rows[0] and all(a.end < b.start for r in rows for a, b in zip(r.removed_spans, r.removed_spans[1:]))


def test_substrings_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_later_copies(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(25))
    rows = substrings.remove_later_copies(spark.createDataFrame([(None, text), (1, text), (1, text), (2, "x " + text)], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.kept_text) for r in rows) == [(0, text), (1, ""), (1, ""), (2, "x")]


def test_substrings_of_rows_that_share_an_id(spark):
    """Rows without id and rows of one id: texts of their own, in order of their digests; equal rows fare alike."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for i in range(60):
        words_ = [f"u{i}x{k}" for k in range(rng.randint(0, 60))]
        at = rng.randint(0, len(words_))
        words_[at:at] = passage[rng.randint(0, 50) :][: rng.randint(0, 70)] * rng.randint(1, 2)
        rows.append((rng.choice([None, None, 1, 1, 2, i + 3]), " ".join(words_)))
    rows += rng.sample(rows, 15)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    digest = {r.text: r.d for r in frame.selectExpr("text", "xxhash64(text) AS d").collect()}
    order = sorted({(i is not None, i or 0, digest[t], t) for i, t in rows})
    want = removed({k: x[3] for k, x in enumerate(order)})
    want = {(i if has else None, t): want[k] for k, (has, i, _, t) in enumerate(order)}
    got = [(r.doc_id, r.text, (r.n_words, sum(s.end - s.start for s in r.removed_spans), r.kept_text)) for r in substrings.remove_later_copies(frame).collect()]
    assert len(got) == len(rows) and all(want[i, t] == x for i, t, x in got)
    assert sum(x[1] > 0 for *_, x in got) > 20


def test_substrings_compare_words_not_hashes(spark):
    """With words that share their hashes only those removed whose words are the same."""
    same = lambda n: " ".join(f"w{i % 7}" if i else f"first{n}" for i in range(22))
    texts = {0: same(1), 1: same(2), 2: same(1), 3: same(2), 4: same(3)}
    rows = substrings.keyed(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text")
    first = rows.where("id = 0").select(F.struct("id", "digest", F.lit(0).alias("at")).alias("first"))
    copies = rows.where("id > 0").crossJoin(first).select(F.lit("k").alias("key"), "id", "digest", F.lit(0).alias("at"), F.lit(22).alias("n"), "first")
    assert sorted(r.id for r in substrings.verified(rows, copies).collect()) == [2, 3]


def test_substrings_read_words_once_not_for_each_copy(spark, monkeypatch):
    """Windows that overlap, and lines that a document repeats, are compared as one span; long ones in cells."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(900)]
    texts = {0: passage}
    for i in range(1, 12):
        own = list(passage)
        for _ in range(6):
            own[rng.randrange(900)] = f"x{i}y{rng.random()}"
        texts[i] = own
    texts[12] = [f"l{i}" for i in range(9)] * 150
    texts[13] = ["a"] + [f"l{i}" for i in range(9)] * 60 + passage[:400] + ["same"] * 300
    read, words_at = [], substrings.words_at
    monkeypatch.setattr(substrings, "words_at", lambda rows, places: read.append(places.agg(F.sum("n")).first()[0] or 0) or words_at(rows, places))
    frame = spark.createDataFrame([(str(10 + i), " ".join(t)) for i, t in texts.items()], "doc_id string, text string").repartition(3)
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.removed_spans), r.kept_text) for r in substrings.remove_later_copies(frame).collect()}
    want = removed({str(10 + i): " ".join(t) for i, t in texts.items()})
    assert got == want
    # each copy and its source, and a little for the ends
    assert sum(read) <= 2.2 * sum(n for _, n, _ in want.values())


def test_substrings_compare_spans_with_their_sources(spark):
    """One word of a long span that isn't its source's is found; then copies are judged one by one."""
    passage = [f"p{i}" for i in range(700)]
    other = [*passage[:400], "x", *passage[401:]]
    texts = {None: passage, 1: passage, 2: other, 3: passage[100:]}
    rows = substrings.keyed(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string"), "doc_id", "text")
    first = rows.where("id IS NULL").select(F.struct("id", "digest", F.when(F.col("id").isNull(), 0).alias("at")).alias("first"))
    whole = rows.where("id IN (1, 2)").crossJoin(first).select(F.lit("k").alias("key"), "id", "digest", F.lit(0).alias("at"), F.lit(700).alias("n"), "first")
    ends = rows.where("id = 3").crossJoin(first).select(F.lit("e").alias("key"), "id", "digest", F.lit(0).alias("at"), F.lit(20).alias("n"), F.struct("first.id", "first.digest", F.lit(100).alias("at")).alias("first"))
    some = whole.where("id = 1").unionByName(ends)
    places = lambda frame: sorted((r.id, r.at, r.n) for r in frame.collect())
    assert places(substrings.settled(rows, substrings.merged(some), some)) == [(1, 0, 700), (3, 0, 20)]
    every = whole.unionByName(ends)
    assert [(r.id, r.at // substrings.CELL) for r in substrings.differing(rows, substrings.merged(every)).collect()] == [(2, 400 // substrings.CELL)]
    assert places(substrings.settled(rows, substrings.merged(every), every)) == [(1, 0, 700), (3, 0, 20)]


def test_substrings_compact_paths_without_branches(spark):
    """A passage in many documents is one long path, not one for each minimizer."""
    passage = " ".join(f"p{i}" for i in range(400))
    docs = spark.createDataFrame([(i, f"a{i} {passage} z{i}") for i in range(9)] + [(20, "b " + " ".join(passage.split()[:150]))], "doc_id long, text string")
    found = substrings.paths(substrings.keyed(docs, "doc_id", "text"), 20, 8)
    only = F.when((F.count("next") == F.count("*")) & (F.min("next") == F.max("next")), F.min("next"))
    grouped = found.groupBy("minimizer", "h", "path").agg(F.min(F.struct("id", "digest", "at", "edges")).alias("f"), F.count("*").alias("n"), only.alias("next"))
    repeated = grouped.select("minimizer", "h", "path", F.struct("f.id", "f.digest", "f.at").alias("first"), F.col("f.edges").alias("edges"), "n", "next").where("n > 1")
    long = substrings.compacted(repeated).collect()
    total, edges = repeated.agg(F.count("*"), F.sum("edges")).first()
    assert sum(r.edges for r in long) == edges and len(long) <= 4 < total / 5


def by_hand(trees, x):
    """The chance of one row, node by node."""

    def walk(node):
        if trees.feature[node] < 0:
            return trees.value[node]
        return walk(trees.left[node] + int(x[trees.feature[node]] > trees.threshold[node]))

    return 1 / (1 + np.exp(-(trees.base + sum(walk(r) for r in trees.root))))


def test_quality(spark, docs):
    import pyarrow as pa

    frame, texts = docs
    labels = spark.createDataFrame([(i, int(len(t or "") % 3 > 0)) for i, t in texts.items() if i % 2] + [(1, None), (None, 1), (99999, 0)], "doc_id long, quality int")
    trees = quality.train(frame, labels)
    rows = {r.doc_id: r for r in quality.judge(frame, trees).collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        w, s = words(t), t or ""
        count = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
        cover = {b for a in range(len(w) - 4) if count[tuple(w[a : a + 5])] > 1 for b in range(a, a + 5)}
        lines = [x for x in s.split("\n") if re.search(SPACES, x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(cover))
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)
        assert r.kept == (not r.base_failed and abs(r.quality_score - 0.5) >= 1e-12 and by_hand(trees, quality.features({k: v for k, v in quality.statistics(pa.array([t], pa.string()), [s]).items()})[0]) >= 0.5)
    assert len({r.kept for r in rows.values()}) == 2
    again = quality.train(frame.unionByName(frame).repartition(5), labels.unionByName(labels).repartition(2))
    assert all(np.array_equal(getattr(again, a), getattr(trees, a)) for a in ("root", "feature", "threshold", "left", "value"))
    assert quality.train(frame, labels.where("quality = 1")) is None
    assert all(r.kept != r.base_failed for r in quality.judge(frame, None).collect())
    assert quality.judge(frame.limit(0), trees).collect() == []


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = quality.fit(x[:2000], y[:2000], (-1, 0, 1))
    assert ((trees.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.9
    for j, sign in ((0, -1), (2, 1)):
        grid = np.repeat(x[:50], 40, 0)
        grid[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(trees.score(grid).reshape(50, 40), axis=1) >= -1e-12).all()


@pytest.mark.parametrize("block_bytes, at_once", [(1 << 20, 4), (300, 9), (100, 1)])
def test_decontamination(spark, docs, block_bytes, at_once):
    frame, texts = docs
    long = next(t for t in texts.values() if t and 100 < len(bench_words(t)) < 300)
    items = [(1, " ".join(bench_words(long)[5:30]).upper()), (2, "ONE"), (2, "one"), (3, "a, b... c-d"), (4, None), (5, ""), (None, "end"), (6, "nowhere to be found"), (7, "x " * 12), (8, " ".join(bench_words(long)[5:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    patterns = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[a : a + n])].add("null" if i is None else str(i))
    rows = decontaminate.find_contamination(frame, bench, block_bytes=block_bytes, blocks_at_once=at_once).collect()
    assert len(rows) == len(texts)
    some = 0
    for r in rows:
        w, hit, found = bench_words(texts[r.doc_id]), set(), set()
        for n in {len(p) for p in patterns}:
            for a in range(len(w) - n + 1):
                if names := patterns.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= names
        assert (r.n_words, {j for s in r.hit_spans for j in range(s.start, s.end)}, r.hit_items) == (len(w), hit, sorted(found))
        some += bool(hit)
    assert some > 5
    assert decontaminate.find_contamination(frame.limit(0), bench).collect() == []
    assert all(not r.hit_spans for r in decontaminate.find_contamination(frame, bench.limit(0)).collect())


def test_benchmark_blocks_are_small():
    import pyarrow as pa

    rng = random.Random(9)
    words_ = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(5000)]
    texts = [" ".join(rng.choice(words_) for _ in range(40)) for _ in range(2000)]
    raw = decontaminate.Block.build([str(i) for i in range(2000)], pa.array(texts), 10).dump()
    assert len(raw) < 8 * sum(map(len, texts)) + (4 << 20)
    block = decontaminate.Block.load(raw)
    held = [block.words.buf, block.words.start, block.words.end, block.words.inside, block.h, *(getattr(p, a) for p in block.patterns for a in p.ARRAYS)]
    assert sum(x.nbytes for x in held) < 14 * sum(map(len, texts)) + (4 << 20)


def test_benchmark_blocks_do_not_follow_the_tasks(spark, monkeypatch):
    frame = type(spark.range(0))
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: dealt(self, max(n, 61), *cols))
    bench = spark.createDataFrame([(i, f"some words of item {i} " * 5) for i in range(300)], "item_id long, text string")
    total = sum(len(r.text) for r in bench.collect())

    def blocks(block_bytes):
        return [decontaminate.Block.load(bytes(r.block)) for r in decontaminate.build_blocks(bench, "item_id", "text", 10, block_bytes).collect()]

    assert len(blocks(1 << 20)) == 1
    some = blocks(total // 6)
    assert len(some) <= 14 and sorted(n for b in some for n in b.names) == sorted(map(str, range(300))) and all(len(b.words.buf) <= total // 6 for b in some)


def test_patterns_of_equal_hash_stay_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "grams", lambda h, n: np.zeros(max(len(h) - n + 1, 0), np.uint64))
    block = decontaminate.Block.build(["p", "q", "r"], pa.array(["a b", "c d", "a b"]), 2)
    text = decontaminate.plain_words(pa.array(["x c d", "a b a b", "b c"]))
    hit, names = np.zeros(len(text), bool), {}
    block.mark(text, text.hashes(), hit, names)
    assert names == {0: {"q"}, 1: {"p", "r"}} and hit.tolist() == [False, True, True, True, True, True, True, False, False]


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe(spark, docs, vocabulary):
    frame, texts = docs
    both = bpe.decode(bpe.encode(frame.withColumnsRenamed({"ids": "kept"}), vocabulary, chunk=1000, overlap=200), vocabulary).collect()
    e = bpe.encoding(vocabulary)
    assert len(both) == len(texts)
    for r in both:
        assert np.frombuffer(r["ids"], "<u4").tolist() == e.encode_ordinary(texts[r.doc_id] or "") and r.kept == r.doc_id
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    long = "it's a b c " * 300
    same = spark.createDataFrame([(7, long), (7, long), (8, long), (None, long), (None, long)], "doc_id long, text string").repartition(1)
    rows = bpe.encode(same, vocabulary, chunk=100, overlap=40).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 7, 7, 8] and {bytes(r["ids"]) for r in rows} == {np.array(e.encode_ordinary(long), "<u4").tobytes()}
    assert bpe.digests(frame.limit(0)).collect() == []


def test_bpe_chunks_meet_anywhere(spark, vocabulary):
    rng = random.Random(5)
    alphabet = list("ab  \n'sré1!?漢😀") + ["'re", "   ", " don't", "\r\n\r\n", " " * 30, "x" * 60]
    e = bpe.encoding(vocabulary)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk, overlap in ((40, 12), (64, 64), (7, 1)):
        got = {r.doc_id: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode(frame, vocabulary, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: e.encode_ordinary(t) for i, t in enumerate(texts)}


def test_token_files(spark, docs, tmp_path):
    frame, texts = docs
    path = f"file://{tmp_path}/tokens"
    tokens.write_tokens(frame, path, public_tokenizers.path("word_bpe_49k.json"), 2, block_tokens=5000)
    t = tokens.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    at, want = 0, []
    for i in sorted(texts):
        ids = np.array(t.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    got = [(r.id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in tokens.read_tokens(spark, path).orderBy("start").collect()]
    assert got == want
    starts = [r.first for r in spark.read.parquet(f"{path}/blocks").collect()]
    assert starts == sorted(starts) and len(starts) > 3
    odd = spark.createDataFrame([(None, "b"), (2, "a"), (2, None)], "doc_id long, text string")
    tokens.write_tokens(odd, f"{path}-odd", public_tokenizers.path("word_bpe_49k.json"), 2)
    assert [(r.id, r.n_tokens) for r in tokens.read_tokens(spark, f"{path}-odd").orderBy("start").collect()] == [(None, 2), (2, 1), (2, 2)]
    tokens.write_tokens(odd.limit(0), f"{path}-none", public_tokenizers.path("word_bpe_49k.json"), 2)
    assert tokens.read_tokens(spark, f"{path}-none").collect() == []


def test_word_encoder_is_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = tokens.tokenizer(path), tokens.WordEncoder(path, "<u2")
    rng = random.Random(4)
    alphabet = list("abzABZ.,!?'#*%$<|>éÉßÇñĲŉǄİıſÀ0²ªº_-&\u0301\u0130ΣσςАя漢\x1c\x85\u00a0\u2028\r\t\n") + ["'re", "</w>", "<|endoftext|>", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_get_whole_texts():
    for name, words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        t, e = tokens.tokenizer(path), tokens.WordEncoder(path, "<u4")
        texts = ["It's  A Cased Text.\n\nwith  Spaces ", "", "x" * 5000 + " É\tb"]
        assert e.by_words == words and [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_huffman_codes():
    rng = np.random.default_rng(2)
    for n, limit in ((1, 16), (2, 16), (300, 9), (5000, 16)):
        counts = (rng.pareto(0.7, n) * 5).astype(np.int64) + 1
        length = tokens.code_lengths(counts, limit)
        assert length.max() <= limit and sum(2.0 ** -int(x) for x in length) <= 1 + 1e-12
        code, ids = tokens.Code(length), rng.integers(0, n, 3000)
        assert (code.decode(*code.encode(ids), len(ids)) == ids).all() and len(code.decode(*code.encode(ids[:0]), 0)) == 0
    import heapq

    counts = rng.integers(1, 1000, 200)
    heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
    depth = Counter()
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            depth[i] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    assert (tokens.code_lengths(counts, 20).astype(int) * counts).sum() == sum(depth[i] * int(c) for i, c in enumerate(counts))


