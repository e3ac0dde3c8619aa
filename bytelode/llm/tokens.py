"""Token ids of a corpus in files of canonical, length-limited Huffman codes.

A folder holds two Parquet tables. ``code``: (id, length), the code word lengths of the ids that occur; words are
canonical, in order of (length, id). ``blocks``: (first, n_tokens, documents, starts, bits, checkpoints), in ascending
order of ``first``, the position of the block's first id in the corpus. A block holds whole documents, in ascending
order of their ids, and can be decoded on its own; ``bits`` are code words from the most significant bit on, and
``checkpoints`` the bit offsets of every ``STRIDE``-th id as little-endian unsigned 64-bit integers, so that its
stretches decode side by side. A text of any length that a row holds is one document of one block.

The lengths come from exact global counts by package-merge under ``LIMIT`` bits. Texts are encoded once, by the
tokenizers library. Where the tokenizer's file has the normaliser and pre-tokeniser of ``BY_WORDS``, no token spans a
space, newline or tab, so words between them are encoded once and looked up after that, while a worker remembers them;
with any other file whole texts go to the library.

A null text is empty and has the end id only. Rows that share an id stand next to each other in order of text; a
null id comes first. Other columns are left out.
"""

from __future__ import annotations

import json
import string
import zlib
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ._arrow import column, texts_of
from ._shared import forget, scratch, table, tuned, write_once, written
from ._text import slices

LIMIT, STRIDE, BLOCK_TOKENS = 16, 256, 1 << 18
#: Words whose ids a worker remembers.
CACHED = 600_000


@lru_cache(2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The byte-level alphabet of the model: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = iter(range(256, 512))
ALPHABET = [chr(b if b in _PRINTABLE else next(_OTHERS)) for b in range(256)]
MARKS = string.punctuation


#: The settings of a tokenizer that reads words one by one, in lower case, without white space.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def reads_words(t) -> bool:
    """Whether a tokenizer has the settings of ``BY_WORDS``, and no added token with white space."""
    own = json.loads(t.to_str())
    return all(own[k] == v for k, v in BY_WORDS.items()) and not any(c.isspace() for x in own["added_tokens"] for c in x["content"])


class WordEncoder(dict):
    """Ids of words, and so of texts, by the tokenizers library, as little-endian bytes of one width.

    A tokenizer that doesn't read words one by one gets whole texts. With one that does, a word of Latin letters, with or without punctuation behind it, is one pre-token and perhaps a second. So the letters
    go to the library's model as they are, lower-cased, and are remembered apart from the punctuation. Whatever else
    stands between spaces goes through the whole library.
    """

    def __init__(self, path: str, dtype: str):
        super().__init__()
        self.tokenizer = tokenizer(path)
        self.model, self.letter = self.tokenizer.model, {"<u2": "H", "<u4": "I"}[dtype]
        self.by_words = reads_words(self.tokenizer)
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack(f"<{len(ids)}{self.letter}", *ids)

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        low = core.lower()
        ids = self.letters.get(low)
        if ids is None:
            # Latin letters below U+0250 are composed already, and their lower case is theirs alone
            if not core.isalpha() or not core.isascii() and (max(core) >= "\u0250" or "\u0130" in core):
                ids = self[word] = self._whole(word)
                return ids
            own = [t.id for t in self.model.tokenize(low if low.isascii() else "".join([ALPHABET[b] for b in low.encode()]))]
            ids = self.letters[low] = pack(f"<{len(own)}{self.letter}", *own)
        if len(core) < len(word):
            mark = word[len(core) :]
            own = self.marks.get(mark)
            if own is None:
                own = self.marks[mark] = self._whole(mark)
            ids += own
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [self._whole(t) for t in texts]
        for held in (self, self.letters, self.marks):
            if len(held) > CACHED:
                held.clear()
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").split(" "))) for t in texts]


@lru_cache(2)
def encoder(path: str, dtype: str) -> WordEncoder:
    """A worker's encoder, with what it remembers from task to task."""
    return WordEncoder(path, dtype)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code under ``limit`` bits (package-merge); 0 for counts of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit in {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    merged, kinds = weight, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(merged) // 2 * 2
        both = np.concatenate([weight, merged[:even:2] + merged[1:even:2]])
        sort = np.argsort(both, kind="stable")
        merged = both[sort]
        kinds.append(sort < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for symbol in reversed(kinds):
        singles = int(symbol[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    out[order] = lengths
    return out


class Code:
    """A canonical code: words for encoding, tables for decoding."""

    def __init__(self, length: np.ndarray):
        self.length = length.astype(np.int64)
        self.limit = max(1, int(self.length.max(initial=1)))
        used = np.flatnonzero(self.length)
        order = used[np.lexsort((used, self.length[used]))]
        step = np.int64(1) << (self.limit - self.length[order])
        aligned = np.cumsum(step) - step
        self.word = np.zeros(len(length), np.uint64)
        self.word[order] = (aligned >> (self.limit - self.length[order])).astype(np.uint64)
        #: of every string of ``limit`` bits: the id it starts with
        self.ids = np.zeros(1 << self.limit, np.uint32)
        self.ids[: int(step.sum())] = np.repeat(order, step)
        self.sizes = self.length[self.ids].astype(np.int64)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Bits and checkpoints."""
        size = self.length[ids]
        end = np.cumsum(size)
        at = end - size
        total = int(end[-1]) if len(end) else 0
        place = at >> 5
        words = self.word[ids] << (64 - size - (at & 31)).astype(np.uint64)
        out = np.zeros((total >> 5) + 2, np.uint64)
        if len(ids):
            opens = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            out[place[opens]] += np.add.reduceat(words >> np.uint64(32), opens)
            out[place[opens] + 1] += np.add.reduceat(words & np.uint64(0xFFFFFFFF), opens)
        return out.astype(">u4").tobytes()[: (total + 7) // 8], at[::STRIDE].astype("<u8").tobytes()

    def decode(self, bits: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The n ids, all stretches in step."""
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        raw = np.frombuffer(bits + bytes(8), np.uint8)
        four = np.lib.stride_tricks.as_strided(raw[:4].view(">u4"), (len(raw) - 3,), (1,), writeable=False)
        out = np.zeros((len(at), STRIDE), np.uint32)
        shift, mask, tail = 32 - self.limit, np.int64((1 << self.limit) - 1), n - STRIDE * (len(at) - 1) if len(at) else 0
        for k in range(min(STRIDE, n)):
            live = slice(None) if k < tail else slice(0, -1)
            here = at[live]
            window = (four[here >> 3].astype(np.int64) >> (shift - (here & 7))) & mask
            out[live, k] = self.ids[window]
            at[live] += self.sizes[window]
        return out.ravel()[:n]


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(part, at, id, n, ids): documents in ascending order within and over parts; at counts the ids before them in the part. And the type of its ids."""
    dtype = "<u2" if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = encoder(tokenizer_path, dtype).encode
        end = np.array([end_id], dtype).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, text_col):
                ids = [x + end for x in encode(texts_of(piece, text_col))]
                n = np.array([len(x) for x in ids]) // np.dtype(dtype).itemsize
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), pa.array(starts), column(piece, id_col), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["part", "at", "id", "n", "ids"])

    ordered = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    return written(ordered.mapInArrow(run, f"part int, at long, id {kind}, n long, ids binary"), "tokens", compression="uncompressed"), dtype


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the ids of every text, each closed by ``end_id``, in ascending order of the documents' ids."""
    spark = tuned(docs.sparkSession)
    tokens, dtype = token_table(docs, tokenizer_path, end_id, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype))
            if len(own) > len(total):
                total, own = own, total
            total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    # at most one row for each id of the vocabulary
    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    total = np.zeros(int(ids.max(initial=end_id)) + 1, np.int64)
    total[ids] = n
    length = code_lengths(total, max(limit, int(np.ceil(np.log2(max(2, len(ids)))))))
    used = np.flatnonzero(length)
    code_rows = spark.createDataFrame(pa.table({"id": pa.array(used, pa.int64()), "length": pa.array(length[used], pa.int32())}))
    code_rows.coalesce(1).write.parquet(f"{path}/code")
    # one number for each part, so for each task that wrote one
    sums = {r.part: r.n for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, seen = {}, 0
    for part in sorted(sums):
        before[part] = seen
        seen += sums[part]

    def into_blocks(batches):
        code = Code(length)
        held, following = [], None

        def close():
            ids = np.frombuffer(b"".join(x for r in held for x in r[3]), dtype)
            bits, checkpoints = code.encode(ids)
            starts = np.cumsum([0] + [k for r in held for k in r[2]])[:-1]
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pa.concat_arrays([r[1] for r in held]).to_pylist()], pa.list_(held[0][1].type)), pa.array([starts.tolist()], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([checkpoints], pa.binary())], names=["first", "n_tokens", "documents", "starts", "bits", "checkpoints"])

        size = 0
        for batch in batches:
            parts, at, n = (np.asarray(column(batch, c)) for c in ("part", "at", "n"))
            first = np.array([before[p] for p in parts.tolist()], np.int64) + at
            own = column(batch, "ids").to_pylist()
            i = 0
            while i < len(own):
                if held and (first[i] != following or size >= block_tokens):
                    yield close()
                    held, size = [], 0
                j = i + 1
                total_ = size + int(n[i])
                while j < len(own) and total_ < block_tokens and first[j] == first[j - 1] + n[j - 1]:
                    total_ += int(n[j])
                    j += 1
                held.append((int(first[i]), column(batch, "id").slice(i, j - i), n[i:j].tolist(), own[i:j]))
                following, size, i = int(first[j - 1] + n[j - 1]), total_, j
        if held:
            yield close()

    schema = f"first long, n_tokens long, documents array<{kind}>, starts array<long>, bits binary, checkpoints binary"
    blocks = tokens.mapInArrow(into_blocks, schema)
    # files of near equal spans of the corpus, each in order
    files = max(1, len(sums))
    span = max(1, -(-seen // files))
    blocks = blocks.repartitionById(files, F.least(F.floor(F.col("first") / span), F.lit(files - 1)).cast("int")).sortWithinPartitions("first")
    write_once(blocks, f"{path}/blocks", compression="uncompressed")
    forget(tokens)


def read_tokens(spark, path: str, ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, and where asked for ids as little-endian unsigned 32-bit integers) of each document."""
    code_rows = spark.read.parquet(f"{path}/code").toArrow()  # at most one row for each id of the vocabulary
    length = np.zeros(int(code_rows["id"].to_numpy().max(initial=0)) + 1, np.uint8)
    length[code_rows["id"].to_numpy()] = code_rows["length"].to_numpy()
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["documents"].dataType.elementType.simpleString()

    def run(batches):
        code = Code(length)
        for batch in batches:
            for i in range(batch.num_rows):
                first, n, bits, checkpoints = (column(batch, c)[i].as_py() for c in ("first", "n_tokens", "bits", "checkpoints"))
                raw = memoryview(code.decode(bits, checkpoints, n).astype("<u4").tobytes())
                starts = np.asarray(column(batch, "starts")[i].values).astype(np.int64)
                ends = np.concatenate([starts[1:], [n]])
                own = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                arrays = [column(batch, "documents")[i].values, pa.array(first + starts), pa.array(ends - starts), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array([bytes(x) for x in own], pa.binary())] * ids, names=["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return blocks.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, closed by id 2, written and read back."""
    import public_tokenizers

    path = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_tokens(spark, path, ids=False).withColumnRenamed("id", "doc_id")
