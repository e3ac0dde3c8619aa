"""Token counts: totals by source, language and tokenizer version, kept up by signed deltas.

A rollup is a folder. A batch of changes is combined to one row a key, written to ``attempts/``, and committed by one
rename to ``batches/<name>`` that fails if that name is there. So a batch counts once however often it is sent and
whoever else sends it; its name is its identity, and what is sent again under a name is ignored, whatever its rows.
(The rename must not overwrite, which HDFS and local file systems grant; a store without such renames needs a lock.)

Totals are the sum of committed batches. ``compact`` folds them into ``base/<n>``, with a table of the names that it
holds; totals read the last base and the batches that it lacks. Nothing is deleted by that, so that a frame of totals
taken earlier can still be read; ``vacuum`` deletes what is replaced or was given up, once it is old enough.

Changes have columns op (insert, delete or revise), source, lang, tokenizer, n_tokens and old_tokens (of revise).
A null key is a key of its own; null counts are 0; other columns are ignored. A revision whose key changes is a delete
and an insert. An empty batch commits and changes nothing. Repeated rows count as often as they stand. Null and empty
texts have no tokens, and count as documents.
"""

from __future__ import annotations

import re
import time
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import add_columns, texts_of
from ._shared import forget, scratch, table, tuned, write_once, written

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(rows: DataFrame) -> DataFrame:
    """A row a key: documents and tokens to add."""
    op, n, old = F.col("op"), F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
    bad = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))).cast("long")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(bad)
    tokens = F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - old)
    return rows.select(*KEYS, docs.alias("n_docs"), tokens.alias("n_tokens")).groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))


class Rollup:
    """The totals in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = tuned(spark), path.rstrip("/")
        context = spark.sparkContext
        self._fs, conf = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
        self._system = self._path("").getFileSystem(conf)
        self._files = self._fs.FileContext.getFileContext(self._path("").toUri(), conf)
        self._no_options = context._gateway.new_array(self._fs.Options.Rename, 0)
        for kind in ("attempts", "batches", "base"):
            self._system.mkdirs(self._path(kind))

    def _path(self, name: str):
        return self._fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, kind: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._path(kind)))

    def _settle(self, attempt: str, name: str) -> bool:
        """Gives a written attempt its name; False, and the attempt is deleted, if another has it."""
        try:
            self._files.rename(self._path(attempt), self._path(name), self._no_options)
            return True
        except Py4JJavaError:
            if not self._system.exists(self._path(name)):
                raise
            self._system.delete(self._path(attempt), True)
            return False

    def _base(self) -> str | None:
        names = self._names("base")
        return f"{self.path}/base/{names[-1]}" if names else None

    def _held(self, names: list[str], base: str | None) -> set[str]:
        """Which of some names of batches a base holds."""
        if not base or not names:
            return set()
        asked = self.spark.createDataFrame([(n,) for n in names], "batch string")
        return {r[0] for r in self.spark.read.schema("batch string").parquet(f"{base}/batches").join(asked, "batch", "left_semi").collect()}

    def _loose(self, base: str | None) -> list[str]:
        """Committed batches that a base lacks."""
        names = self._names("batches")
        held = self._held(names, base)
        return [n for n in names if n not in held]

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Applies a batch; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"a batch can't be named {batch!r}")
        if self._system.exists(self._path(f"batches/{batch}")) or self._held([batch], self._base()):
            return False
        attempt = f"attempts/{batch}-{uuid.uuid4().hex}"
        write_once(signed(rows), f"{self.path}/{attempt}")
        return self._settle(attempt, f"batches/{batch}")

    def batches(self) -> DataFrame:
        """(batch): names of committed batches."""
        base = self._base()
        loose = self.spark.createDataFrame([(n,) for n in self._loose(base)], "batch string")
        return loose.unionByName(self.spark.read.schema("batch string").parquet(f"{base}/batches")) if base else loose

    def _rows(self, base: str | None, loose: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{b}" for b in loose] + [f"{base}/totals"] * bool(base)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 OR n_tokens != 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of keys that have documents or tokens, as of now."""
        base = self._base()
        return self._rows(base, self._loose(base))

    def compact(self) -> bool:
        """Folds all committed batches into a new base; False if another compaction was first."""
        old, base = self._names("base"), self._base()
        loose = self._loose(base)
        attempt = f"attempts/base-{uuid.uuid4().hex}"
        write_once(self._rows(base, loose), f"{self.path}/{attempt}/totals")
        names = self.spark.createDataFrame([(n,) for n in loose], "batch string")
        if base:
            names = names.unionByName(self.spark.read.schema("batch string").parquet(f"{base}/batches"))
        write_once(names, f"{self.path}/{attempt}/batches")
        return self._settle(attempt, f"base/{int(old[-1]) + 1 if old else 0:012d}")

    def vacuum(self, older_than: float = 86_400) -> int:
        """Deletes what is ``older_than`` seconds old of: bases but the last, batches that it holds, attempts. Their number."""
        last, until = self._base(), (time.time() - older_than) * 1000
        names = self._names("batches")
        gone = [f"base/{n}" for n in self._names("base")[:-1]] + [f"batches/{n}" for n in sorted(self._held(names, last))] + [f"attempts/{n}" for n in self._names("attempts")]
        gone = [n for n in gone if self._system.getFileStatus(self._path(n)).getModificationTime() <= until]
        for n in gone:
            self._system.delete(self._path(n), True)
        return len(gone)


#: A word of nothing but symbols, which a revised text lacks.
BARE_SYMBOLS = re.compile(r"(?<![^\x20\x09-\x0D])[#*$%&|<>!]+(?![^\x20\x09-\x0D])")


def revised_text(text: str) -> str:
    return BARE_SYMBOLS.sub("", text)


def token_counts(docs: DataFrame, byte_vocabulary: str, word_tokenizer: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_byte and n_word, its tokens by either vocabulary, and n_byte_revised, those of its
    revised text by the first. Texts are read once and go nowhere."""
    from .bpe import ids_of
    from .tokens import encoder

    def make():
        words = encoder(word_tokenizer, "<u4").encode

        def run(part: pa.RecordBatch) -> list:
            texts = texts_of(part, text_col)
            n_byte = [len(ids_of(byte_vocabulary, t)) for t in texts]
            again = [n if (new := revised_text(t)) == t else len(ids_of(byte_vocabulary, new)) for t, n in zip(texts, n_byte, strict=True)]
            return [pa.array(n_byte, pa.int64()), pa.array([len(x) // 4 for x in words(texts)], pa.int64()), pa.array(again, pa.int64())]

        return run

    return add_columns(docs, text_col, "n_byte long, n_word long, n_byte_revised long", make, (text_col,))


def changes(rows: DataFrame, op: str, tokenizer: str, count: str, old: str | None = None) -> DataFrame:
    """A batch of one kind from a table of counts."""
    before = F.col(old) if old else F.lit(None).cast("long")
    return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(count).alias("n_tokens"), before.alias("old_tokens"))


BYTE_VERSION, WORD_VERSION = "byte-bpe-50k", "word-bpe-49k"


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` under two tokenizers; toxic ones deleted, others revised where their text changes; batches sent twice count once."""
    import public_tokenizers as vocabularies

    rollup = Rollup(spark, scratch(spark, "token-counts"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    # texts are counted once and left behind; what is joined are a few numbers a document
    counted = written(token_counts(docs, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.path("word_bpe_49k.json")), "counted")
    labels = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    toxic, others = counted.join(labels, "doc_id", "left_semi"), counted.where("n_byte != n_byte_revised").join(labels, "doc_id", "left_anti")
    first, second = changes(counted, "insert", BYTE_VERSION, "n_byte"), changes(counted, "insert", WORD_VERSION, "n_word")
    deletes = changes(toxic, "delete", BYTE_VERSION, "n_byte").unionByName(changes(toxic, "delete", WORD_VERSION, "n_word"))
    revised = changes(others, "revise", BYTE_VERSION, "n_byte_revised", "n_byte")
    for name, rows in (("byte", first), ("word", second), ("toxic", deletes), ("byte", first), ("symbols", revised), ("toxic", deletes)):
        rollup.commit(name, rows)
    forget(counted)
    return rollup.totals()
