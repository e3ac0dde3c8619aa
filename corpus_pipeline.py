"""A cleaning pipeline over ``documents``: quality rules, near copies, repeated passages, benchmark text, token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``; other columns are left out. Empty tables give empty results. Every
row is a document of its own: rows may share an id, or have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm import bpe, decontaminate, jaccard, quality, substrings
from bytelode.llm._shared import forget, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted on ``labels``.

    Null and empty texts have no words and go, as does whatever has fewer than ten. Repeated rows fare alike. Without
    labels, or with those of one class only, the base rules decide alone.
    """
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, trees).where("kept").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document: that of the smallest id, of equal ids that of the smallest digest.

    Rows equal in id and text are copies, and one of them stays. Rows without id and texts without words are in no class
    and stay.
    """
    key = ["doc_id", "digest"]
    classes = written(jaccard.similarity_classes(docs), "near-copy-classes")
    first = (F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("class_digest"))
    own = docs.select(COLUMNS).withColumn("digest", F.xxhash64("text"))
    stay = own.join(classes.where("doc_id IS NOT NULL").where(~first).select(key).distinct(), key, "left_anti")
    repeated = written(classes.where("doc_id IS NOT NULL AND n_copies > 1").where(first).groupBy(key).count().where("count > 1").select(key), "repeated-rows")
    if not repeated.isEmpty():
        stay = stay.join(repeated, key, "left_anti").unionByName(stay.join(repeated, key, "left_semi").dropDuplicates(key))
    return stay.select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier; a document that loses nothing keeps its text as it is.

    Null and short texts lose nothing. A document whose words all go stays, with an empty text. Rows equal in id and text
    fare alike.
    """
    done = substrings.remove_later_copies(docs)
    text = F.when(F.size("removed_spans") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return done.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have none and stay; repeated rows fare alike."""
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("hit_spans") == 0).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts. Null and empty texts have no ids; every row gets a row."""
    return bpe.digests(docs.select("doc_id", "text"))


STAGES = [("quality rules", quality_rules), ("near copies", near_copies), ("repeated passages", repeated_passages), ("benchmark passages", benchmark_passages), ("token ids", token_ids)]
#: SQL can express neither the trees nor the tokens; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
