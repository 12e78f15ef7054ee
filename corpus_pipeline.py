"""From raw documents to packed training sequences, in five stages; each one's rows are stored and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from pagetables.llm.queries import TOKENIZER
from pagetables.llm.rows import modest_batches, table
from pagetables.session import stored

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80  # of the stage on word shingles; op10's own contract is 4 and 85


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones outside its held-out part."""
    modest_batches(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat or nearly repeat an earlier one.

    n_chars follows the text. A document that loses lines and has nothing but blanks left goes.
    """
    modest_batches(spark)
    found = line_dedup.dedup_lines(docs)
    left = found.where("n_removed = 0 OR text RLIKE '[^ \\t\\r\\n]'")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of similar ones: 0.8 or more over runs of five words."""
    modest_batches(spark)
    return jaccard_join.keep_one(docs, k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    modest_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    modest_batches(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]
# Tokens, trees and sketches have no SQL; tests/llm compares the stages with plain versions of their rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
