"""The registered queries opN_<name>: each applies its operator, with its production parameters, to the whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagetables.llm import decontaminate, fingerprint, jaccard_join, line_dedup, ngram_lm, packing, pii, quality, secrets, spelling, token_store, toxicity, whitening
from pagetables.llm.rows import held_out, modest_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        modest_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated and nearly repeated lines removed."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the files written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.read_store(token_store.write_store(docs, TOKENIZER))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal data in every document."""
    return pii.span_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document and its edited text, compared with each other and with the next document's."""
    return fingerprint.edited_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


@query
def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of the training part."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_lm.scores(docs, ngram_lm.train(docs.where(~held_out("doc_id", 7))))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secrets in every document."""
    return secrets.span_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its commoner spelling, if one is a single edit away."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first principal components, scaled to variance one."""
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
