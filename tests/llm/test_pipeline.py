"""The stages one after another at the smallest scale, and the registered queries."""

import corpus_pipeline
from pagetables.llm import jaccard_join
from pagetables.llm.queries import QUERIES


def test_stages_keep_columns_and_only_drop_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        n = after.count()
        assert 0 < n <= before
        docs, before = after, n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_join_stage_links_pairs_between_its_limit_and_that_of_op10(spark, sf_dir):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, *(f"x{i}" for i in range(85))])), (3, " ".join([*words, *(f"y{i}" for i in range(110))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    # 396 of 481 runs are 0.82, 396 of 506 are 0.78
    assert sorted(r["doc_id"] for r in stage(spark, docs, sf_dir).collect()) == [1, 3]
    assert jaccard_join.keep_one(docs).count() == 3


def test_queries_give_a_row_per_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op3_token_store", "op4_pii", "op5_quality", "op6_fingerprints", "op8_kneser_ney", "op9_secrets", "op10_jaccard_join"):
        assert QUERIES[name](spark, sf_dir).count() == n, name
