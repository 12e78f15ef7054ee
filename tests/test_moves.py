"""What moves, sorts or is made twice in steps that large tables share."""

import pytest
from pyspark.sql import functions as F

from pagetables.functions import scans
from pagetables.operators import geometry, grid
from pagetables.sources import sinks
from workloads import fixtures as X

ROWS = "doc_id long, page int, row_no int, cells array<string>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_large_side_of_a_spread_is_not_sorted(spark, no_broadcast):
    df = spark.range(200).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("page"), F.lit("x").alias("wide"))
    facts = spark.createDataFrame([(d, 10 * d) for d in range(5)] + [(3, 31), (None, 0)], "doc_id long, x long")
    for how, n in (("inner", sum(2 if i % 7 == 3 else 1 for i in range(200) if i % 7 < 5)), ("left", 200 + sum(i % 7 == 3 for i in range(200)))):
        got = scans.spread_by_page(df, facts, how)
        lines = plan_of(got).splitlines()
        assert any("ShuffledHashJoin" in line for line in lines)
        # nothing that carries the wide column is sorted
        assert not any("Sort [" in a and "wide#" in "".join(lines[i + 1: i + 4]) for i, a in enumerate(lines))
        assert got.count() == n


def test_cells_are_made_once_for_geometries_that_agree(spark):
    words = [[(0.0, 4.0, "a"), (9.0, 14.0, "b"), (40.0, 44.0, "c")], [(0.0, 4.0, "d"), (14.0, 18.0, "e")], [(20.0, 24.0, "f")]]
    lines = spark.createDataFrame(
        [(1, 1, i, 0.0, 8.0, [(x0, 0.0, k, x1, t) for k, (x0, x1, t) in enumerate(ws)]) for i, ws in enumerate(words, 1)],
        "doc_id long, page int, line_no int, top double, bottom double, words array<struct<x0: double, top: double, word_no: int, x1: double, text: string>>")
    tags = [(g, s, seps) for g, seps in ((4.0, [8.0, 30.0]), (7.0, [8.0, 30.0]), (11.0, [8.0, 30.0])) for s in (0.08, 0.2)] + [(30.0, 0.08, [])]
    seps = spark.createDataFrame([(1, *t) for t in tags], "doc_id long, min_gap double, share double, seps array<double>")
    got = geometry.assign_columns(lines, seps)
    cells = {(r.line_no, r.min_gap, r.share): list(r.cells) for r in got.collect()}
    assert len(cells) == 3 * len(tags)
    # the gap of ten makes the second line a line of columns up to a gap of seven, and prose beyond
    assert cells[2, 7.0, 0.2] == ["d", "e", ""] and cells[2, 11.0, 0.2] == ["d e", "", ""] and cells[1, 11.0, 0.08] == ["a", "b", "c"]
    assert cells[2, 30.0, 0.08] == ["d e"] and cells[3, 4.0, 0.08] == ["", "f", ""]
    paged = geometry.assign_columns(lines, seps.withColumn("page", F.lit(1)))
    assert {(r.line_no, r.min_gap, r.share): list(r.cells) for r in paged.collect()} == cells
    # cells stand below the last generator, so a line has them made for two kinds at most per list of separators
    assert "explode(tags" in plan_of(got)


def test_header_search_moves_three_rows_of_a_page(spark, no_broadcast):
    head = ["Date", "Text", "Amount"]
    rows = [(1, p, r, head if r == 1 else [f"{r}", "note", f"{p}.00"]) for p in (2, 3, 4) for r in range(1, 30)]
    rows += [(2, 1, 1, ["x"]), (None, 1, 1, ["y", "z"])]
    got = grid.link_pages(spark.createDataFrame(rows, ROWS))
    kept = {(r.doc_id, r.page, r.row_no) for r in got.collect()}
    assert kept == {(d, p, r) for d, p, r, _ in rows if d is not None and (p < 3 or r > 1)}
    seen = []
    keep = scans.stored

    def recorded(df, label="stage"):
        seen.append(plan_of(df))
        return keep(df, label)

    try:
        scans.stored = recorded
        grid.link_pages(spark.createDataFrame(rows, ROWS))
    finally:
        scans.stored = keep
    assert len(seen) == 1 and "WindowGroupLimit" in seen[0]


def test_tables_are_cleaned_once_and_written_where_they_were_numbered(spark, monkeypatch, tmp_path):
    head = ["Date", "Amount"]
    rows = [(d, p, r, head if r == 1 else [f"{d}-{p}-{r}", "1.00"][: 1 + (r + p) % 2]) for d in (1, 2) for p in (1, 2) for r in (1, 2, 3)]
    labels, keep = [], sinks.stored
    monkeypatch.setattr(sinks, "stored", lambda df, label="stage": labels.append(label) or keep(df, label))
    sinks.write_tables(spark.createDataFrame(rows, ROWS), f"{tmp_path}/t", buckets=4)
    assert labels == ["kept"]
    got = sorted((r.doc_id, r.row, r.page, list(r.cells)) for r in spark.read.parquet(f"{tmp_path}/t").collect())
    want = []
    for d in (1, 2):
        kept = [(p, c) for k, p, r, c in rows if k == d and not (p == 2 and r == 1)]
        want += [(d, n, p, c + [""] * (2 - len(c))) for n, (p, c) in enumerate(kept, 1)]
    assert got == want


def test_words_are_numbered_within_the_row_of_their_page(spark, sf_dir):
    plan = plan_of(X.words.__wrapped__(spark, sf_dir))
    assert "Window" not in plan and plan.count("Generate") == 1


def test_selecting_pages_writes_no_texts(spark, sf_dir, monkeypatch):
    from workloads import docset_queries

    monkeypatch.setattr(X, "_STORED", {})
    got = docset_queries.select_pages(spark, sf_dir)
    assert got.count() > 0
    assert not [k for k in X._STORED if k[2].startswith("pages_text")]
    keys = [sorted(map(tuple, t.select("doc_id", "page").collect())) for t in (X.page_numbers(spark, sf_dir), X.pages_text(spark, sf_dir))]
    assert keys[0] == keys[1]
