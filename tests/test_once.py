"""Steps that were made several times for one row, page or plan are made once."""

import random

import pytest
from pyspark.sql import functions as F

from pagetables.functions.fixed_values import SENSITIVE_PATTERNS
from pagetables.operators import geometry, grid, privacy
from pagetables.plans import documents, tables
from workloads import fixtures as X

WORD = "doc_id long, page int, word_no int, x0 double, x1 double, top double, bottom double, text string"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def word(doc, no, x0, x1, top, bottom, text):
    return (doc, 1, no, x0, x1, top, bottom, text)


@pytest.fixture
def counted(monkeypatch):
    calls, make = [], geometry.cluster_rows
    monkeypatch.setattr(geometry, "cluster_rows", lambda words: calls.append(1) or make(words))
    return calls


def printed(spark):
    rows = [["Date", "Text", "Balance"], ["01/02/2024", "rent", "1.00"], ["02/02/2024", "food", "2.00"]]
    words = [word(1, 10 * i + j, 100.0 * j, 100.0 * j + 40, 20.0 * i, 20.0 * i + 8, t) for i, r in enumerate(rows) for j, t in enumerate(r)]
    return spark.createDataFrame(words, WORD).withColumn("conf", F.lit(90.0))


def test_tables_make_lines_once(spark, counted):
    got = tables.words_to_tables(printed(spark)).collect()
    assert len(got) == 3 and len(counted) == 1


def test_documents_make_lines_once(spark, counted):
    report, _, _ = documents.convert_documents(printed(spark))
    assert [(r.doc_id, r.n_rows) for r in report.collect()] == [(1, 3)] and len(counted) == 1


def test_height_of_a_page_is_found_once(spark):
    rng = random.Random(5)
    words = [word(d, i, 10.0 * i, 10.0 * i + 5, float(t), t + h, "w") for d in range(12) for i, (t, h) in enumerate(
        (rng.randrange(60), rng.choice([4.0, 6.0, 8.0, 11.0])) for _ in range(d + 1))]
    words.append(word(99, 1, 0.0, 1.0, None, 3.0, "no height"))
    got = geometry.cluster_rows_tol(spark.createDataFrame(words, WORD))
    assert "collect_list" not in optimized(got)
    lines = {(r.doc_id, r.word_no): r.line_no for r in got.collect()}
    assert lines[99, 1] == 1
    for d in range(12):
        page = sorted((w for w in words if w[0] == d), key=lambda w: ((w[5] + w[6]) / 2, w[3], w[2]))
        heights = sorted(w[6] - w[5] for w in page)
        line, before = 0, None
        for w in page:
            middle = (w[5] + w[6]) / 2
            line += before is None or middle - before > heights[len(heights) // 2] * 0.6
            before = middle
            assert lines[d, w[2]] == line


def test_words_outside_rules_go_by_comparisons(spark):
    rules = spark.createDataFrame([(d, 1, o, x) for d, n in ((1, 3), (2, 1)) for o in "vh" for x in [10.0, 20.0, 30.0][:n]], "doc_id long, page int, orient string, pos double")
    at = [5.0, 10.0, 15.0, 20.0, 29.0, 30.0, 40.0]
    words = [word(d, 10 * i + j, x - 1, x + 1, y - 1, y + 1, f"{x}") for d in (1, 2, 3) for i, y in enumerate(at) for j, x in enumerate(at)]
    got = geometry.lattice_cells(spark.createDataFrame(words, WORD), rules)
    assert not any("lambda" in line for line in optimized(got).splitlines() if "Filter" in line)
    inside = {(r.row_no, r.col_no): r.text for r in got.where("doc_id = 1").collect()}
    assert inside == {(i, j): t for i in (0, 1) for j, t in enumerate(["10.0 15.0 10.0 15.0", "20.0 29.0 20.0 29.0"])}
    assert got.where("doc_id <> 1").count() == 0


def test_cells_are_typed_once_for_a_score(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1, ["a", "1\n234.00", "", None]), (1, 1, 2, ["01/02/2024", " 5.00 ", "1.00 2.00", "x"]), (1, 1, 3, ["02/02/2024", "(7.00)", None, ""])],
        "doc_id long, page int, row_no int, cells array<string>")
    got = grid.score_grid(rows)
    assert not any("RLIKE" in line for line in optimized(got).splitlines() if "Aggregate" in line)
    # the amount broken over two lines is one to its column, but the first row has no amount
    r = got.first()
    assert (r.n_rows, r.n_data, r.n_cols, r.n_filled, r.n_jammed, r.n_coherent) == (3, 2, 4, 8, 1, 2)


def test_a_text_is_searched_once_for_a_pattern(spark):
    text = "\x01ABCDE1234F\x01 a@b.co \x02din: 12345678\x01 ABCDE1234F"
    pages = spark.createDataFrame([(1, text), (2, None), (3, "\x01 none 1234 \x01"), (4, "")], "doc_id long, text string")
    got = privacy.scan_sensitive(pages)
    plan = optimized(got)
    assert plan.count("regexp_replace(") == len(SENSITIVE_PATTERNS) and "regexp_extract_all" not in plan
    found = sorted((r.type, r.value, r.start, r.end) for r in got.collect())
    assert found == [("DIN", "din: 12345678", 21, 34), ("Email", "a@b.co", 13, 19), ("PAN", "ABCDE1234F", 1, 11), ("PAN", "ABCDE1234F", 36, 46)]
    masked = {r.doc_id: r.text for r in privacy.redact(pages).collect()}
    assert masked == {1: "\x01[PAN]\x01 [Email] \x02[DIN]\x01 [PAN]", 2: None, 3: "\x01 none 1234 \x01", 4: ""}


def test_customers_are_dealt_to_tasks(spark, sf_dir):
    ids = X.scanned_texts(spark, sf_dir).where("doc_id < 1000000000").select(F.spark_partition_id().alias("p"), "text")
    assert len({r.p for r in ids.collect()}) > 1


def test_words_of_a_line_are_sorted_without_an_expression(spark):
    lines = geometry.to_lines(geometry.cluster_rows(spark.createDataFrame(
        [word(1, 2, 30.0, 40.0, 0.0, 8.0, "b"), word(1, 1, 10.0, 20.0, 0.0, 8.0, "a"), word(1, 3, None, 60.0, 0.0, 8.0, "c")], WORD)))
    assert "array_sort" not in optimized(lines)
    assert [[w.text for w in r.words] for r in lines.collect()] == [["c", "a", "b"]]
