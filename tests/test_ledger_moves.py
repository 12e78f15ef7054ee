"""What moves, sorts or is made twice between printed lines and ledger rows, and that the rows stay the same."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pagetables.functions import cells as C, fixed_values as V, scans
from pagetables.functions.scans import ordered_scan
from pagetables.operators import ledger as L
from pagetables.plans import statements
from workloads import fixtures as X

LINES = "doc_id long, page int, line_no int, y double, cells array<string>"
HEAD = ["Date", "Narration", "Debit", "Credit", "Balance"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def printed(spark):
    rows = []
    for doc in (1, 2, 3):
        rows.append((doc, 1, 1, 10.0, HEAD))
        if doc != 2:
            rows.append((doc, 1, 2, 20.0, ["", "Opening balance", "", "", f"{doc}00.00"]))
        rows += [(doc, p, n, 30.0 * n, [f"0{n}/0{p}/2024", f"t{p}{n}", "1.00", "", f"{doc}.00"] if n % 2 else ["", "more", "", "", ""])
                 for p in (1, 2) for n in range(3, 9)]
    return spark.createDataFrame(rows, LINES)


def named(lines):
    header = L.find_header(lines)
    mapping = L.repair_mapping(header, L.column_kinds(L.body_lines(L.marked_cells(lines), header)))
    return L.named_cells(L.split_lines(lines, header), mapping)


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_with_anchors_are_folded_where_they_lie(spark, no_broadcast):
    anchored = L.nearest_anchor(named(printed(spark)))
    assert plan_of(L.fold_transactions(anchored)).count("Exchange hash") == plan_of(anchored).count("Exchange hash") + 1
    # lines that come without their places fold to the same rows
    columns = [c for c in anchored.columns if not c.startswith("_")]

    def rows(df):
        return sorted((r.doc_id, r.page, r.line_no, str(r.date), r.particulars, r.debit, r.balance, r.n_lines) for r in df.collect())

    got = rows(L.fold_transactions(anchored))
    assert len(got) == 18 and got == rows(L.fold_transactions(anchored.select(*columns)))
    assert got[0] == (1, 1, 3, "2024-01-03", "t13 more", Decimal(1), Decimal(1), 2)


def test_kinds_of_columns_move_marks_not_texts(spark, no_broadcast):
    lines = printed(spark)
    header = L.find_header(lines)
    marked = L.body_lines(L.marked_cells(lines), header)
    assert "cells" not in marked.columns
    kinds = [sorted(map(tuple, L.column_kinds(part).collect())) for part in (marked, L.body_lines(lines, header))]
    assert kinds[0] == kinds[1]
    assert [k[5] for k in kinds[0][:5]] == ["date", "text", "amount", "empty", "amount"]


def test_marks_agree_with_the_typing_of_cells(spark):
    texts = ["", " ", None, "12/03/2024", " 1-2-24 ", "5 May 2024", "31/02/2024", "1,234.50", "(5.00) Cr", "Rs. 7", "- 3", "12.", "x", "12 INR 2024", "2024-01-02"]
    lines = spark.createDataFrame([(1, 1, 1, 0.0, texts)], LINES)
    marks = L.marked_cells(lines).collect()[0].marks
    told = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", C.strip("t") != "", C.is_date("t"), C.is_number("t")).orderBy("i").collect()
    assert [(m & 1 > 0, m & 2 > 0, m & 4 > 0) for m in marks] == [tuple(r)[1:] for r in told]


def test_only_header_lines_are_aggregated_as_structs(spark):
    plan = plan_of(L.find_header(printed(spark)))
    assert not any("SortAggregate" in line and "size(cells" in line for line in plan.splitlines())
    null_key = spark.createDataFrame([(None, 1, 2, 0.0, HEAD), (None, 1, 1, 0.0, ["x"] * 6), (5, 1, 1, 0.0, ["y"])], LINES)
    got = L.find_header(null_key).collect()
    assert [(r.doc_id, r.header_page, r.header_line, r.n_cols, r.names) for r in got] == [(None, 1, 2, 6, ["date", "particulars", "debit", "credit", "balance"])]


def test_words_in_front_of_line_patterns_cover_them(spark):
    texts = ["Closing Balance", "balance c/f", "BALANCE CF", "carried  forward", "Total 5", "GRAND TOTAL", "Statement Summary", "Page 2 of 3", "page 2/3",
             "Computer Generated", "transaction total", "Legends", "legend", "End of Statement", "Opening  balance", "Balance b/f", "BROUGHT FORWARD", "subtotal", "plain"]
    for text in texts:
        for pattern, words in ((V.OPENING_LINE, V.OPENING_WORDS), (V.SKIP_LINE, V.SKIP_WORDS)):
            assert not re.search(pattern, text) or any(w in text.lower() for w in words)
    lines = spark.createDataFrame([(1, 1, 1, 0.0, HEAD)] + [(1, 1, i, 0.0, [t]) for i, t in enumerate(texts, 2)], LINES)
    roles = [r.role for r in L.split_lines(lines, L.find_header(lines)).orderBy("line_no").collect()]
    assert roles == ["header", *["skip"] * 14, *["opening"] * 3, "work", "work"]


def test_lines_are_made_where_ledger_rows_were_dealt(spark, sf_dir):
    plan = plan_of(X.statement_lines.__wrapped__(spark, sf_dir)).splitlines()
    made = [i for i, line in enumerate(plan) if "ObjectHashAggregate" in line]
    assert len(made) >= 2 and not any("Exchange" in line for line in plan[made[0]: made[1]])


def test_scans_sort_by_values_first(spark, no_broadcast):
    df = spark.createDataFrame([(None, 1, 5), (7, 1, 6), (7, 2, None)], "k int, pos int, v int")
    got = ordered_scan(df, ["k"], F.lit(0), ["pos"], before={"b": "v"})
    assert sorted(map(tuple, got.collect()), key=str) == [(7, 1, 6, None), (7, 2, None, 6), (None, 1, 5, None)]
    assert re.search(r"Sort \[_k0#\d+ ASC", plan_of(got))


def test_openings_travel_with_the_scan(spark, monkeypatch):
    labels, keep = [], scans.stored

    def recorded(df, label="stage"):
        labels.append(label)
        return keep(df, label)

    lines = keep(named(printed(spark)))
    for module in (scans, statements):
        monkeypatch.setattr(module, "stored", recorded)
    rows = statements.ledger_of(lines).collect()
    assert labels == ["folded"]
    assert len(rows) == 18
    assert {(r.doc_id, r.opening) for r in rows} == {(1, Decimal(100)), (2, None), (3, Decimal(300))}
    firsts = {r.doc_id: (r.previous, r.verdict) for r in rows if r.seq == 1}
    assert firsts == {1: (Decimal(100), "bad"), 2: (None, "unchecked"), 3: (Decimal(300), "bad")}


def test_facts_of_a_key_reach_all_its_rows(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 2)
    df = spark.createDataFrame([(k, pos, pos) for k in (None, 1, 2) for pos in range(20)], "k int, pos int, v int")
    facts = spark.createDataFrame([(None, "none"), (1, "one")], "k int, told string")
    got = scans.ordered_scan(df, ["k"], F.floor(F.col("pos") / 3), ["pos"], number="n", facts=facts)
    assert got.columns == ["k", "pos", "v", "told", "n"]
    assert {(r.k, r.told) for r in got.collect()} == {(None, "none"), (1, "one"), (2, None)} and got.count() == 60
