"""Whole documents: statements from lines or tables, generic tables, dated records, and the report."""

from pyspark.sql import functions as F

from pagetables.plans import documents as D
from pagetables.plans import tables as T
from pagetables.plans.statements import words_to_ledger
from tests.test_tables import HEAD, RULES, WORDS, printed, shown
from workloads import fixtures as X

TITLES = ["Date", "Particulars", "Debit", "Credit", "Balance"]


def statement(first, n, opening):
    """Rows of a statement that takes 10 and gives 5 in turn."""
    rows = []
    for i in range(first, first + n):
        out = i % 2 == 1
        opening += -10.0 if out else 5.0
        rows.append([f"{i % 28 + 1:02d}/03/2024", f"pay{i}", "10.00" if out else "", "" if out else "5.00", f"{opening:.2f}"])
    return rows


def test_statements_tables_and_reports(spark):
    """One statement, one whose pages have columns of their own, one table without balances, one page without a table."""
    place = [20.0, 100.0, 200.0, 280.0, 360.0]
    other = [60.0, 160.0, 300.0, 380.0, 460.0]
    first, second = statement(1, 12, 1000.0), statement(13, 12, 970.0)
    words = printed(1, 1, place, [TITLES, *first])
    words += printed(2, 1, place, [TITLES, *first]) + printed(2, 2, other, second)
    table = [[f"Ledger{i}", f"{i}.00", f"{2 * i}.50"] for i in range(300, 312)]
    words += printed(3, 1, [20.0, 120.0, 200.0], [HEAD, *table]) + printed(4, 1, [50.0], [["alone"]])
    report, ledgers, tables = D.convert_documents(spark.createDataFrame(words, WORDS))
    by_doc = {r.doc_id: r for r in report.collect()}
    assert sorted(by_doc) == [1, 2, 3, 4]
    assert [by_doc[d].mode for d in (1, 2, 3)] == ["statement", "statement", "table"]
    assert by_doc[1].layout.startswith("lines-") and (by_doc[1].n_rows, by_doc[1].n_bad, by_doc[1].n_missing) == (12, 0, 0)
    assert (by_doc[2].n_rows, by_doc[2].n_bad, by_doc[2].n_missing) == (24, 0, 0), by_doc[2]
    assert float(by_doc[2].closing) == 940.0 and float(by_doc[2].total_debits) == 120.0 and by_doc[2].continuity == 100.0
    assert by_doc[3].n_rows == 13 and by_doc[3].layout and by_doc[3].opening is None and by_doc[3].n_pages == 1
    got = ledgers.where("doc_id = 2").orderBy("page", "line_no").collect()
    assert [(r.particulars, float(r.balance)) for r in got] == [(r[1], float(r[4])) for r in first + second]
    assert [c for _, c in shown(tables.where("doc_id = 3"))] == [HEAD, *table]
    assert not ledgers.where("doc_id > 2").head(1) and not tables.where("doc_id < 3").head(1)


def test_no_statement_is_worse_than_by_lines_alone(spark, sf_dir):
    """Of the candidates the former ones are a part, so continuity can only rise; each chosen ledger is whole."""
    words = X.words(spark, sf_dir).where("doc_id % 25 = 1")
    best, _ = words_to_ledger(words)
    before = {r.doc_id: (r.strict, r.confidence, r.n_rows) for r in best.collect()}
    report, ledgers, tables = D.convert_documents(words)
    after = {r.doc_id: r for r in report.collect()}
    sizes = {r.doc_id: r["count"] for r in ledgers.groupBy("doc_id").count().collect()}
    assert before and set(before) <= set(after)
    for d, (strict, _, n) in before.items():
        r = after[d]
        assert r.mode == "statement" and r.n_rows == sizes[d]
        assert 100.0 * (1 - (r.n_bad + r.n_missing) / r.n_rows) >= strict - 0.1 - 100.0 / r.n_rows  # an unchecked row is no ok one
        assert r.layout in D.STATEMENT_TAGS


def test_records_by_date(spark):
    """Lines under a date join it, text behind the date gets a cell, titles are prose; a ruled document goes by its rules."""
    place = [20.0, 150.0, 260.0, 340.0]
    rows = []
    for i in range(1, 9):
        rows += [[f"{i:02d}/03/2024 UPI{i}", f"to{i}", f"{i}.00", f"{100 - i}.00"], ["", f"note{i}", "", ""]]
    words = printed(1, 1, place, [["Statement", "", "", ""], *rows])
    words += printed(3, 1, place, [["no", "date", "", "here"], ["x", "y", "", ""]])
    ruled = [["aa", "b"], ["cc", "d"], ["ee", "f"], ["gg", "h"], ["ii", "j"]]
    words += printed(2, 1, [50.0, 82.0], ruled)
    lines = [(2, 1, "v", x) for x in (45.0, 80.0, 109.0, 140.0, 160.0)] + [(2, 1, "h", 95.0 + 15.0 * i) for i in range(6)]
    got = T.record_tables(spark.createDataFrame(words, WORDS), spark.createDataFrame(lines, RULES))
    one = [c for _, c in shown(got.where("doc_id = 1"))]
    assert one[0] == ["Statement"]
    # the last line lies behind the last date
    assert one[1:-1] == [
        [f"{i:02d}/03/2024", f"UPI{i}", f"to{i} note{i}" if i < 8 else f"to{i}", f"{i}.00", f"{100 - i}.00"] for i in range(1, 9)]
    assert one[-1] == ["note8"]
    assert [c for _, c in shown(got.where("doc_id = 2"))] == ruled
    assert [c for _, c in shown(got.where("doc_id = 3"))] == [["no date here"], ["x y"]]


def test_nothing(spark):
    empty = spark.createDataFrame([], WORDS)
    assert T.record_tables(empty, spark.createDataFrame([], RULES)).count() == 0
    report, ledgers, tables = D.convert_documents(empty)
    assert (report.count(), ledgers.count(), tables.count()) == (0, 0, 0)
    assert report.select(F.col("engines"), F.col("warnings")).schema.simpleString() == "struct<engines:array<string>,warnings:array<string>>"
