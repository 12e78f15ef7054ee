"""Statements end to end: printed lines and words must give the ledger back; invariants; literal cases."""

from decimal import Decimal

from pyspark.sql import functions as F

from pagetables.operators import ledger as L
from pagetables.plans.statements import lines_to_ledger, words_to_ledger
from pagetables.session import stored
from workloads import fixtures as X


def as_lines(spark, rows):
    data = [(1, 1, i + 1, y, cells) for i, (y, cells) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, page int, line_no int, y double, cells array<string>")


def test_small_statement(spark):
    lines = as_lines(spark, [
        (10.0, ["My Bank", "", "", "", "", "", ""]),
        (20.0, ["Txn Date", "Narration", "Chq No", "Debit", "Credit", "Balance", "Branch"]),
        (30.0, ["", "Opening Balance", "", "", "", "1,000.00", ""]),
        (40.0, ["01/04/2024", "UPI one", "77", "100.00", "", "900.00", "B1"]),
        (50.0, ["", "more text", "", "", "", "", ""]),
        (58.0, ["", "two above", "", "", "", "", "X"]),
        (60.0, ["02/04/2024 881", "UPI two", "", "", "50.00", "950.01", "B2"]),
        (70.0, ["03/04/2024", "UPI three", "", "10.00", "", "", ""]),
        (80.0, ["04/04/2024", "UPI four", "", "", "5.00", "900.00", ""]),
        (90.0, ["", "Grand total", "", "110.00", "55.00", "", ""]),
    ])
    rows = sorted(lines_to_ledger(lines).collect(), key=lambda r: r.seq)
    assert [r.particulars for r in rows] == ["UPI one more text", "two above UPI two", "UPI three", "UPI four"]
    assert [r.ref for r in rows] == ["77", "881", "", ""]
    assert [r.verdict for r in rows] == ["ok", "ok", "missing", "bad"]
    assert rows[0].opening == Decimal("1000") and rows[1].previous == Decimal("900")
    assert rows[0].extras == {"7:Branch": "B1"} and rows[1].extras == {"7:Branch": "X B2"}
    summary = L.statement_summary(lines_to_ledger(lines), key="doc_id").collect()[0]
    assert (summary.n_rows, summary.n_ok, summary.n_bad, summary.n_missing) == (4, 2, 1, 1)
    assert (summary.confidence, summary.strict) == (66.7, 50.0)
    assert len(L.warnings(L.statement_summary(lines_to_ledger(lines), key="doc_id"), "doc_id").collect()) == 2


def test_no_header_or_no_dates_drops_out(spark):
    assert lines_to_ledger(as_lines(spark, [(1.0, ["a", "b"]), (2.0, ["01/01/2024", "5.00"])])).count() == 0
    assert lines_to_ledger(as_lines(spark, [(1.0, ["Date", "Debit", "Credit", "Balance"]), (2.0, ["x", "", "1.00", "2.00"])])).count() == 0


def test_columns_found_by_content(spark):
    """Unnamed columns are filled in order: balance from the last amount column."""
    lines = as_lines(spark, [(1.0, ["Details", "", "Debit", "", "Balance"])] + [
        (10.0 * i, ["text %d" % i, "0%d/01/2024" % i, "", "%d.00" % i, "%d.00" % (i * 10)]) for i in range(1, 6)])
    header = stored(L.find_header(lines))
    mapping = L.repair_mapping(header, L.column_kinds(L.body_lines(lines, header))).collect()[0].mapping
    assert mapping == ["particulars", "date", "debit", "credit", "balance"]


def test_verdicts_cover_all_rows(spark, sf_dir):
    book = X.ledger(spark, sf_dir)
    s = L.statement_summary(
        L.check_continuity(book, opening=None, tolerance=1, debit="debit_p", credit="credit_p", balance="balance_p"),
        opening="opening_p", debit="debit_p", credit="credit_p", balance="balance_p")
    odd = s.where("n_ok + n_bad + n_missing > n_rows or n_ok + n_bad + n_missing < n_rows - 1").count()
    assert odd == 0


def test_words_give_the_ledger_back(spark, sf_dir):
    """Nearly all documents must come back with all rows, amounts and verdicts of the printed ledger."""
    _, rows = words_to_ledger(X.words(spark, sf_dir))
    book = X.ledger(spark, sf_dir).select(
        F.col("account_id").alias("doc_id"), "seq", *[(F.col(c + "_p").cast("decimal(20,2)") / 100).alias("t_" + c)
                                                       for c in ("debit", "credit", "balance")])
    joined = book.join(rows, ["doc_id", "seq"], "left")
    same = F.lit(True)
    for c in ("debit", "credit", "balance"):
        same = same & F.col(c).eqNullSafe(F.col("t_" + c).cast("decimal(38,4)"))
    per_doc = joined.groupBy("doc_id").agg(F.bool_and(same).alias("exact"))
    n, exact = per_doc.agg(F.count("exact"), F.count_if("exact")).collect()[0]
    assert exact >= 0.96 * n


def test_words_land_in_one_cell(spark, sf_dir):
    from pagetables.operators import geometry as G

    words = X.words(spark, sf_dir)
    lines = stored(G.to_lines(G.cluster_rows(words)))
    cells = G.global_geometry(lines)
    counts = cells.groupBy("min_gap", "share").agg(
        F.sum(F.aggregate("cells", F.lit(0), lambda acc, c: acc + F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))))).collect()
    assert len(counts) == 6 and {r[2] for r in counts} == {words.count()}


def test_folding_over_pages_equals_a_plain_fold(spark):
    """Dates that end on the first of very many pages, other lines around, amounts and extras on later pages."""
    header = ["Date", "Narration", "Ref No", "Debit", "Credit", "Balance", "Branch", "Place"]
    rows = [(1, 1, 1, 5.0, header), (1, 1, 2, 20.0, ["", "before", "", "", "", "", "", ""])]
    rows += [(1, 1, 3, 30.0, ["01/04/2024", "first", "7", "1.00", "", "9.00", "B", ""])]
    rows += [(1, 1, 4, 40.0, ["02/04/2024 x", "second", "", "", "", "", "", "P"])]
    for page in range(2, 1001):
        for line in range(1, 4):
            amount = "5.00" if (page, line) == (700, 2) else "8.00" if page > 800 else ""
            rows.append((1, page, line, 10.0 * line, ["", f"t{page}.{line}", f"r{page}" if line == 1 else "", "", amount, "", "", f"p{page}" if page % 100 == 0 else ""]))
    rows += [(2, 1, 1, 5.0, header), (2, 1, 2, 9.0, ["03/04/2024", "", "", "", "2.00", "3.00", "", ""])]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_no int, y double, cells array<string>")
    got = {(r.doc_id, r.page, r.line_no): r for r in lines_to_ledger(lines).collect()}
    assert sorted(got) == [(1, 1, 3), (1, 1, 4), (2, 1, 2)]
    first, second = got[1, 1, 3], got[1, 1, 4]
    assert (first.particulars, first.ref, first.debit, first.n_lines) == ("before first", "7", Decimal(1), 2)
    assert first.extras == {"7:Branch": "B"}
    tail = [(p, n) for p in range(2, 1001) for n in range(1, 4)]
    assert second.particulars == " ".join(["second", *(f"t{p}.{n}" for p, n in tail)])
    assert second.ref == " ".join(["x", *(f"r{p}" for p in range(2, 1001))])
    assert second.credit == Decimal(5) and second.n_lines == 1 + len(tail)
    assert second.extras == {"8:Place": " ".join(["P", *(f"p{p}" for p in range(100, 1001, 100) for _ in range(3))])}
    assert got[2, 1, 2].balance == Decimal(3)
