"""Page layouts in competition, and generic tables from words."""

from pyspark.sql import functions as F

from pagetables.operators import grid
from pagetables.plans import tables as T
from workloads import fixtures as X

WORDS = "doc_id long, page int, word_no int, x0 double, x1 double, top double, bottom double, text string, conf double"
RULES = "doc_id long, page int, orient string, pos double"


def printed(doc, page, columns, rows, first=100.0):
    """Words of a table whose columns begin at the given places."""
    out = []
    for i, row in enumerate(rows):
        for x, text in zip(columns, row, strict=True):
            if text:
                out.append([doc, page, len(out) + 1, x, x + 5.0 * len(text), first + 15.0 * i, first + 15.0 * i + 10.0, text, 99.0])
    return out


HEAD = ["Account", "Debit", "Credit"]


def shown(df):
    rows = sorted(df.collect(), key=lambda r: (r.doc_id, r.page, r.row_no))
    return [(r.page, [c for c in r.cells]) for r in rows]


def test_pages_with_columns_of_their_own_come_back(spark):
    """The columns of page two stand where page one has long names: one geometry for both pages jams them, page layouts do not."""
    one = [["Account" + "x" * 22 + str(i), f"{i}.00", f"{2 * i}.50"] for i in range(100, 112)]
    two = [[f"Ledger{i}", f"{i}.00", f"{2 * i}.50"] for i in range(300, 312)]
    words = printed(1, 1, [50.0, 240.0, 330.0], [HEAD, *one]) + printed(1, 2, [20.0, 90.0, 150.0], [HEAD, *two])
    table = spark.createDataFrame(words, WORDS)
    want = [(1, HEAD), *((1, r) for r in one), *((2, r) for r in two)]
    assert shown(T.page_tables(table)) == want
    assert shown(T.words_to_tables(table)) == want


def test_rules_win_where_whitespace_cannot_tell(spark):
    """Text runs over the gaps between columns; the rules say where a cell ends. Rules that hold few rows lose."""
    rows = [HEAD, *([f"Lg{i}", f"{i}.00", f"{i}.50"] for i in range(10, 22))]
    tight = printed(1, 1, [50.0, 82.0, 110.0], [["Acc", "Dr", "Cr"], *rows[1:]])
    lines = [(1, 1, "v", x) for x in (45.0, 80.0, 109.0, 140.0)] + [(1, 1, "h", 95.0 + 15.0 * i) for i in range(14)]
    few = printed(2, 1, [50.0, 200.0, 330.0], rows)
    lines += [(2, 1, "v", x) for x in (45.0, 190.0, 320.0, 400.0)] + [(2, 1, "h", y) for y in (95.0, 110.0, 125.0, 140.0)]
    got = T.page_tables(spark.createDataFrame(tight + few, WORDS), spark.createDataFrame(lines, RULES))
    engines = {r.doc_id: r.engine for r in got.collect()}
    assert engines[1] == "ruled" and engines[2].startswith("stream")
    assert [c for _, c in shown(got.where("doc_id = 1"))] == [["Acc", "Dr", "Cr"], *rows[1:]]
    assert [c for _, c in shown(got.where("doc_id = 2"))] == rows


def test_tournament_equals_a_plain_one(spark, sf_dir):
    """Scores per page are those of each candidate alone, and the pick follows the rule stated."""
    words = X.words(spark, sf_dir).where("doc_id % 10 = 1")
    rules = X.rules(spark, sf_dir).where("doc_id % 10 = 1")
    rows = T.page_candidates(words, rules)
    scored = {}
    for r in grid.score_grid(rows, keys=("doc_id", "page", "ord")).join(
            rows.select("doc_id", "page", "ord", "engine").distinct(), ["doc_id", "page", "ord"]).collect():
        scored.setdefault((r.doc_id, r.page), []).append((r.ord, r.engine, r.score, r.n_rows))
    want = {}
    for place, found in scored.items():
        best = max(found, key=lambda c: (c[2], -c[0]))
        streams = [c for c in found if c[1].startswith("stream")]
        stream = max(streams, key=lambda c: (c[2], -c[0]))
        swap = best[1].startswith("ruled") and stream[3] > 1.4 * best[3] and stream[2] >= 0.8 * best[2]
        want[place] = (stream if swap else best)[1]
    got = {(r.doc_id, r.page): r.engine for r in T.page_tables(words, rules).select("doc_id", "page", "engine").distinct().collect()}
    assert len(got) > 10 and all(want[p] == e for p, e in got.items())


def test_odd_pages(spark):
    """One word, no rules on some pages, an empty table."""
    words = spark.createDataFrame(printed(1, 1, [50.0], [["alone"]]) + printed(1, 3, [50.0, 200.0], [["a", "b"], ["c", "1.00"]]), WORDS)
    rules = spark.createDataFrame([(9, 9, "v", 1.0)], RULES)
    got = shown(T.page_tables(words, rules))
    assert [p for p, _ in got] == [1, 3, 3] and got[0][1] == ["alone"]
    assert T.page_tables(words.where("false"), rules.where("false")).count() == 0
    assert T.words_to_tables(words.where("false")).select(F.count("*")).first()[0] == 0
