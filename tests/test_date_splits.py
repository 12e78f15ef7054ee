"""Dates split from the text behind them: one pass against a plain loop over the rule."""

import random
import re

from pagetables.functions import fixed_values as V
from pagetables.functions.cells import MONEY
from pagetables.operators import grid

ROWS = "doc_id long, page int, row_no int, cells array<string>"
DATED = re.compile(V.DATE_THEN_TEXT)


def number(text):
    return re.search(MONEY, text.strip()) is not None


def plain(rows):
    """Pass after pass over one document: count, split the leftmost column that qualifies, begin again."""
    rows = [[c or "" for c in r] for r in rows]
    while True:
        chosen = None
        for j in range(max(map(len, rows), default=0)):
            texts = [r[j].strip() for r in rows if j < len(r) and r[j].strip()]
            hits = [m for m in map(DATED.match, texts) if m]
            numeric = sum(number(m[2]) for m in hits)
            if len(texts) >= 3 and (len(hits) >= 6 or len(hits) / len(texts) >= 0.5) and not numeric > len(hits) * 0.4:
                chosen = j
                break
        if chosen is None:
            return rows
        for r in rows:
            if chosen >= len(r):
                continue
            text = r[chosen].strip()
            if m := DATED.match(text):
                two = [m[1], m[2]]
            elif sum(bool(c.strip()) for c in r) >= 3 and re.match(r"\S+\s+\S", text):
                two = text.split(None, 1)
            else:
                two = [r[chosen], ""]
            r[chosen : chosen + 1] = two


def tables(spark, documents):
    rows = [(d, i // 3 + 1, i % 3 + 1, r) for d, table in documents.items() for i, r in enumerate(table)]
    return spark.createDataFrame(rows, ROWS)


def shown(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.page, r.row_no)):
        out.setdefault(r.doc_id, []).append(list(r.cells))
    return out


def test_one_pass_equals_the_loop(spark):
    """Chains of dates, header words, rows that become header-like by an earlier split, numbers behind dates, blanks, short rows."""
    rng = random.Random(7)
    parts = ["01/02/2024", "3-4-24", "05 Jan 2024", "rent", "Opening", "120.50", "7"]

    def cell():
        if rng.random() < 0.15:
            return rng.choice([None, "", "  ", "Date Details Ref"])
        lead = [rng.choice(parts[:3]) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
        return rng.choice(["", " "]) + " ".join([*lead, *rng.choices(parts, k=rng.randint(0, 3))])

    documents = {}
    for d in range(120):
        width = rng.randint(1, 4)
        documents[d] = [[cell() for _ in range(rng.choice([width, width, max(1, width - 1)]))] for _ in range(rng.randint(1, 9))]
    got = shown(grid.split_leading_date(tables(spark, documents)))
    want = {d: plain(rows) for d, rows in documents.items()}
    changed = sum(len(want[d][0]) > len(documents[d][0]) for d in documents)
    assert changed > 40 and max(len(want[d][0]) - len(documents[d][0]) for d in documents) >= 3
    for d in documents:
        assert [[c or "" for c in r] for r in got[d]] == want[d], documents[d]


def test_rows_are_written_once(spark):
    """No pass over the rows per split: a document with five dates in a cell takes the steps of one with a single date."""
    deep = {1: [[" ".join(["01/02/2024"] * 5 + ["rent"]), "x"]] * 4}
    got = shown(grid.split_leading_date(tables(spark, deep)))
    assert got[1] == [["01/02/2024"] * 5 + ["rent", "x"]] * 4
    assert {r.doc_id: list(r.splits) for r in grid.date_splits(tables(spark, deep)).collect()} == {1: [5]}


def test_time_stays_with_the_date(spark):
    anchors = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0)], "doc_id long, anchor_col int")
    got = shown(grid.split_anchor_date(tables(spark, {
        1: [["01/02/2024 UPI rent", "5"], ["02 Apr 2024 cash", "6"], ["prose alone 01/02/2024 x"], ["more", "7"]],
        2: [["01/02/2024 10:30", "5"], ["02/02/2024 11:45:10 x", "6"], ["03/02/2024 y", "7"]],
        3: [["a", "01/02/2024 x"], ["b", "02/02/2024"], [None, None]],
        4: [["01/02/2024 x", "5"], ["total", ""]],
        5: [["01/02/2024 x", "5"]],
    }), anchors))
    assert got[1] == [["01/02/2024", "UPI rent", "5"], ["02 Apr 2024", "cash", "6"], ["prose alone 01/02/2024 x"], ["more", "", "7"]]
    assert got[2] == [["01/02/2024 10:30", "5"], ["02/02/2024 11:45:10 x", "6"], ["03/02/2024 y", "7"]]
    assert got[3] == [["a", "01/02/2024 x"], ["b", "02/02/2024"], [None, None]]  # one row of three
    assert got[4] == [["01/02/2024", "x", "5"], ["total", "", ""]]
    assert got[5] == [["01/02/2024 x", "5"]]  # no anchor known


def test_nothing_to_split(spark):
    empty = spark.createDataFrame([], ROWS)
    assert shown(grid.split_leading_date(empty)) == {}
    odd = {1: [[]], 2: [[None]], 3: [["01/02/2024 x"], ["01/02/2024 y"]]}
    assert shown(grid.split_leading_date(tables(spark, odd))) == odd
