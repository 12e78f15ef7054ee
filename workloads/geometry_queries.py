"""Queries over positioned words: lines, separators, cells, lattice, records, readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagetables.functions import fixed_values as V
from pagetables.operators import geometry as G, quality as Q
from pagetables.session import new_folder, stored
from pagetables.sources.tokens import normalize_words, read_ocr_tokens
from workloads import fixtures as X, sql as S
from workloads.registry import query

WORDS = S.words_sql()
NUMBERED = WORDS + S.LINE_WORDS


def lines_of(spark, sf_dir) -> DataFrame:
    return stored(G.to_lines(G.cluster_rows(X.words(spark, sf_dir))), "lines")


# --- readers -----------------------------------------------------------------

# OCR rows written as TSV, with the noise of the fixture
_OCR = WORDS + """,
tokens AS (
  SELECT doc_id, page, word_no, CAST(floor(top / 12) AS INTEGER) AS line_num, CAST(round(x0 * 2) AS INTEGER) AS l, CAST(round(top * 2) AS INTEGER) AS t,
    CAST(round((x1 - x0) * 2) AS INTEGER) AS w, CAST(round((bottom - top) * 2) AS INTEGER) AS h, text,
    doc_id * 31 + CAST(floor(top / 12) AS INTEGER) * 17 + word_no * 7 AS spread FROM words),
ocr AS (
  SELECT *, CAST(CASE WHEN spread % 23 = 0 THEN -1 ELSE spread % 101 END AS DOUBLE) AS conf FROM tokens WHERE spread % 41 <> 0)
"""


def ocr_words(spark, sf_dir) -> DataFrame:
    path = new_folder(spark, "ocr")
    # every column as written by an OCR run: tab separated, unquoted
    X.ocr_tokens(spark, sf_dir).write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return read_ocr_tokens(spark, path, min_conf=25, scale_x=0.5, scale_y=0.5)


@query("read_ocr_tokens", _OCR + """
SELECT doc_id, page, word_no, l * 0.5 AS x0, (l + w) * 0.5 AS x1, t * 0.5 AS top, (t + h) * 0.5 AS bottom, text, conf FROM ocr WHERE conf >= 25""")
def read_ocr(spark, sf_dir):
    return ocr_words(spark, sf_dir).select("doc_id", "page", "word_no", "x0", "x1", "top", "bottom", "text", "conf")


@query("ocr_confidence", _OCR + """,
by_page AS (
  SELECT doc_id, page, count(*) AS n_words, (20 * CAST(sum(conf) AS BIGINT) + count(*)) // (2 * count(*)) AS tenths FROM ocr WHERE conf >= 25 GROUP BY 1, 2),
by_doc AS (SELECT doc_id, count(*) AS n_pages, (2 * sum(tenths) + count(*)) // (2 * count(*)) / 10.0 AS confidence FROM by_page GROUP BY 1)
SELECT doc_id, n_pages, confidence, confidence < 80 AS low FROM by_doc""")
def ocr_confidence(spark, sf_dir):
    return Q.ocr_confidence(ocr_words(spark, sf_dir))[1]


@query("normalize_words", WORDS + """
, items AS (
  SELECT doc_id, page, word_no, x0 AS x, CASE WHEN word_no % 5 = 0 THEN NULL ELSE x1 - x0 END AS width,
    CASE WHEN word_no % 7 = 0 THEN 0.0 ELSE 8.0 END AS height, 1000.0 - bottom AS baseline, text FROM words)
SELECT doc_id, page, word_no, x AS x0, x + coalesce(width, length(text) * 8.0 * 0.5) AS x1, 1000.0 - baseline - 8.0 AS top,
  1000.0 - baseline + 2.0 AS bottom, text FROM items WHERE word_no % 11 <> 0""")
def normalize(spark, sf_dir):
    no = F.col("word_no")
    items = X.words(spark, sf_dir).select(
        "doc_id", "page", "word_no", F.col("x0").alias("x"), F.when(no % 5 != 0, F.col("x1") - F.col("x0")).alias("width"),
        F.when(no % 7 == 0, 0.0).otherwise(8.0).alias("height"), (1000.0 - F.col("bottom")).alias("baseline"),
        F.lit(1000.0).alias("page_height"), F.when(no % 11 == 0, " ").otherwise(F.col("text")).alias("text"))
    return normalize_words(items).drop("conf")


# --- lines and columns -------------------------------------------------------

@query("cluster_rows", NUMBERED + "SELECT doc_id, page, word_no, line_no FROM numbered")
def cluster_rows(spark, sf_dir):
    return G.cluster_rows(X.words(spark, sf_dir)).select("doc_id", "page", "word_no", "line_no")


# odd words sink three points; lines are twelve apart and the tolerance is 4.8
@query("cluster_rows_tol", NUMBERED + "SELECT doc_id, page, word_no, line_no FROM numbered")
def cluster_rows_tol(spark, sf_dir):
    sunk = F.when(F.col("word_no") % 2 == 1, 3.0).otherwise(0.0)
    words = X.words(spark, sf_dir).withColumns({"top": F.col("top") + sunk, "bottom": F.col("bottom") + sunk})
    return G.cluster_rows_tol(words).select("doc_id", "page", "word_no", "line_no")


@query("page_text", NUMBERED + """,
line_texts AS (SELECT doc_id, page, line_no, string_agg(text, ' ' ORDER BY x0) AS text FROM numbered GROUP BY 1, 2, 3)
SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS text FROM line_texts GROUP BY 1, 2""")
def page_text(spark, sf_dir):
    return G.page_text(X.words(spark, sf_dir))


_SEP_OUT = "SELECT {k}, min_gap, share, array_to_string(list_transform(seps, lambda s: CAST(CAST(s AS INTEGER) AS VARCHAR)), ',') AS seps FROM sep_lists"


def _seps(df: DataFrame) -> DataFrame:
    return df.drop("n_wide").withColumn("seps", F.array_join(F.transform("seps", lambda s: s.cast("int").cast("string")), ","))


@query("column_separators", WORDS + S.seps_sql() + _SEP_OUT.format(k="doc_id"))
def column_separators(spark, sf_dir):
    return _seps(G.column_separators(lines_of(spark, sf_dir)))


@query("column_separators_page", WORDS + S.seps_sql("page") + _SEP_OUT.format(k="doc_id, page"))
def column_separators_page(spark, sf_dir):
    return _seps(G.column_separators(lines_of(spark, sf_dir), scope="page"))


def _long(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.select(*keys, F.posexplode_outer("cells").alias("col_no", "text")).where("text <> ''")


@query("assign_columns", WORDS + S.seps_sql() + S.ASSIGNED + """
SELECT doc_id, page, line_no, band AS col_no, text FROM cell_parts WHERE min_gap = 4.0 AND share = 0.08""")
def assign_columns(spark, sf_dir):
    lines = lines_of(spark, sf_dir)
    seps = G.column_separators(lines, min_gaps=[4.0], shares=[0.08])
    return _long(G.assign_columns(lines, seps), "doc_id", "page", "line_no")


@query("global_geometry", WORDS + S.seps_sql() + S.ASSIGNED + """
SELECT min_gap, share, doc_id, page, line_no, band AS col_no, text FROM cell_parts""")
def global_geometry(spark, sf_dir):
    return _long(G.global_geometry(lines_of(spark, sf_dir)), "min_gap", "share", "doc_id", "page", "line_no")


# --- ruled tables ------------------------------------------------------------

RULES = S.LEDGER + f""",
rule_pages AS (SELECT account_id AS doc_id, CAST((seq - 1) // 8 + 1 AS INTEGER) AS page, count(*) AS n FROM ledger GROUP BY 1, 2),
rules AS (
  SELECT doc_id, page, 'v' AS orient, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in X.VERTICALS)}]) AS pos FROM rule_pages WHERE doc_id % 4 <> 3
  UNION ALL SELECT doc_id, page, 'h', unnest(list_transform(generate_series(0, n), lambda k: 76.0 + 36.0 * k)) FROM rule_pages)
"""


@query("merge_rules", RULES + """,
twins AS (SELECT doc_id, page, orient, pos FROM rules UNION ALL SELECT doc_id, page, orient, pos + 1.5 FROM rules WHERE (doc_id + page) % 3 = 0
  UNION ALL SELECT doc_id, page, orient, pos + 3.0 FROM rules WHERE (doc_id + page) % 6 = 0),
marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 2.0 THEN 0 ELSE 1 END AS fresh FROM twins WINDOW w AS (PARTITION BY doc_id, page, orient ORDER BY pos)),
grp AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page, orient ORDER BY pos) AS g FROM marked)
SELECT doc_id, page, orient, round(avg(pos), 3) AS pos, count(*) AS n_merged FROM grp GROUP BY doc_id, page, orient, g""")
def merge_rules(spark, sf_dir):
    rules = X.rules(spark, sf_dir)
    key = F.col("doc_id") + F.col("page")
    shifts = F.filter(F.array(F.lit(0.0), F.when(key % 3 == 0, 1.5), F.when(key % 6 == 0, 3.0)), lambda s: s.isNotNull())
    twins = rules.withColumn("shift", F.explode(shifts)).select(
        "doc_id", "page", "orient", (F.col("pos") + F.col("shift")).alias("pos"))
    return G.merge_rules(twins, 2.0).withColumn("pos", F.round("pos", 3))


@query("choose_mode", RULES + """,
page_rules AS (SELECT doc_id, page, count(*) FILTER (orient = 'v') >= 5 AND count(*) FILTER (orient = 'h') >= 5 AS ruled FROM rules GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_pages, count(*) FILTER (ruled) AS n_ruled,
  CASE WHEN count(*) FILTER (ruled) >= count(*) * 0.6 THEN 'lattice' ELSE 'stream' END AS mode FROM page_rules GROUP BY 1""")
def choose_mode(spark, sf_dir):
    return G.choose_mode(X.rules(spark, sf_dir))


_V = "[" + ", ".join(str(v) for v in X.VERTICALS) + "]"


@query("lattice_cells", NUMBERED.replace(S.LEDGER, RULES) + f""",
boxed AS (
  SELECT w.doc_id, w.page, w.line_no, w.x0, w.text, len(list_filter({_V}, lambda v: v <= (w.x0 + w.x1) / 2)) - 1 AS col_no,
    CAST(floor(((w.top + w.bottom) / 2 - 76) / 36) AS BIGINT) AS row_no, p.n
  FROM numbered w JOIN rule_pages p ON w.doc_id = p.doc_id AND w.page = p.page WHERE w.doc_id % 4 <> 3)
SELECT doc_id, page, row_no, col_no, string_agg(text, ' ' ORDER BY line_no, x0) AS text FROM boxed
WHERE col_no >= 0 AND col_no < {len(X.VERTICALS) - 1} AND row_no >= 0 AND row_no < n GROUP BY 1, 2, 3, 4""")
def lattice_cells(spark, sf_dir):
    return G.lattice_cells(X.words(spark, sf_dir), X.rules(spark, sf_dir))


# --- records -----------------------------------------------------------------

_REGION = NUMBERED + f""",
page_span AS (SELECT doc_id, page, min(x0) + (max(x1) - min(x0)) * 0.55 AS lim FROM words GROUP BY 1, 2),
left_text AS (
  SELECT n.doc_id, n.page, n.line_no, string_agg(n.text, ' ' ORDER BY n.x0) AS t FROM numbered n
  JOIN page_span s ON n.doc_id = s.doc_id AND n.page = s.page WHERE n.x0 < s.lim GROUP BY 1, 2, 3),
regions AS (SELECT doc_id, page, min(line_no) AS first_line, max(line_no) AS last_line FROM left_text WHERE regexp_matches(t, {S.q(V.DATE_ANYWHERE)}) GROUP BY 1, 2)
"""


@query("region", _REGION + "SELECT doc_id, page, first_line, last_line FROM regions")
def region(spark, sf_dir):
    return G.region(lines_of(spark, sf_dir))


def _rows(spark, sf_dir) -> DataFrame:
    """The printed cells as rows, every third document shifted one column to the right."""
    lines = X.statement_lines(spark, sf_dir, False, False)
    shifted = F.concat(F.array(F.lit("")), F.slice("cells", 1, 6))
    return lines.withColumn("cells", F.when(F.col("doc_id") % 3 == 1, shifted).otherwise(F.col("cells")))


_LINES = S.lines_sql(footer=False, bleeding=False)
_SHIFTED = ",\nshifted AS (SELECT doc_id, page, line_no, y, CASE WHEN doc_id % 3 = 1 THEN [''] || cells[1:6] ELSE cells END AS cells FROM lines)"
# the anchor column of those rows, read off the printing rule
_ANCHOR = "CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END"


@query("date_anchor_column", _LINES + _SHIFTED + f""",
votes AS (
  SELECT doc_id, col, count(*) FILTER (regexp_matches(trim(text), {S.q(V.DATE_PREFIX)})) AS v
  FROM (SELECT doc_id, unnest(generate_series(0, 6)) AS col, unnest(cells) AS text FROM shifted) GROUP BY 1, 2),
best AS (SELECT *, max(v) OVER (PARTITION BY doc_id) AS m FROM votes)
SELECT doc_id, coalesce(min(col) FILTER (m > 0 AND v >= m * 0.6), 0) AS anchor_col FROM best GROUP BY 1""")
def date_anchor_column(spark, sf_dir):
    return G.date_anchor_column(_rows(spark, sf_dir))


_FOLDED = """,
parts AS (SELECT doc_id, page, record, prose, line_no, unnest(generate_series(0, len(cells) - 1)) AS col, unnest(cells) AS text FROM records),
cell_join AS (SELECT doc_id, page, record, prose, col, coalesce(string_agg(text, ' ' ORDER BY line_no) FILTER (text <> ''), '') AS text FROM parts GROUP BY 1, 2, 3, 4, 5),
heads AS (SELECT doc_id, page, record, min(line_no) AS line_no, count(DISTINCT line_no) AS n_lines FROM records GROUP BY 1, 2, 3)
SELECT c.doc_id, c.page, h.line_no, any_value(c.prose) AS prose, any_value(h.n_lines) AS n_lines, string_agg(c.text, '|' ORDER BY c.col) AS cells
FROM cell_join c JOIN heads h ON c.doc_id = h.doc_id AND c.page = h.page AND c.record = h.record GROUP BY c.doc_id, c.page, h.line_no"""


def _joined_cells(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "page", "line_no", "prose", "n_lines", F.array_join("cells", "|").alias("cells"))


@query("fold_by_anchor", _LINES + _SHIFTED + f""",
dated AS (SELECT *, {_ANCHOR} AS ac, regexp_matches(array_to_string(cells[1:4], ' '), {S.q(V.DATE_ANYWHERE)}) AS has_date FROM shifted),
bounds AS (SELECT *, min(line_no) FILTER (has_date) OVER w AS f, max(line_no) FILTER (has_date) OVER w AS l FROM dated WINDOW w AS (PARTITION BY doc_id, page)),
flags AS (SELECT *, coalesce(line_no BETWEEN f AND l, false) AS inside, coalesce(regexp_matches(trim(cells[ac + 1]), {S.q(V.DATE_PREFIX)}), false) AS starts FROM bounds),
records AS (
  SELECT doc_id, page, line_no, NOT inside AS prose, CASE WHEN inside THEN cells ELSE [array_to_string(list_filter(cells, lambda c: c <> ''), ' ')] END AS cells,
    sum(CASE WHEN NOT inside OR line_no = f OR starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS record FROM flags)
""" + _FOLDED)
def fold_by_anchor(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    left = F.array_join(F.slice("cells", 1, 4), " ")
    regions = rows.where(left.rlike(V.DATE_ANYWHERE)).groupBy("doc_id", "page").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    return _joined_cells(G.fold_by_anchor(rows, regions, G.date_anchor_column(rows)))


@query("fold_by_gap", _LINES + """,
gap_rows AS (
  SELECT *, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS gap, len(list_filter(cells, lambda c: c <> '')) AS filled FROM lines),
page_gap AS (
  SELECT doc_id, page, list_sort(list(gap) FILTER (gap > 0)) AS gs, count(gap) AS n, arg_max(line_no, filled * 1000 - line_no) AS header_line FROM gap_rows GROUP BY 1, 2),
page_lim AS (SELECT *, coalesce(gs[len(gs) // 2 + 1], 8.0) * 1.5 AS lim FROM page_gap),
page_tell AS (
  SELECT p.doc_id, p.page, p.header_line, p.lim, p.n > 0 AND count(*) FILTER (g.gap > p.lim) >= greatest(1, floor(p.n * 0.15))
    AND count(*) FILTER (g.gap > p.lim) <= p.n * 0.75 AS telling
  FROM page_lim p JOIN gap_rows g ON p.doc_id = g.doc_id AND p.page = g.page GROUP BY p.doc_id, p.page, p.header_line, p.lim, p.n),
records AS (
  SELECT g.doc_id, g.page, g.line_no, g.line_no < t.header_line AS prose,
    CASE WHEN g.line_no < t.header_line THEN [array_to_string(list_filter(g.cells, lambda c: c <> ''), ' ')] ELSE g.cells END AS cells,
    sum(CASE WHEN g.line_no <= t.header_line OR NOT t.telling OR g.gap > t.lim THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc_id, g.page ORDER BY g.line_no) AS record
  FROM gap_rows g JOIN page_tell t ON g.doc_id = t.doc_id AND g.page = t.page)
""" + _FOLDED)
def fold_by_gap(spark, sf_dir):
    rows = X.statement_lines(spark, sf_dir, False, False).select(
        "doc_id", "page", "line_no", F.col("y").alias("cy"), F.lit(8.0).alias("height"), "cells")
    return _joined_cells(G.fold_by_gap(rows))


# brute force over the x positions of a page, folded as a list
@query("nearest_column", WORDS + """,
page_xs AS (SELECT doc_id, page, list_sort(list(DISTINCT x0)) AS xs FROM words GROUP BY 1, 2),
page_anchors AS (
  SELECT doc_id, page, list_reduce(xs, lambda acc, x: CASE WHEN x[1] - acc[len(acc)] > 30 THEN acc || x ELSE acc END) AS anchors
  FROM (SELECT doc_id, page, list_transform(xs, lambda x: [x]) AS xs FROM page_xs))
SELECT w.doc_id, w.page, w.word_no, list_position(list_transform(a.anchors, lambda p: abs(p - w.x0)),
  list_min(list_transform(a.anchors, lambda p: abs(p - w.x0)))) - 1 AS col_no
FROM words w JOIN page_anchors a ON w.doc_id = a.doc_id AND w.page = a.page""")
def nearest_column(spark, sf_dir):
    return G.nearest_column(X.words(spark, sf_dir), 30.0).select("doc_id", "page", "word_no", "col_no")
