"""Queries over table rows: typing, cleaning, scoring, linking, splitting, choosing, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagetables.functions import fixed_values as V
from pagetables.functions.cells import format_indian_paise
from pagetables.operators import grid as T
from pagetables.operators.geometry import date_anchor_column
from pagetables.plans.documents import convert_documents
from pagetables.plans.statements import words_to_ledger
from pagetables.plans.tables import page_tables, record_tables, words_to_tables
from pagetables.session import new_folder
from pagetables.sources import sinks
from workloads import fixtures as X, sql as S
from workloads.registry import query

LINES = S.lines_sql(footer=False, bleeding=False)


def _lines(spark, sf_dir) -> DataFrame:
    return X.statement_lines(spark, sf_dir, False, False).withColumnRenamed("line_no", "row_no")


def _out(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("doc_id", "page", "row_no", *more, F.array_join("cells", "|").alias("cells"))


_OUT = "doc_id, page, row_no, array_to_string(cells, '|') AS cells"


# --- typing ------------------------------------------------------------------

_FORMATS = ["%d/%m/%Y", "%d-%m-%Y", "%d/%m/%y", "%d-%m-%y", "%d-%b-%Y", "%d %b %Y", "%d-%b-%y", "%d.%m.%Y", "%Y-%m-%d", "%d %B %Y"]
_SPARK_FORMATS = ["dd/MM/yyyy", "dd-MM-yyyy", "dd/MM/yy", "dd-MM-yy", "dd-MMM-yyyy", "dd MMM yyyy", "dd-MMM-yy", "dd.MM.yyyy", "yyyy-MM-dd", "dd MMMM yyyy"]
_AMT = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query("type_cells", "cells AS (SELECT o_orderkey, CASE o_orderkey % 16 " + " ".join(
    f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_FORMATS)) + f"""
  WHEN 10 THEN {S.money_sql(_AMT)} WHEN 11 THEN 'Rs. ' || {S.money_sql(_AMT)} WHEN 12 THEN '(' || {S.money_sql(_AMT)} || ')'
  WHEN 13 THEN {S.money_sql(_AMT)} || ' Dr' WHEN 14 THEN o_orderpriority ELSE '31/02/2024' END AS text FROM orders),
typed AS (SELECT *, {S.date_sql('text')} AS d, {S.number_sql('text')} AS n FROM cells)
SELECT o_orderkey, text, CASE WHEN text = '' THEN 'empty' WHEN d IS NOT NULL THEN 'date' WHEN n IS NOT NULL THEN 'number' ELSE 'text' END AS kind,
  CAST(d AS VARCHAR) AS dt, CASE WHEN d IS NULL THEN CAST(n * 100 AS BIGINT) END AS num_p FROM typed""")
def type_cells(spark, sf_dir):
    paise = F.round(F.col("o_totalprice") * 100).cast("long")
    money = format_indian_paise(paise)
    key = F.col("o_orderkey") % 16
    options = [F.date_format("o_orderdate", f) for f in _SPARK_FORMATS] + [
        money, F.concat(F.lit("Rs. "), money), F.concat(F.lit("("), money, F.lit(")")), F.concat(money, F.lit(" Dr")),
        F.col("o_orderpriority"), F.lit("31/02/2024")]
    text = F.coalesce(*[F.when(key == i, v) for i, v in enumerate(options)])
    typed = T.type_cells(X.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")))
    return typed.select("o_orderkey", "text", "kind", F.col("dt").cast("string").alias("dt"), (F.col("num") * 100).cast("long").alias("num_p"))


# --- cleaning ----------------------------------------------------------------

_DIRTY = LINES + """,
dirty AS (
  SELECT doc_id, page, line_no AS row_no, CASE WHEN line_no % 5 = 0 THEN list_transform(cells, lambda c: '  ')
    WHEN doc_id % 3 = 1 THEN [''] || list_transform(cells[1:6], lambda c: replace(c, '/', chr(10)))
    ELSE list_transform(cells, lambda c: replace(c, '/', chr(10))) END AS cells FROM lines)
"""


def _dirty(spark, sf_dir) -> DataFrame:
    torn = F.transform("cells", lambda c: F.replace(c, F.lit("/"), F.lit("\n")))
    return _lines(spark, sf_dir).withColumn(
        "cells",
        F.when(F.col("row_no") % 5 == 0, F.transform("cells", lambda c: F.lit("  ")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.array(F.lit("")), F.slice(torn, 1, 6)))
        .otherwise(torn))


@query("clean_cells", _DIRTY + """,
tidy AS (SELECT doc_id, page, row_no, list_transform(cells, lambda c: trim(replace(c, chr(10), ' '))) AS cells FROM dirty),
full_rows AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY row_no) AS row_no, cells FROM tidy
  WHERE len(list_filter(cells, lambda c: c <> '')) > 0),
flat AS (SELECT doc_id, page, row_no, unnest(generate_series(1, len(cells))) AS col, unnest(cells) AS text FROM full_rows),
keep AS (SELECT DISTINCT doc_id, col FROM flat WHERE text <> '')
SELECT f.doc_id, f.page, f.row_no, string_agg(f.text, '|' ORDER BY f.col) AS cells FROM flat f JOIN keep k ON f.doc_id = k.doc_id AND f.col = k.col GROUP BY 1, 2, 3""")
def clean_cells(spark, sf_dir):
    return _out(T.clean_cells(_dirty(spark, sf_dir)))


@query("drop_sparse_columns", _DIRTY + """,
flat AS (SELECT doc_id, page, row_no, unnest(generate_series(1, len(cells))) AS col, unnest(cells) AS text FROM dirty),
col_n AS (SELECT doc_id, col, count(*) FILTER (trim(text) <> '') AS n, count(*) AS total FROM flat GROUP BY 1, 2),
keep AS (SELECT doc_id, col FROM col_n WHERE n >= total * 0.03)
SELECT f.doc_id, f.page, f.row_no, string_agg(f.text, '|' ORDER BY f.col) AS cells FROM flat f JOIN keep k ON f.doc_id = k.doc_id AND f.col = k.col GROUP BY 1, 2, 3""")
def drop_sparse_columns(spark, sf_dir):
    return _out(T.drop_sparse_columns(_dirty(spark, sf_dir)))


# --- scoring and choosing ----------------------------------------------------

# every fourth document has its amounts jammed in one cell
_JAMMED = LINES + """,
jammed AS (
  SELECT doc_id, page, line_no AS row_no, CASE WHEN doc_id % 4 = 0 THEN cells[1:4] || [trim(cells[5] || ' ' || cells[6] || ' ' || cells[7])]
    WHEN doc_id % 3 = 1 THEN [''] || cells[1:6] ELSE cells END AS cells FROM lines)
"""


def _jammed(spark, sf_dir) -> DataFrame:
    jam = F.concat(F.slice("cells", 1, 4), F.array(F.trim(F.array_join(F.slice("cells", 5, 3), " "))))
    return _lines(spark, sf_dir).withColumn(
        "cells", F.when(F.col("doc_id") % 4 == 0, jam).when(
            F.col("doc_id") % 3 == 1, F.concat(F.array(F.lit("")), F.slice("cells", 1, 6))).otherwise(F.col("cells")))


_SCORED = _JAMMED + f""",
flat AS (SELECT doc_id, page, row_no, unnest(generate_series(1, len(cells))) AS col, unnest(cells) AS text FROM jammed),
typed AS (
  SELECT *, {S.is_number_sql('text')} AS num, {S.date4_sql('text')} IS NOT NULL AS dat,
    len(list_filter(string_split(text, ' '), lambda t: regexp_matches(t, '^-?([0-9]{{1,3}}(,[0-9]{{2,3}})*|[0-9]+)[.][0-9]{{2,4}}$'))) >= 2 AS jam FROM flat),
cols AS (SELECT doc_id, col, count(*) FILTER (text <> '') AS n, count(*) FILTER (num) AS nn, count(*) FILTER (dat) AS nd FROM typed GROUP BY 1, 2),
per_col AS (SELECT doc_id, count(*) FILTER (n > 0) AS n_cols, count(*) FILTER (n >= 2 AND (nn / n >= 0.6 OR nd / n >= 0.6)) AS n_coherent FROM cols GROUP BY 1),
per_row AS (SELECT doc_id, page, row_no, bool_or(num) AS data FROM typed GROUP BY 1, 2, 3),
per_doc AS (SELECT doc_id, count(*) AS n_rows, count(*) FILTER (data) AS n_data FROM per_row GROUP BY 1),
fill AS (SELECT doc_id, count(*) FILTER (text <> '') AS n_filled, count(*) FILTER (jam) AS n_jammed FROM typed GROUP BY 1),
scores AS (
  SELECT d.doc_id, n_rows, n_cols, n_coherent, n_data, n_filled, n_jammed,
    round(10.0::DOUBLE * n_coherent + 1.5::DOUBLE * n_cols + least(15.0::DOUBLE, n_data / 5.0::DOUBLE) + 8.0::DOUBLE * (n_filled / (n_rows * n_cols))
      - 35.0::DOUBLE * (n_jammed / n_filled), 2) AS score
  FROM per_doc d JOIN per_col c ON d.doc_id = c.doc_id JOIN fill f ON d.doc_id = f.doc_id)
"""


@query("score_grid", _SCORED + "SELECT doc_id, n_rows, n_cols, n_coherent, n_data, n_filled, n_jammed, score FROM scores")
def score_grid(spark, sf_dir):
    return T.score_grid(_jammed(spark, sf_dir)).select(
        "doc_id", "n_rows", "n_cols", "n_coherent", "n_data", "n_filled", "n_jammed", "score")


_PAGE_CANDS = LINES + """,
page_rows AS (SELECT doc_id, page, count(*) AS n FROM lines GROUP BY 1, 2),
cands AS (
  SELECT doc_id, page, 0 AS ord, 'ruled-lines' AS engine, 30 + (doc_id % 7) * 1.0 AS score, CASE WHEN doc_id % 3 = 0 THEN n // 2 ELSE n END AS n_rows FROM page_rows
  UNION ALL SELECT doc_id, page, 1, 'ruled-text', 30 + ((doc_id + page) % 7) * 1.0, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n - 1 END FROM page_rows
  UNION ALL SELECT doc_id, page, 2, 'stream-4', 27 + (page % 9) * 1.0, n FROM page_rows
  UNION ALL SELECT doc_id, page, 3, 'stream-7', 27 + (doc_id % 9) * 1.0, n FROM page_rows)
"""


def _page_cands(spark, sf_dir) -> DataFrame:
    pages = _lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    d, p, n = F.col("doc_id"), F.col("page"), F.col("n")

    def one(ord_, engine, score, rows):
        return F.struct(F.lit(ord_).alias("ord"), F.lit(engine).alias("engine"), score.cast("double").alias("score"), rows.cast("long").alias("n_rows"))

    return pages.select("doc_id", "page", F.inline(F.array(
        one(0, "ruled-lines", 30 + d % 7, F.when(d % 3 == 0, F.floor(n / 2)).otherwise(n)),
        one(1, "ruled-text", 30 + (d + p) % 7, F.when(d % 5 == 0, 0).otherwise(n - 1)),
        one(2, "stream-4", 27 + p % 9, n),
        one(3, "stream-7", 27 + d % 9, n))))


@query("pick_page_candidate", _PAGE_CANDS + """,
picked AS (
  SELECT doc_id, page, arg_max({'ord': ord, 'engine': engine, 'score': score, 'n_rows': n_rows}, score * 100 - ord) AS b,
    arg_max({'ord': ord, 'engine': engine, 'score': score, 'n_rows': n_rows}, score * 100 - ord) FILTER (engine LIKE 'stream%') AS s
  FROM cands WHERE n_rows > 0 GROUP BY 1, 2),
chosen AS (SELECT doc_id, page, CASE WHEN b.engine LIKE 'ruled%' AND s.n_rows > b.n_rows * 1.4 AND s.score >= b.score * 0.8 THEN s ELSE b END AS c FROM picked)
SELECT doc_id, page, c.ord AS ord, c.engine AS engine, c.score AS score, c.n_rows AS n_rows FROM chosen""")
def pick_page_candidate(spark, sf_dir):
    return T.pick_page_candidate(_page_cands(spark, sf_dir))


@query("pick_document_candidate", _PAGE_CANDS + """,
docs AS (SELECT doc_id, ord, max(score) AS score, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM cands GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score * (1 + 0.001::DOUBLE * n_rows) DESC, ord) AS r FROM docs)
SELECT doc_id, ord, score, n_rows FROM ranked WHERE r = 1""")
def pick_document_candidate(spark, sf_dir):
    docs = _page_cands(spark, sf_dir).groupBy("doc_id", "ord").agg(F.max("score").alias("score"), F.sum("n_rows").alias("n_rows"))
    return T.pick_document_candidate(docs)


# --- linking -----------------------------------------------------------------

# later headers of odd documents differ in one cell
_LATER = LINES + """,
later AS (
  SELECT doc_id, page, line_no AS row_no, CASE WHEN page > 1 AND doc_id % 2 = 1 AND cells[1] = 'Date' THEN cells[1:6] || ['Balance Rs'] ELSE cells END AS cells FROM lines)
"""


def _later(spark, sf_dir) -> DataFrame:
    odd = (F.col("page") > 1) & (F.col("doc_id") % 2 == 1) & (F.get("cells", 0) == "Date")
    changed = F.concat(F.slice("cells", 1, 6), F.array(F.lit("Balance Rs")))
    return _lines(spark, sf_dir).withColumn("cells", F.when(odd, changed).otherwise(F.col("cells")))


@query("link_pages", _LATER + f""",
sigs AS (
  SELECT doc_id, list_transform(cells, lambda c: lower(trim(c))) AS sig FROM later
  WHERE page = 1 AND row_no <= 3 AND len(list_filter(cells, lambda c: c <> '')) >= 2
    AND len(list_filter(cells, lambda c: {S.is_number_sql('c')})) = 0),
seen AS (SELECT r.*, s.sig, list_transform(cells, lambda c: lower(trim(c))) AS me FROM later r LEFT JOIN sigs s ON r.doc_id = s.doc_id),
firsts AS (SELECT *, min(row_no) FILTER (sig IS NULL OR me <> sig) OVER (PARTITION BY doc_id, page) AS start FROM seen)
SELECT {_OUT} FROM firsts
WHERE page = 1 OR sig IS NULL OR row_no > start OR (row_no = start
  AND len(list_filter(generate_series(1, 7), lambda i: me[i] <> '' AND me[i] = sig[i])) < greatest(2, 4))""")
def link_pages(spark, sf_dir):
    return _out(T.link_pages(_later(spark, sf_dir)))


@query("drop_repeated_headers", _LATER + f""",
full_rows AS (SELECT DISTINCT doc_id, cells AS sig FROM later WHERE page = 1 AND len(list_filter(cells, lambda c: trim(c) <> '')) >= len(cells) - 1),
seen AS (SELECT r.*, f.sig IS NOT NULL AS rep FROM later r LEFT JOIN full_rows f ON r.doc_id = f.doc_id AND r.cells = f.sig),
firsts AS (SELECT *, min(row_no) FILTER (NOT rep) OVER (PARTITION BY doc_id, page) AS start FROM seen)
SELECT {_OUT} FROM firsts WHERE page = 1 OR row_no >= start""")
def drop_repeated_headers(spark, sf_dir):
    return _out(T.drop_repeated_headers(_later(spark, sf_dir)))


# one or two continuation rows below each header
_WRAPPED = LINES + """,
wrapped_raw AS (
  SELECT doc_id, page, y, cells FROM lines
  UNION ALL SELECT doc_id, page, 47.0, ['(d)', '', 'of item', '', '(Rs)', '(Rs)', ''] FROM lines WHERE cells[1] = 'Date'
  UNION ALL SELECT doc_id, page, 50.0, ['', '', 'more', '', 'in', '', ''] FROM lines WHERE cells[1] = 'Date' AND doc_id % 2 = 1
  UNION ALL SELECT doc_id, page, 52.0, ['a', '', 'b', '', '', 'c', ''] FROM lines WHERE cells[1] = 'Date' AND doc_id % 3 <> 1),
wrapped AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y) AS row_no, cells FROM wrapped_raw)
"""


def _wrapped(spark, sf_dir) -> DataFrame:
    lines = X.statement_lines(spark, sf_dir, False, False).select("doc_id", "page", "y", "cells")
    header = F.get("cells", 0) == "Date"

    def row(y, values, shown):
        return F.struct(F.lit(y).alias("y"), F.array(*[F.lit(v) for v in values]).alias("cells"), shown.alias("shown"))

    own = F.struct(F.col("y"), F.col("cells"), F.lit(True).alias("shown"))
    more = F.filter(F.array(
        own,
        row(47.0, ["(d)", "", "of item", "", "(Rs)", "(Rs)", ""], header),
        row(50.0, ["", "", "more", "", "in", "", ""], header & (F.col("doc_id") % 2 == 1)),
        row(52.0, ["a", "", "b", "", "", "c", ""], header & (F.col("doc_id") % 3 != 1))), lambda r: r.shown)
    from pyspark.sql import Window

    rows = lines.select("doc_id", "page", F.explode(more).alias("r")).select("doc_id", "page", "r.y", "r.cells")
    order = Window.partitionBy("doc_id", "page").orderBy("y")
    return rows.select("doc_id", "page", F.row_number().over(order).alias("row_no"), "cells")


@query("stack_wrapped_headers", _WRAPPED + f""",
facts AS (SELECT *, len(list_filter(cells, lambda c: {S.is_number_sql('c')} OR {S.date4_sql('c')} IS NOT NULL)) > 0 AS numeric,
    row_number() OVER (PARTITION BY doc_id ORDER BY page, row_no) AS pos FROM wrapped),
nexts AS (SELECT *, lead(cells) OVER w AS nx, lead(numeric) OVER w AS nx_num FROM facts WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
flags AS (SELECT *, coalesce(NOT numeric AND NOT nx_num AND len(list_filter(nx, lambda c: c <> '')) >= 2
    AND len(list_filter(generate_series(1, 7), lambda i: nx[i] <> '' AND cells[i] = '')) = 0, false) AS m FROM nexts),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, m ORDER BY pos) AS g FROM flags),
runs AS (SELECT *, m AND (row_number() OVER (PARTITION BY doc_id, m, g ORDER BY pos) - 1) % 2 = 0 AS starts FROM islands),
marked AS (SELECT *, coalesce(lag(starts) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM runs)
SELECT doc_id, page, row_no, array_to_string(CASE WHEN starts THEN list_transform(generate_series(1, 7), lambda i: trim(cells[i] || ' ' || nx[i])) ELSE cells END, '|') AS cells
FROM marked WHERE NOT gone""")
def stack_wrapped_headers(spark, sf_dir):
    return _out(T.stack_wrapped_headers(_wrapped(spark, sf_dir)))


# dates glued to the text behind them: twice in every fourth document, once in the next
_GLUED = LINES + """,
glued AS (
  SELECT doc_id, page, line_no AS row_no, CASE WHEN doc_id % 4 = 0 THEN [trim(cells[1] || ' ' || trim(cells[2] || ' ' || cells[3]))] || cells[4:7]
    WHEN doc_id % 4 = 1 THEN [cells[1], trim(cells[2] || ' ' || cells[3])] || cells[4:7] ELSE cells END AS cells FROM lines)
"""


def _glued(spark, sf_dir) -> DataFrame:
    def part(i):
        return F.get("cells", i)

    tail = F.trim(F.concat(part(1), F.lit(" "), part(2)))
    return _lines(spark, sf_dir).withColumn("cells", F.when(
        F.col("doc_id") % 4 == 0, F.concat(F.array(F.trim(F.concat(part(0), F.lit(" "), tail))), F.slice("cells", 4, 4))
    ).when(F.col("doc_id") % 4 == 1, F.concat(F.array(part(0), tail), F.slice("cells", 4, 4))).otherwise(F.col("cells")))


def _split_step(source: str, target: str, col: str) -> str:
    """One pass of the split at a column known from the gluing (null: none)."""
    rx = S.q(V.DATE_THEN_TEXT)
    cell = "trim(cells[sc])"
    return f""",
{target}_col AS (SELECT *, {col} AS sc FROM {source}),
{target}_n AS (
  SELECT doc_id, count(*) FILTER ({cell} <> '') AS n, count(*) FILTER (regexp_matches({cell}, {rx})) AS hits FROM {target}_col GROUP BY 1),
{target} AS (
  SELECT a.doc_id, page, row_no, CASE WHEN sc IS NULL OR n < 3 OR (hits < 6 AND hits / n < 0.5) THEN cells
    WHEN regexp_matches({cell}, {rx}) THEN cells[1:sc-1] || [regexp_extract({cell}, {rx}, 1), regexp_extract({cell}, {rx}, 2)] || cells[sc+1:]
    WHEN len(list_filter(cells, lambda c: trim(c) <> '')) >= 3 AND regexp_matches({cell}, '^\\S+\\s+\\S')
      THEN cells[1:sc-1] || [regexp_extract({cell}, '^(\\S+)', 1), regexp_replace({cell}, '^\\S+\\s+', '')] || cells[sc+1:]
    ELSE cells[1:sc-1] || [cells[sc], ''] || cells[sc+1:] END AS cells
  FROM {target}_col a JOIN {target}_n b ON a.doc_id = b.doc_id)"""


@query("split_leading_date", _GLUED + _split_step("glued", "pass1", "CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END")
       + _split_step("pass1", "pass2", "CASE doc_id % 4 WHEN 0 THEN 2 END") + f"SELECT {_OUT} FROM pass2")
def split_leading_date(spark, sf_dir):
    return _out(T.split_leading_date(_glued(spark, sf_dir)))


# rows of a folded statement: dates with text behind them, dates with a time, prose in one cell
_ANCHORED = LINES + """,
anchored AS (
  SELECT doc_id, page, line_no AS row_no, CASE WHEN NOT regexp_matches(cells[1], '^[0-9]') THEN [array_to_string(list_filter(cells, lambda c: c <> ''), ' ')]
    WHEN doc_id % 3 = 0 THEN [cells[1] || ' ' || cells[3]] || cells[4:7] WHEN doc_id % 3 = 1 THEN [cells[1] || ' 10:30 ' || cells[3]] || cells[4:7]
    ELSE cells END AS cells FROM lines)
"""


def _anchored(spark, sf_dir) -> DataFrame:
    def glued(between):
        return F.concat(F.array(F.concat(F.get("cells", 0), F.lit(between), F.get("cells", 2))), F.slice("cells", 4, 4))

    prose = F.array(F.array_join(F.filter("cells", lambda c: c != ""), " "))
    return _lines(spark, sf_dir).withColumn("cells", F.when(~F.get("cells", 0).rlike("^[0-9]"), prose).when(
        F.col("doc_id") % 3 == 0, glued(" ")).when(F.col("doc_id") % 3 == 1, glued(" 10:30 ")).otherwise(F.col("cells")))


_CUT = f"regexp_extract(trim(cells[1]), {S.q(V.DATE_PREFIX)})"


@query("split_anchor_date", _ANCHORED + f""",
parted AS (SELECT *, len(cells) > 1 AS wide, trim({_CUT}) AS dt, trim(substr(trim(cells[1]), length({_CUT}) + 1)) AS rest FROM anchored),
counted AS (SELECT *, count(*) FILTER (wide) OVER (PARTITION BY doc_id) AS n,
  count(*) FILTER (wide AND dt <> '' AND rest <> '' AND NOT regexp_matches(rest, {S.q(V.TIME_FIRST)})) OVER (PARTITION BY doc_id) AS hits FROM parted)
SELECT doc_id, page, row_no, array_to_string(CASE WHEN NOT wide OR n = 0 OR hits < n * 0.5 THEN cells
  WHEN dt <> '' THEN [dt, rest] || cells[2:] ELSE [cells[1], ''] || cells[2:] END, '|') AS cells FROM counted""")
def split_anchor_date(spark, sf_dir):
    rows = _anchored(spark, sf_dir)
    return _out(T.split_anchor_date(rows, date_anchor_column(rows)))


@query("detect_header_row", _LATER + f""",
facts AS (SELECT *, len(list_filter(cells, lambda c: {S.is_number_sql('c')} AND {S.date4_sql('c')} IS NULL)) > 0 AS num,
    len(list_filter(cells, lambda c: c <> '')) AS filled FROM later),
bounded AS (SELECT *, min((page, row_no)) FILTER (num) OVER (PARTITION BY doc_id) AS first_num FROM facts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY filled DESC, page, row_no) AS r FROM bounded
  WHERE NOT num AND filled > 2 AND (first_num IS NULL OR (page, row_no) < first_num))
SELECT {_OUT} FROM ranked WHERE r = 1""")
def detect_header_row(spark, sf_dir):
    return _out(T.detect_header_row(_later(spark, sf_dir)))


@query("concat_grids", _JAMMED + """,
widths AS (SELECT *, max(len(cells)) OVER (PARTITION BY doc_id) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY page, row_no) AS nr FROM jammed)
SELECT doc_id, page, row_no, nr AS "row", array_to_string(cells, '|') || repeat('|', w - len(cells)) AS cells FROM widths""")
def concat_grids(spark, sf_dir):
    return _out(T.concat_grids(_jammed(spark, sf_dir)), "row")


# --- writing -----------------------------------------------------------------

@query("write_tables", _LATER + """,
full_rows AS (SELECT DISTINCT doc_id, cells AS sig FROM later WHERE page = 1 AND len(list_filter(cells, lambda c: trim(c) <> '')) >= len(cells) - 1),
seen AS (SELECT r.*, f.sig IS NOT NULL AS rep FROM later r LEFT JOIN full_rows f ON r.doc_id = f.doc_id AND r.cells = f.sig),
firsts AS (SELECT *, min(row_no) FILTER (NOT rep) OVER (PARTITION BY doc_id, page) AS start FROM seen),
kept AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, row_no) AS nr, cells FROM firsts WHERE page = 1 OR row_no >= start)
SELECT doc_id, page, nr AS "row", array_to_string(list_transform(cells, lambda c: CASE WHEN contains(c, ',') THEN '"' || c || '"' ELSE c END), ',') AS line FROM kept""")
def write_tables(spark, sf_dir):
    """Writes the stacked tables as CSV lines and reads them back."""
    path = new_folder(spark, "tables")
    sinks.write_tables(_later(spark, sf_dir), path, layout="one", fmt="csv", buckets=8)
    return spark.read.option("header", True).option("escape", '"').schema("doc_id long, page int, row long, line string").csv(path).select(
        "doc_id", "page", "row", "line")


@query("write_tables_per_page", _LATER + f"SELECT {_OUT} FROM later")
def write_tables_per_page(spark, sf_dir):
    path = new_folder(spark, "tables")
    sinks.write_tables(_later(spark, sf_dir), path, layout="per_page", buckets=8)
    return _out(spark.read.parquet(path).withColumnRenamed("row", "row_no"))


# --- whole chains ------------------------------------------------------------

@query("words_to_ledger")
def words_to_ledger_query(spark, sf_dir):
    """Words to checked ledgers over all geometries; compared with the printed rows in the tests."""
    best, _ = words_to_ledger(X.words(spark, sf_dir))
    return best.select("doc_id", "ord", "n_rows", "n_ok", "n_bad", "n_missing", "strict", "confidence",
                       (F.col("closing") * 100).cast("long").alias("closing_p"))


@query("words_to_tables")
def words_to_tables_query(spark, sf_dir):
    return _out(words_to_tables(X.words(spark, sf_dir)))


@query("page_tables")
def page_tables_query(spark, sf_dir):
    """The best layout of every page, whitespace against rules; tests compare it with a plain tournament."""
    return _out(page_tables(X.words(spark, sf_dir), X.rules(spark, sf_dir)), "engine")


@query("record_tables")
def record_tables_query(spark, sf_dir):
    """Ruled documents by their rules, others as dated records; tests compare it with printed records."""
    return _out(record_tables(X.words(spark, sf_dir), X.rules(spark, sf_dir)))


@query("convert_documents")
def convert_documents_query(spark, sf_dir):
    """One report row per document; tests compare it with the printed statements and tables."""
    report, _, _ = convert_documents(X.words(spark, sf_dir), X.rules(spark, sf_dir))
    return report.withColumns({"engines": F.array_join("engines", ","), "warnings": F.array_join("warnings", ",")})
