"""Ledger queries: continuity, summaries, line roles, reconstruction, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagetables.functions import fixed_values as V
from pagetables.functions.cells import format_indian
from pagetables.operators import ledger as L, quality as Q
from pagetables.plans.statements import lines_to_ledger
from pagetables.sources import sinks
from pagetables.session import new_folder, stored
from workloads import fixtures as X, sql as S
from workloads.registry import query

PAISE = dict(debit="debit_p", credit="credit_p", balance="balance_p")


def checked_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.check_continuity(X.ledger(spark, sf_dir), opening="opening_p", tolerance=1, **PAISE)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.statement_summary(checked_ledger(spark, sf_dir), opening="opening_p", **PAISE)


@query("check_continuity", S.CHECKED + """
SELECT account_id, seq, debit_p, credit_p, balance_p, previous, verdict FROM checked""")
def check_continuity(spark, sf_dir):
    return checked_ledger(spark, sf_dir).select(
        "account_id", "seq", "debit_p", "credit_p", "balance_p", "previous", "verdict")


_SUMMARY_COLS = ["account_id", "n_rows", "opening", "closing", "total_debits", "total_credits", "n_ok", "n_bad",
                 "n_missing", "confidence", "strict"]


@query("statement_summary", S.SUMMARY + f"SELECT {', '.join(_SUMMARY_COLS)} FROM summary")
def statement_summary(spark, sf_dir):
    return summaries(spark, sf_dir).select(*_SUMMARY_COLS)


@query("statement_warnings", S.SUMMARY + """
SELECT account_id, 1 AS ord, n_missing || ' row(s) have no readable balance — flagged for review.' AS warning FROM summary WHERE n_missing > 0
UNION ALL SELECT account_id, 2, n_bad || ' row(s) failed balance continuity — flagged in the Validation sheet. Verify these against the source PDF.'
FROM summary WHERE n_bad > 0""")
def statement_warnings(spark, sf_dir):
    return L.warnings(summaries(spark, sf_dir))


@query("review_rows", S.CHECKED + "SELECT account_id, seq, balance_p, verdict FROM checked WHERE verdict IN ('bad', 'missing')")
def review_rows(spark, sf_dir):
    return L.review_rows(checked_ledger(spark, sf_dir)).select("account_id", "seq", "balance_p", "verdict")


@query("review_report", S.CHECKED + """
, flagged AS (SELECT *, CASE WHEN verdict IN ('bad', 'missing') THEN 'CHECK' ELSE '' END AS review FROM checked)
SELECT account_id, review, count(*) AS n_rows, CAST(sum(coalesce(debit_p, 0)) AS BIGINT) AS total_debits,
  CAST(sum(coalesce(credit_p, 0)) AS BIGINT) AS total_credits, CAST(grouping(account_id, review) AS INTEGER) AS level
FROM flagged GROUP BY ROLLUP (account_id, review)""")
def review_report(spark, sf_dir):
    return L.review_report(checked_ledger(spark, sf_dir), debit="debit_p", credit="credit_p")


@query("validation_report", S.SUMMARY + """
SELECT account_id, unnest(generate_series(0, 8)) AS ord,
  unnest(['Transactions extracted', 'Opening balance', 'Closing balance', 'Total withdrawals (Dr)', 'Total deposits (Cr)',
    'Balance-continuity checks passed', 'Balance-continuity checks FAILED', 'Continuity confidence', 'Rows needing manual review']) AS item,
  unnest([CAST(n_rows AS VARCHAR), coalesce(CAST(opening AS VARCHAR), 'not found'), coalesce(CAST(closing AS VARCHAR), 'not found'),
    CAST(total_debits AS VARCHAR), CAST(total_credits AS VARCHAR), CAST(n_ok AS VARCHAR), CAST(n_bad AS VARCHAR),
    CAST(CAST(confidence AS DECIMAL(9, 1)) AS VARCHAR) || '%', CAST(n_bad + n_missing AS VARCHAR)]) AS value
FROM summary""")
def validation_report(spark, sf_dir):
    return L.validation_report(summaries(spark, sf_dir))


@query("portfolio_health", S.SUMMARY + """
SELECT count(*) AS n_statements, count(*) FILTER (n_ok = n_rows) AS n_clean,
  round(avg(CASE WHEN n_ok = n_rows THEN 1 ELSE 0 END), 4) AS clean_share,
  CAST(sum(n_bad + n_missing) AS BIGINT) AS review_backlog, round(avg(strict), 2) AS mean_strict, min(strict) AS min_strict FROM summary""")
def portfolio_health(spark, sf_dir):
    return L.portfolio_health(summaries(spark, sf_dir))[0]


@query("portfolio_worst", S.SUMMARY + """
SELECT account_id, n_rows, n_bad, n_missing, strict FROM summary ORDER BY strict, n_rows DESC, account_id LIMIT 10""")
def portfolio_worst(spark, sf_dir):
    return L.portfolio_health(summaries(spark, sf_dir))[1].select("account_id", "n_rows", "n_bad", "n_missing", "strict")


@query("pick_statement", S.SUMMARY + """
, candidates AS (
  SELECT account_id AS doc_id, 0 AS ord, 'lines' AS tag, strict, confidence, n_rows FROM summary
  UNION ALL SELECT account_id, 1, 'shifted', CASE WHEN account_id % 3 = 0 THEN strict ELSE 0.0 END, confidence, n_rows FROM summary
  UNION ALL SELECT account_id, 2, 'longer', strict, confidence, CASE WHEN account_id % 4 = 0 THEN n_rows + 1 ELSE n_rows END FROM summary),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY strict DESC, confidence DESC, n_rows DESC, ord) AS r FROM candidates)
SELECT doc_id, ord, tag, strict, confidence, n_rows FROM ranked WHERE r = 1""")
def pick_statement(spark, sf_dir):
    s = summaries(spark, sf_dir).select(F.col("account_id").alias("doc_id"), "strict", "confidence", "n_rows")
    key = F.col("doc_id")
    versions = F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("lines").alias("tag"), F.col("strict").alias("strict"), F.col("n_rows").alias("n_rows")),
        F.struct(F.lit(1).alias("ord"), F.lit("shifted").alias("tag"), F.when(key % 3 == 0, F.col("strict")).otherwise(0.0).alias("strict"), F.col("n_rows").alias("n_rows")),
        F.struct(F.lit(2).alias("ord"), F.lit("longer").alias("tag"), F.col("strict").alias("strict"), F.when(key % 4 == 0, F.col("n_rows") + 1).otherwise(F.col("n_rows")).alias("n_rows")),
    )).alias("v")
    candidates = s.select("doc_id", "confidence", versions).select("doc_id", "v.ord", "v.tag", "v.strict", "confidence", "v.n_rows")
    return L.pick_statement(candidates)


@query("format_indian", S.LEDGER + f"""
SELECT account_id, seq, {S.money_sql('balance_p')} AS balance, {S.money_sql('debit_p')} AS debit FROM ledger""")
def format_indian_query(spark, sf_dir):
    book = X.ledger(spark, sf_dir)
    rupees = {c: F.coalesce(format_indian((F.col(p).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)"))), F.lit(""))
              for c, p in (("balance", "balance_p"), ("debit", "debit_p"))}
    return book.select("account_id", "seq", *[v.alias(c) for c, v in rupees.items()])


# --- lines to ledger ---------------------------------------------------------

LINES = S.lines_sql()
_HEADERS = """,
header AS (SELECT doc_id, min((page, line_no)) AS top_at FROM lines WHERE cells[1] = 'Date' GROUP BY doc_id)
"""


@query("match_headers", LINES + """
SELECT doc_id, page, line_no, 'date||particulars|ref|debit|credit|balance' AS names FROM lines WHERE cells[1] = 'Date'""")
def match_headers(spark, sf_dir):
    found = L.match_headers(X.statement_lines(spark, sf_dir)).where("names is not null")
    return found.select("doc_id", "page", "line_no", F.array_join("names", "|").alias("names"))


@query("find_header", LINES + """
SELECT doc_id, min(page) AS header_page, arg_min(line_no, page) AS header_line, 7 AS n_cols FROM lines WHERE cells[1] = 'Date' GROUP BY doc_id""")
def find_header(spark, sf_dir):
    return L.find_header(X.statement_lines(spark, sf_dir)).select("doc_id", "header_page", "header_line", "n_cols")


_KINDS = LINES + _HEADERS + f""",
body AS (SELECT l.* FROM lines l JOIN header h ON l.doc_id = h.doc_id WHERE (l.page, l.line_no) > h.top_at),
body_cells AS (SELECT doc_id, unnest(generate_series(0, 6)) AS col, unnest(cells) AS text FROM body),
kinds AS (
  SELECT doc_id, col, count(*) FILTER (text <> '') AS n,
    count(*) FILTER ({S.date4_sql('text')} IS NOT NULL) AS n_date, count(*) FILTER ({S.is_number_sql('text')}) AS n_number
  FROM body_cells GROUP BY 1, 2),
named_kinds AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n_date / n >= 0.6 THEN 'date' WHEN n_number / n >= 0.6 THEN 'amount' ELSE 'text' END AS kind FROM kinds)
"""


@query("column_kinds", _KINDS + "SELECT doc_id, col, n, n_date, n_number, kind FROM named_kinds")
def column_kinds(spark, sf_dir):
    lines = X.statement_lines(spark, sf_dir)
    return L.column_kinds(L.body_lines(L.marked_cells(lines), L.find_header(lines))).select("doc_id", "col", "n", "n_date", "n_number", "kind")


# with bled dates the first column is no date column, so the name from the header stays on it
@query("repair_mapping", _KINDS + """
SELECT doc_id,
  CASE WHEN max(kind) FILTER (col = 0) = 'amount' THEN '' ELSE 'date' END || '|' ||
  CASE WHEN max(kind) FILTER (col = 1) = 'date' THEN 'value_date' ELSE '' END || '|particulars|ref|' ||
  CASE WHEN max(kind) FILTER (col = 4) = 'date' THEN '' ELSE 'debit' END || '|' ||
  CASE WHEN max(kind) FILTER (col = 5) = 'date' THEN '' ELSE 'credit' END || '|balance' AS mapping
FROM named_kinds GROUP BY doc_id""")
def repair_mapping(spark, sf_dir):
    lines = X.statement_lines(spark, sf_dir)
    header = stored(L.find_header(lines), "header")
    return L.repair_mapping(header, L.column_kinds(L.body_lines(L.marked_cells(lines), header))).select(
        "doc_id", F.array_join("mapping", "|").alias("mapping"))


_ROLES = LINES + _HEADERS + f""",
joined AS (SELECT l.*, h.top_at, trim(array_to_string(cells, ' ')) AS joined FROM lines l JOIN header h ON l.doc_id = h.doc_id),
roles AS (
  SELECT *, CASE WHEN (page, line_no) < top_at THEN 'preamble' WHEN (page, line_no) = top_at THEN 'header' WHEN joined = '' THEN 'blank'
    WHEN regexp_matches(joined, {S.q(V.OPENING_LINE)}) THEN 'opening' WHEN regexp_matches(joined, {S.q(V.SKIP_LINE)}) THEN 'skip'
    WHEN cells[1] = 'Date' THEN 'repeat' ELSE 'work' END AS role FROM joined)
"""


@query("split_lines", _ROLES + f"""
SELECT doc_id, page, line_no, role, CASE WHEN role = 'opening' THEN CAST({S.number_sql('cells[7]')} * 100 AS BIGINT) END AS opening_p FROM roles""")
def split_lines(spark, sf_dir):
    lines = X.statement_lines(spark, sf_dir)
    roles = L.split_lines(lines, L.find_header(lines))
    return roles.select("doc_id", "page", "line_no", "role", (F.col("opening") * 100).cast("long").alias("opening_p"))


@query("opening_balances", LINES + """
SELECT DISTINCT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 10000000 + doc_id * 100 END AS opening_p FROM lines""")
def opening_balances(spark, sf_dir):
    lines = X.statement_lines(spark, sf_dir)
    roles = L.split_lines(lines, L.find_header(lines))
    return L.opening_balances(roles).select("doc_id", (F.col("opening") * 100).cast("long").alias("opening_p"))


@query("preamble", _ROLES + "SELECT doc_id, page, line_no, joined AS text FROM roles WHERE role = 'preamble' AND joined <> ''")
def preamble(spark, sf_dir):
    lines = X.statement_lines(spark, sf_dir)
    return L.preamble(L.split_lines(lines, L.find_header(lines)))


def _named(spark, sf_dir):
    lines = X.statement_lines(spark, sf_dir)
    header = stored(L.find_header(lines), "header")
    mapping = L.repair_mapping(header, L.column_kinds(L.body_lines(L.marked_cells(lines), header)))
    return stored(L.named_cells(L.split_lines(lines, header), mapping), "named")


# brute force: every line against every dated line of its document, the first nearest wins
@query("nearest_anchor", _ROLES + f""",
work AS (SELECT *, y + 1000.0 * (page - 1) AS h, {S.date4_sql("split_part(cells[1], ' ', 1)")} IS NOT NULL AS anchor FROM roles WHERE role = 'work'),
paired AS (
  SELECT w.doc_id, w.page, w.line_no, a.page AS anchor_page, a.line_no AS anchor_line,
    row_number() OVER (PARTITION BY w.doc_id, w.page, w.line_no ORDER BY abs(w.h - a.h), a.h) AS r
  FROM work w JOIN work a ON w.doc_id = a.doc_id AND a.anchor WHERE NOT w.anchor)
SELECT doc_id, page, line_no, anchor_page, anchor_line FROM paired WHERE r = 1
UNION ALL SELECT doc_id, page, line_no, page, line_no FROM work WHERE anchor""")
def nearest_anchor(spark, sf_dir):
    return L.nearest_anchor(_named(spark, sf_dir)).select(
        "doc_id", "page", "line_no", F.col("anchor.page").alias("anchor_page"), F.col("anchor.line_no").alias("anchor_line"))


# the truth: the rows the statements were printed from
@query("fold_transactions", S.LEDGER + """
SELECT account_id AS doc_id, seq, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y-%m-%d') AS value_date,
  CASE WHEN account_id % 2 = 0 THEN 'BATCH ' || (o_orderkey % 1000) || ' NOTE ' ELSE '' END || 'TXN/' || o_orderkey || '/' || left(o_orderpriority, 1)
    || CASE WHEN account_id % 2 = 1 THEN ' BATCH ' || (o_orderkey % 1000) || ' NOTE' ELSE '' END AS particulars,
  trim(CASE WHEN account_id % 5 = 0 THEN '123456 ' ELSE '' END || CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderkey + 100000 AS VARCHAR) ELSE '' END) AS ref,
  debit_p, credit_p, balance_p, 2 AS n_lines
FROM ledger""")
def fold_transactions(spark, sf_dir):
    rows = L.number_rows(stored(L.fold_transactions(L.nearest_anchor(_named(spark, sf_dir))), "folded"))
    return rows.select(
        "doc_id", "seq", F.col("date").cast("string").alias("date"), F.col("value_date").cast("string").alias("value_date"),
        "particulars", "ref", *[(F.col(c) * 100).cast("long").alias(c + "_p") for c in ("debit", "credit", "balance")], "n_lines")


# the whole chain on printed lines; accounts without an opening line start unchecked
@query("lines_to_summary", S.LEDGER + """,
printed AS (SELECT *, CASE WHEN account_id % 7 <> 0 THEN opening_p END AS op FROM ledger),
with_prev AS (
  SELECT *, coalesce(last_value(balance_p IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), op) AS previous FROM printed),
checked AS (
  SELECT *, CASE WHEN balance_p IS NULL THEN 'missing' WHEN previous IS NULL THEN 'unchecked'
    WHEN abs(previous - coalesce(debit_p, 0) + coalesce(credit_p, 0) - balance_p) > 1 THEN 'bad' ELSE 'ok' END AS verdict FROM with_prev)
SELECT account_id AS doc_id, count(*) AS n_rows, max(op) AS opening_p, CAST(sum(coalesce(debit_p, 0)) AS BIGINT) AS debits_p,
  CAST(sum(coalesce(credit_p, 0)) AS BIGINT) AS credits_p, count(*) FILTER (verdict = 'ok') AS n_ok,
  count(*) FILTER (verdict = 'bad') AS n_bad, count(*) FILTER (verdict = 'missing') AS n_missing
FROM checked GROUP BY account_id""")
def lines_to_summary(spark, sf_dir):
    checked = lines_to_ledger(X.statement_lines(spark, sf_dir))
    s = L.statement_summary(checked, key="doc_id")

    def paise(c):
        return (F.col(c) * 100).cast("long")

    return s.select("doc_id", "n_rows", paise("opening").alias("opening_p"), paise("total_debits").alias("debits_p"),
                    paise("total_credits").alias("credits_p"), "n_ok", "n_bad", "n_missing")


_BUNDLE = S.SUMMARY + _ROLES.replace(S.LEDGER, "") + """
SELECT 'ledger' AS part, count(*) AS n, CAST(sum(balance_p) AS BIGINT) AS total FROM checked
UNION ALL SELECT 'validation', 9 * count(*), NULL FROM summary
UNION ALL SELECT 'warnings', count(*) FILTER (n_missing > 0) + count(*) FILTER (n_bad > 0), NULL FROM summary
UNION ALL SELECT 'review_rows', count(*), CAST(sum(balance_p) AS BIGINT) FROM checked WHERE verdict IN ('bad', 'missing')
UNION ALL SELECT 'totals', 1 + count(DISTINCT account_id) + count(DISTINCT (account_id, verdict IN ('bad', 'missing'))),
  CAST(3 * sum(coalesce(debit_p, 0)) AS BIGINT) FROM checked
UNION ALL SELECT 'preamble ' || text, count(*), CAST(sum(doc_id) AS BIGINT) FROM (
  SELECT *, joined AS text FROM roles WHERE role = 'preamble' AND joined <> '') GROUP BY text"""


@query("write_statement_bundle", _BUNDLE)
def write_statement_bundle(spark, sf_dir):
    """Writes the bundle and reads its parts back."""
    checked = checked_ledger(spark, sf_dir).withColumnsRenamed(
        {"debit_p": "debit", "credit_p": "credit", "balance_p": "balance", "opening_p": "opening"})
    path = new_folder(spark, "bundle")
    lines = X.statement_lines(spark, sf_dir)
    roles = L.split_lines(lines, L.find_header(lines))
    for _ in range(2):  # the second call replaces the first
        sinks.write_statement_bundle(checked, path, roles)
    bundle = sinks.read_statement_bundle(spark, path)

    def part(name, total):
        return bundle[name].agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), total.cast("long").alias("total"))

    nothing = F.lit(None)
    heads = bundle["preamble"].groupBy(F.concat(F.lit("preamble "), F.col("text")).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("total"))
    return (
        part("ledger", F.sum("balance")).unionByName(part("validation", F.max(nothing))).unionByName(part("warnings", F.max(nothing)))
        .unionByName(part("review_rows", F.sum("balance"))).unionByName(part("totals", F.sum("total_debits"))).unionByName(heads)
    )


# --- quality -----------------------------------------------------------------

_SCORED = S.SUMMARY + """,
truth AS (
  SELECT account_id, n_rows + CASE WHEN account_id % 9 = 0 THEN 2 ELSE 0 END AS t_n_rows, total_debits AS t_total_debits,
    total_credits AS t_total_credits, closing + CASE WHEN account_id % 11 = 0 THEN 5 ELSE 0 END AS t_closing, opening AS t_opening FROM totals),
scored AS (
  SELECT s.account_id,
    least(100.0, round(greatest(0, 30 - 3 * abs(n_rows - t_n_rows)) + 12.5 + 12.5
      + CASE WHEN closing = t_closing THEN 12.5 ELSE 0 END + 12.5 + 20 * (confidence / 100.0), 1)) AS score,
    concat_ws('; ', CASE WHEN n_rows <> t_n_rows THEN 'rows ' || n_rows || '/' || t_n_rows END,
      CASE WHEN closing IS DISTINCT FROM t_closing OR closing IS NULL THEN 'closing=' || coalesce(CAST(closing AS VARCHAR), 'None') || ' gt=' || t_closing END) AS note
  FROM summary s JOIN truth t ON s.account_id = t.account_id),
scores AS (SELECT account_id, score, CASE WHEN note = '' THEN 'exact' ELSE note END AS note FROM scored)
"""


@query("score_against_truth", _SCORED + "SELECT account_id, score, note FROM scores")
def score_against_truth(spark, sf_dir):
    return Q.score_against_truth(summaries(spark, sf_dir), X.truth(spark, sf_dir))


@query("quality_summary", _SCORED + """
SELECT count(*) AS n_tests, round(avg(score), 1) AS mean_score, min(score) AS min_score, count(*) FILTER (note = 'exact') AS n_exact FROM scores""")
def quality_summary(spark, sf_dir):
    return Q.quality_summary(score_against_truth(spark, sf_dir))
