"""DuckDB text of the derived input tables, for the side-by-side checks."""

from __future__ import annotations

from pagetables.functions import fixed_values as V
from pagetables.functions.cells import MONEY
from workloads import fixtures as X


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def number_sql(c: str) -> str:
    """Amount of a text as DECIMAL(38,4), null when it is none."""
    s = f"rtrim(regexp_replace({c}, {q(V.CURRENCY + r'|^\s+|\s+$')}, '', 'g'))"
    value = f"TRY_CAST(regexp_replace(regexp_replace({s}, '[^0-9.]', '', 'g'), '[.]$', '') AS DECIMAL(38,4))"
    negative = f"((regexp_matches({s}, '(?i)^[(]') OR regexp_matches({s}, '(?i)dr[.]?$')) <> regexp_matches({s}, '^[(]?\\s*-'))"
    return f"CASE WHEN regexp_matches({s}, {q(MONEY)}) THEN CASE WHEN {negative} THEN -({value}) ELSE {value} END END"


def is_number_sql(c: str) -> str:
    return f"coalesce({number_sql(c)} IS NOT NULL, false)"


DATE_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "%d/%m/%Y"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "%d-%m-%Y"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "%d/%m/%y"), (r"^\d{1,2}-\d{1,2}-\d{2}$", "%d-%m-%y"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "%d-%b-%Y"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "%d %b %Y"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "%d-%b-%y"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%d.%m.%Y"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"), (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "%d %B %Y"),
]


def date_sql(c: str, formats=DATE_FORMATS) -> str:
    s = f"trim({c})"
    tries = ", ".join(
        f"CASE WHEN regexp_matches({s}, {q(rx)}) THEN CAST(try_strptime({s}, {q(f)}) AS DATE) END" for rx, f in formats)
    return f"coalesce({tries}, NULL)"


PLAIN_DATES = DATE_FORMATS[:1]


def date4_sql(c: str) -> str:
    """Only the layout the printed statements use."""
    return date_sql(c, PLAIN_DATES)


def money_sql(p: str) -> str:
    w = f"CAST(abs({p})//100 AS VARCHAR)"
    head = f"reverse(rtrim(regexp_replace(reverse(left({w}, length({w})-3)), '(\\d\\d)', '\\1,', 'g'), ','))"
    return (
        f"CASE WHEN {p} IS NULL THEN '' ELSE CASE WHEN {p} < 0 THEN '-' ELSE '' END || "
        f"CASE WHEN length({w}) <= 3 THEN {w} ELSE {head} || ',' || right({w}, 3) END || '.' || "
        f"lpad(CAST(abs({p})%100 AS VARCHAR), 2, '0') END")


LEDGER = """
moved AS (
  SELECT o_custkey AS account_id, o_orderkey, o_orderdate, o_orderpriority,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
    CASE WHEN o_orderkey % 20 < 11 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS debit_p,
    CASE WHEN o_orderkey % 20 >= 11 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS credit_p,
    10000000 + o_custkey * 100 AS opening_p,
    10000000 + o_custkey * 100 + CAST(sum(CASE WHEN o_orderkey % 20 < 11 THEN -CAST(round(o_totalprice * 100) AS BIGINT)
        ELSE CAST(round(o_totalprice * 100) AS BIGINT) END)
      OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS true_bal
  FROM orders),
ledger AS (
  SELECT account_id, seq, o_orderkey, o_orderdate, o_orderpriority, opening_p, debit_p, credit_p,
    CASE WHEN o_orderkey % 89 = 7 THEN NULL WHEN o_orderkey % 97 = 13 THEN true_bal + 2
      WHEN o_orderkey % 97 = 14 THEN true_bal + 1 ELSE true_bal END AS balance_p
  FROM moved)
"""

CHECKED = LEDGER + """,
with_prev AS (
  SELECT *, coalesce(last_value(balance_p IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), opening_p) AS previous FROM ledger),
checked AS (
  SELECT *, CASE WHEN balance_p IS NULL THEN 'missing' WHEN previous IS NULL THEN 'unchecked'
    WHEN abs(previous - coalesce(debit_p, 0) + coalesce(credit_p, 0) - balance_p) > 1 THEN 'bad' ELSE 'ok' END AS verdict
  FROM with_prev)
"""

SUMMARY = CHECKED + """,
totals AS (
  SELECT account_id, count(*) AS n_rows, max(opening_p) AS opening, arg_max(balance_p, seq) FILTER (balance_p IS NOT NULL) AS closing,
    CAST(sum(coalesce(debit_p, 0)) AS BIGINT) AS total_debits, CAST(sum(coalesce(credit_p, 0)) AS BIGINT) AS total_credits,
    count(*) FILTER (verdict = 'ok') AS n_ok, count(*) FILTER (verdict = 'bad') AS n_bad,
    count(*) FILTER (verdict = 'missing') AS n_missing
  FROM checked GROUP BY account_id),
summary AS (
  SELECT *, CASE WHEN n_ok + n_bad > 0 THEN round(100.0 * n_ok / (n_ok + n_bad), 1) ELSE 0.0 END AS confidence,
    round(100.0 * n_ok / n_rows, 1) AS strict FROM totals)
"""


def lines_sql(footer: bool = True, bleeding: bool = True) -> str:
    """CTEs up to lines(doc_id, page, line_no, y, cells)."""
    day = "strftime(o_orderdate, '%d/%m/%Y')"
    first = f"CASE WHEN account_id % 5 = 0 THEN {day} || ' 123456' ELSE {day} END" if bleeding else day
    empty6 = ", '', '', '', '', '', ''"
    footer_sql = f"""
  UNION ALL SELECT account_id, page, 985.0, ['Page ' || page || ' of ' || n_pages{empty6}] FROM acc_pages""" if footer else ""
    header = ", ".join(q(h) for h in X.HEADER)
    return LEDGER + f""",
acc AS (SELECT account_id, CAST((max(seq) + 7) // 8 AS INTEGER) AS n_pages, max(opening_p) AS opening_p FROM ledger GROUP BY 1),
acc_pages AS (SELECT *, CAST(unnest(generate_series(1, n_pages)) AS INTEGER) AS page FROM acc),
raw_lines(doc_id, page, y, cells) AS (
  SELECT account_id, CAST((seq - 1) // 8 + 1 AS INTEGER), CAST(80 + 36 * ((seq - 1) % 8) + CASE WHEN account_id % 2 = 0 THEN 12 ELSE 0 END AS DOUBLE),
    [{first}, {day}, 'TXN/' || o_orderkey || '/' || left(o_orderpriority, 1),
     CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderkey + 100000 AS VARCHAR) ELSE '' END,
     {money_sql('debit_p')}, {money_sql('credit_p')}, {money_sql('balance_p')}] FROM ledger
  UNION ALL SELECT account_id, CAST((seq - 1) // 8 + 1 AS INTEGER), CAST(80 + 36 * ((seq - 1) % 8) + CASE WHEN account_id % 2 = 0 THEN 0 ELSE 12 END AS DOUBLE),
    ['', '', 'BATCH ' || (o_orderkey % 1000) || ' NOTE', '', '', '', ''] FROM ledger
  UNION ALL SELECT account_id, page, 20.0, ['ACCOUNT ' || account_id || ' STATEMENT OF ACCOUNT'{empty6}] FROM acc_pages WHERE page = 1
  UNION ALL SELECT account_id, page, 32.0, ['Branch Main Road City'{empty6}] FROM acc_pages WHERE page = 1
  UNION ALL SELECT account_id, page, 44.0, [{header}] FROM acc_pages WHERE page = 1 OR account_id % 3 = 0
  UNION ALL SELECT account_id, page, 56.0, ['', '', 'OPENING BALANCE', '', '', '', {money_sql('opening_p')}] FROM acc_pages
    WHERE page = 1 AND account_id % 7 <> 0{footer_sql}),
lines AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y) AS line_no, y, cells FROM raw_lines)
"""


def words_sql() -> str:
    """CTEs up to words(doc_id, page, word_no, x0, x1, top, bottom, text)."""
    xs = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in X.COLUMN_X) + "]"
    return lines_sql(footer=False, bleeding=False) + f""",
cell_rows AS (SELECT doc_id, page, y, unnest(generate_series(0, 6)) AS col, cells FROM lines),
cell_texts AS (SELECT doc_id, page, y, col, cells[col + 1] AS text FROM cell_rows WHERE cells[col + 1] <> ''),
cell_starts AS (
  SELECT *, CASE WHEN col >= 4 THEN {xs}[col + 1] - 4 * length(text) ELSE {xs}[col + 1] END AS start,
    string_split(text, ' ') AS parts FROM cell_texts),
word_parts AS (SELECT *, unnest(generate_series(1, len(parts))) AS k FROM cell_starts),
placed AS (
  SELECT doc_id, page, y, col, k, parts[k] AS word,
    start + 4 * CASE WHEN k = 1 THEN 0 ELSE length(array_to_string(parts[1:k-1], ' ')) + 1 END AS x0 FROM word_parts),
words AS (
  SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, col, k) AS word_no, x0, x0 + 4 * length(word) AS x1,
    y AS top, y + 8 AS bottom, word AS text FROM placed)
"""


# words of a line are those of one height: the drawn lines never overlap
LINE_WORDS = """,
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY top) AS line_no FROM words),
gapped AS (
  SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, page, line_no ORDER BY x0) AS gap FROM numbered),
line_stats AS (
  SELECT doc_id, page, line_no, min(top) AS top, count(*) AS n_words, max(gap) AS biggest,
    count(*) FILTER (gap >= 6.0) AS g6, count(*) FILTER (gap >= 7.0) AS g7, count(*) FILTER (gap >= 11.0) AS g11
  FROM gapped GROUP BY 1, 2, 3)
"""


def seps_sql(scope: str = "document") -> str:
    """CTEs up to seps(key..., min_gap, share, sep), from a full bin-by-bin coverage count."""
    k = "doc_id" if scope == "document" else "doc_id, page"
    on = " AND ".join(f"a.{c} = b.{c}" for c in k.split(", "))
    ak = ", ".join("a." + c for c in k.split(", "))
    return LINE_WORDS + f""",
gap_list(min_gap, flo) AS (VALUES (4.0::DOUBLE, 6), (7.0::DOUBLE, 7), (11.0::DOUBLE, 11)),
share_list(share) AS (VALUES (0.08::DOUBLE), (0.2::DOUBLE)),
key_stats AS (
  SELECT {k}, min_gap, flo, count(*) FILTER (CASE flo WHEN 6 THEN g6 WHEN 7 THEN g7 ELSE g11 END >= 2) AS n_tab,
    count(*) FILTER (n_words > 1) AS n_multi, count(*) AS n_all
  FROM line_stats CROSS JOIN gap_list GROUP BY {k}, min_gap, flo),
span_stats AS (SELECT {k}, CAST(floor(min(x0) / 2) AS INTEGER) AS b0, CAST(floor(max(x1) / 2) AS INTEGER) AS b1 FROM words GROUP BY {k}),
basis AS (
  SELECT {ak}, b.page AS line_page, b.line_no, a.min_gap,
    CASE WHEN n_tab >= 3 THEN n_tab WHEN n_multi >= 2 THEN n_multi ELSE n_all END AS n
  FROM key_stats a JOIN line_stats b ON {on}
  WHERE CASE WHEN n_tab >= 3 THEN CASE flo WHEN 6 THEN g6 WHEN 7 THEN g7 ELSE g11 END >= 2 WHEN n_multi >= 2 THEN n_words > 1 ELSE true END),
bins AS (
  SELECT {ak.replace('a.', 's.')}, s.min_gap, s.n, unnest(generate_series(CAST(floor(w.x0 / 2) AS INTEGER), CAST(floor(w.x1 / 2) AS INTEGER))) AS bin
  FROM basis s JOIN numbered w ON s.doc_id = w.doc_id AND s.line_page = w.page AND s.line_no = w.line_no),
counted AS (SELECT {k}, min_gap, n, bin, count(*) AS c FROM bins GROUP BY ALL),
all_bins AS (
  SELECT {ak}, a.min_gap, CASE WHEN n_tab >= 3 THEN n_tab WHEN n_multi >= 2 THEN n_multi ELSE n_all END AS n,
    unnest(generate_series(b.b0, b.b1)) AS bin FROM key_stats a JOIN span_stats b ON {on}),
cover AS (
  SELECT {ak}, a.min_gap, share, a.bin, coalesce(b.c, 0) <= greatest(1, floor(a.n * share)) AS low
  FROM all_bins a CROSS JOIN share_list LEFT JOIN counted b ON {on} AND a.min_gap = b.min_gap AND a.bin = b.bin),
islands AS (
  SELECT *, bin - row_number() OVER (PARTITION BY {k}, min_gap, share, low ORDER BY bin) AS island,
    max(bin) FILTER (NOT low) OVER (PARTITION BY {k}, min_gap, share) AS last_high FROM cover),
runs AS (SELECT {k}, min_gap, share, island, min(bin) AS a, max(bin) + 1 AS b, max(last_high) AS last_high FROM islands WHERE low GROUP BY ALL),
seps AS (SELECT {k}, min_gap, share, (a + b) / 2 * 2.0 AS sep FROM runs WHERE b <= last_high AND (b - a) * 2.0 >= min_gap),
sep_lists AS (
  SELECT {ak}, a.min_gap, s.share, coalesce(list_sort(list(b.sep) FILTER (b.sep IS NOT NULL)), []) AS seps
  FROM key_stats a CROSS JOIN share_list s LEFT JOIN seps b ON {on} AND a.min_gap = b.min_gap AND s.share = b.share
  GROUP BY {ak}, a.min_gap, s.share)
"""


# cells of every line for a geometry: sep_lists + line words
ASSIGNED = """,
banded AS (
  SELECT w.doc_id, w.page, w.line_no, g.min_gap, g.share, w.word_no, w.x0, w.text, len(g.seps) AS n_seps,
    len(list_filter(g.seps, lambda s: s <= (w.x0 + w.x1) / 2)) AS own, l.n_words, l.biggest
  FROM numbered w JOIN sep_lists g ON w.doc_id = g.doc_id
  JOIN line_stats l ON w.doc_id = l.doc_id AND w.page = l.page AND w.line_no = l.line_no),
banded2 AS (
  SELECT *, CASE WHEN n_words > 1 AND biggest < greatest(min_gap, 6.0)
    THEN first_value(own) OVER (PARTITION BY doc_id, page, line_no, min_gap, share ORDER BY x0, word_no) ELSE own END AS band FROM banded),
cell_parts AS (
  SELECT doc_id, page, line_no, min_gap, share, band, max(n_seps) AS n_seps, string_agg(text, ' ' ORDER BY x0, word_no) AS text
  FROM banded2 GROUP BY ALL)
"""


def pages_sql() -> str:
    """CTEs up to pages_text(doc_id, source, page, text, image_coverage, ruled_lines)."""
    titles = "[" + ", ".join(q(t) for t in X.TITLES) + "]"
    script = q("क" * 60)
    return f"""
doc_lines AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
doc_pages AS (SELECT doc_id, source, ls, unnest(generate_series(1, (len(ls) + 7) // 8)) AS page FROM doc_lines),
plain_pages AS (SELECT doc_id, source, CAST(page AS INTEGER) AS page, array_to_string(ls[(page-1)*8+1 : page*8], chr(10)) AS text FROM doc_pages),
titled AS (
  SELECT *, CASE WHEN page = 1 AND doc_id % 17 < 16 THEN {titles}[doc_id % 17 + 1] || chr(10) || text ELSE text END AS t FROM plain_pages),
pages_text AS (
  SELECT doc_id, source, page, CASE WHEN doc_id % 30 = 0 THEN {script} WHEN doc_id % 6 = 0 THEN t || chr(10) || {script}
      WHEN (doc_id + page) % 20 = 0 THEN left(text, 10) ELSE t END AS text,
    CASE WHEN (doc_id + page) % 10 = 0 THEN 0.9 ELSE 0.1 END AS image_coverage, CAST(doc_id * page % 9 AS INTEGER) AS ruled_lines
  FROM titled)
"""


SAMPLED = """,
page_counts AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_pages FROM pages_text),
sampled AS (
  SELECT * FROM page_counts WHERE n_pages <= 25 OR page - 1 < 8
    OR (page - 1 >= n_pages // 2 - 2 AND page - 1 < n_pages // 2 + 2) OR page - 1 >= n_pages - 4)
"""

PROFILED = """,
page_prof AS (
  SELECT doc_id, page, length(t) >= 30 AS has_text, length(t) AS text_chars, round(least(1.0, image_coverage), 3) AS image_coverage,
    ruled_lines, length(t) < 30 AND least(1.0, image_coverage) > 0.5 AS is_scanned
  FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM {source}))
"""


def type_sql(text: str) -> str:
    """(key) of the first matching document type."""
    arms = []
    for key, _, alternatives in V.DOC_TYPES:
        test = " OR ".join("(" + " AND ".join(f"regexp_matches({text}, {q('(?is)' + p)})" for p in group) + ")" for group in alternatives)
        arms.append(f"WHEN {test} THEN {q(key)}")
    return "CASE " + " ".join(arms) + " ELSE 'generic' END"


def script_sql(text: str) -> str:
    dev = f"len(regexp_extract_all({text}, '[ऀ-ॿ]'))"
    lat = f"len(regexp_extract_all({text}, '[A-Za-z]'))"
    return f"CASE WHEN {dev} > 50 AND {lat} > 50 THEN 'mixed' WHEN {dev} > {lat} THEN 'devanagari' ELSE 'latin' END"


def gstin_check_sql(stem: str) -> str:
    """Base-36 check character of a 14-character stem."""
    code = f"(instr({q(V.BASE36)}, substr({stem}, i, 1)) - 1) * CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END"
    total = f"list_sum(list_transform(generate_series(1, 14), lambda i: ({code}) // 36 + ({code}) % 36))"
    return f"substr({q(V.BASE36)}, CAST((36 - {total} % 36) % 36 + 1 AS BIGINT), 1)"


def ids_sql() -> str:
    """CTEs up to id_texts(doc_id, page, source, text)."""
    def letter(n: str) -> str:
        return f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(({n}) % 26 + 1 AS BIGINT), 1)"

    return f"""
id_pan AS (
  SELECT c_custkey AS k, c_mktsegment AS source, {letter('c_custkey // 676')} || {letter('c_custkey // 26')} || {letter('c_custkey')} || 'P' ||
    {letter('c_custkey')} || lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0') || {letter('c_custkey * 3')} AS pan FROM customer),
id_stem AS (SELECT *, lpad(CAST(k % 37 + 1 AS VARCHAR), 2, '0') || pan || '1Z' AS stem FROM id_pan),
id_good AS (SELECT *, {gstin_check_sql('stem')} AS good,
    '2' || lpad(CAST(k * 7919 % 10000000000 AS VARCHAR), 10, '0') || CAST(k % 10 AS VARCHAR) AS aad FROM id_stem),
id_all AS (
  SELECT *, stem || CASE WHEN k % 5 = 0 THEN substr({q(V.BASE36)}, instr({q(V.BASE36)}, good) % 36 + 1, 1) ELSE good END AS gstin FROM id_good),
id_texts AS (
  SELECT k AS doc_id, 1 AS page, source,
    'Invoice No: INV-' || k || ' dated 12/03/2024 for Rs. 1,234.50 and INR ' || (k * 3) || chr(10) || 'PAN ' || pan || '  again ' || pan
    || ' GSTIN ' || gstin || chr(10) || 'Aadhaar '
    || CASE WHEN k % 2 = 0 THEN aad[1:4] || ' ' || aad[5:8] || ' ' || aad[9:12] ELSE aad END
    || ' TAN DELA12345F CIN L12345MH2001PLC' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0')
    || ' DIN: ' || lpad(CAST(k % 100000000 AS VARCHAR), 8, '0') || ' IFSC ABCD0' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0')
    || chr(10) || 'mail user' || k || '@example.org phone 98' || lpad(CAST(k % 100000000 AS VARCHAR), 8, '0')
    || ' card 4111 1111 1111 ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS text
  FROM id_all)
"""


# the texts scanned for sensitive values: identifiers and document pages
SCANNED = """,
scanned AS (
  SELECT doc_id, page, source, text FROM id_texts
  UNION ALL SELECT doc_id + 1000000000, page, source, text FROM plain_pages)
"""


def detections_sql(source: str, keys: str, patterns=None) -> str:
    """CTE detections(keys, type, value, conf): all matches of all types."""
    patterns = patterns or V.SENSITIVE_PATTERNS
    parts = [
        f"SELECT {keys}, {q(n)} AS type, unnest(regexp_extract_all(text, {q(p)})) AS value, CAST({c} AS DOUBLE) AS conf FROM {source}"
        for n, p, c in patterns]
    return ",\ndetections AS (" + " UNION ALL ".join(parts) + ")"


def spots_sql(source: str, keys: str, patterns=None) -> str:
    """CTE spots(keys, rank, type, value, conf, s, n): all matches with start and length, from what lies between them."""
    patterns = patterns or V.SENSITIVE_PATTERNS
    lists = " UNION ALL ".join(
        f"SELECT {keys}, {i} AS rank, {q(n)} AS type, CAST({c} AS DOUBLE) AS conf, regexp_extract_all(text, {q(p)}) AS ms, string_split_regex(text, {q(p)}) AS bs FROM {source}"
        for i, (n, p, c) in enumerate(patterns))
    return f""",
match_lists AS ({lists}),
match_nos AS (SELECT *, unnest(generate_series(1, len(ms))) AS k FROM match_lists WHERE len(ms) > 0),
spots AS (
  SELECT {keys}, rank, type, ms[k] AS value, conf,
    list_sum(list_transform(bs[1:k], lambda b: length(b))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda m: length(m))), 0) AS s, length(ms[k]) AS n FROM match_nos)"""


VERSIONS = """
ver_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
ver_pages AS (SELECT doc_id, ls, (len(ls) + 7) // 8 AS n_pages, unnest(generate_series(1, (len(ls) + 7) // 8)) AS page FROM ver_lines),
ver_a AS (SELECT doc_id, page, array_to_string(ls[(page-1)*8+1 : page*8], chr(10)) AS text FROM ver_pages),
ver_numbered AS (SELECT doc_id, n_pages, page, ls, unnest(generate_series((page-1)*8+1, least(page*8, len(ls)))) AS n FROM ver_pages),
ver_b AS (
  SELECT doc_id, page, coalesce(string_agg(CASE WHEN (doc_id + n) % 70 = 1 THEN translate(ls[n], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE ls[n] END, chr(10) ORDER BY n)
      FILTER ((doc_id + n) % 50 <> 0), '') AS text
  FROM ver_numbered WHERE NOT (doc_id % 25 = 0 AND page = n_pages) GROUP BY doc_id, page
  UNION ALL SELECT doc_id, max(n_pages) - CASE WHEN doc_id % 25 = 0 THEN 1 ELSE 0 END + 1, 'one added page' FROM ver_pages WHERE doc_id % 40 = 3 GROUP BY doc_id)
"""

AUDIT = """
audit AS (
  SELECT event_id AS id, ts, event_type AS tool_id, 'run' AS action,
    CASE WHEN event_type = 'error' OR event_id % 29 = 3 THEN 'error' ELSE 'success' END AS status, user_id FROM events)
"""
