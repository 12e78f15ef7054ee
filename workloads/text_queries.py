"""Queries over page texts: profiles, types, scripts, headings, fields, sensitive values, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagetables.functions import fixed_values as V
from pagetables.operators import privacy as E, profile as P
from workloads import fixtures as X, sql as S
from workloads.registry import query

PAGES = S.pages_sql()


# --- profiles ----------------------------------------------------------------

@query("page_profile", PAGES + S.PROFILED.replace("{source}", "pages_text") + """
SELECT doc_id, page, has_text, text_chars, image_coverage, ruled_lines, is_scanned FROM page_prof""")
def page_profile(spark, sf_dir):
    return P.page_profile(X.pages_text(spark, sf_dir))


@query("sample_pages", PAGES + S.SAMPLED + "SELECT doc_id, page, n_pages FROM sampled")
def sample_pages(spark, sf_dir):
    return P.sample_pages(X.pages_text(spark, sf_dir)).select("doc_id", "page", "n_pages")


# five documents chained to one, so that long documents occur
@query("sample_pages_long", PAGES + """,
chained AS (SELECT doc_id // 50 AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id, page) AS INTEGER) AS page FROM pages_text),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_pages FROM chained)
SELECT doc_id, page, n_pages FROM counted WHERE n_pages <= 25 OR page - 1 < 8
  OR (page - 1 >= n_pages // 2 - 2 AND page - 1 < n_pages // 2 + 2) OR page - 1 >= n_pages - 4""")
def sample_pages_long(spark, sf_dir):
    from pagetables.functions.scans import ordered_scan

    pages = X.pages_text(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 50).alias("bundle"), F.col("doc_id").alias("part"), F.col("page").alias("old"))
    chained = ordered_scan(pages, ["bundle"], "part", ["old"], number="page").select(
        F.col("bundle").alias("doc_id"), F.col("page").cast("int").alias("page"))
    return P.sample_pages(chained).select("doc_id", "page", "n_pages")


_DOC_TEXTS = PAGES + """,
doc_texts AS (SELECT doc_id, any_value(source) AS source, count(*) AS n_pages, count(*) AS sampled, string_agg(text, chr(10) ORDER BY page) AS text FROM pages_text GROUP BY 1)
"""


@query("classify_doc_type", _DOC_TEXTS + f"""
SELECT doc_id, {S.type_sql('text')} AS doc_type, {{}} AS doc_type_label FROM doc_texts""".format(
    "CASE " + S.type_sql("text") + " " + " ".join(f"WHEN {S.q(k)} THEN {S.q(n)}" for k, n, _ in V.DOC_TYPES) + f" ELSE {S.q(V.GENERIC_TYPE[1])} END"))
def classify_doc_type(spark, sf_dir):
    return P.document_types(X.pages_text(spark, sf_dir)).select("doc_id", "doc_type", "doc_type_label")


@query("script_hint", _DOC_TEXTS + f"SELECT doc_id, {S.script_sql('text')} AS script FROM doc_texts")
def script_hint(spark, sf_dir):
    return P.document_types(X.pages_text(spark, sf_dir)).select("doc_id", "script")


_PROFILE = _DOC_TEXTS + S.PROFILED.replace("{source}", "pages_text") + f""",
flags AS (SELECT doc_id, bool_or(is_scanned) AS any_scanned, bool_and(is_scanned) AS all_scanned, sum(ruled_lines) AS rl FROM page_prof GROUP BY 1),
typed AS (SELECT *, {S.type_sql('text')} AS doc_type, {S.script_sql('text')} AS script FROM doc_texts),
profiles AS (
  SELECT t.doc_id, n_pages, sampled, any_scanned, all_scanned, any_scanned AS needs_ocr,
    rl >= 12 OR doc_type IN ({', '.join(S.q(t) for t in V.TABULAR_TYPES)}) AS likely_tables, doc_type, script FROM typed t JOIN flags f ON t.doc_id = f.doc_id)
"""
_PROFILE_COLS = ["doc_id", "n_pages", "sampled", "any_scanned", "all_scanned", "needs_ocr", "likely_tables", "doc_type", "script"]


@query("doc_profile", _PROFILE + f"SELECT {', '.join(_PROFILE_COLS)} FROM profiles")
def doc_profile(spark, sf_dir):
    return P.doc_profile(X.pages_text(spark, sf_dir)).select(*_PROFILE_COLS)


@query("class_distribution", _PROFILE + """
SELECT doc_type, script, any_scanned, count(*) AS n_docs, CAST(grouping(doc_type, script, any_scanned) AS INTEGER) AS level,
  round(count(*) / (SELECT count(*) FROM profiles), 6) AS share FROM profiles GROUP BY CUBE (doc_type, script, any_scanned)""")
def class_distribution(spark, sf_dir):
    return P.class_distribution(P.doc_profile(X.pages_text(spark, sf_dir)))


@query("multi_column", S.words_sql() + """,
wide AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 2000.0 ELSE 595.0 END AS pw FROM words),
counts AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER ((x0 + x1) / 2 > pw * 0.40::DOUBLE AND (x0 + x1) / 2 < pw * 0.60::DOUBLE) AS m FROM wide GROUP BY 1, 2)
SELECT doc_id, bool_or(n >= 40 AND m < n * 0.04) AS multi_column FROM counts GROUP BY 1""")
def multi_column(spark, sf_dir):
    width = F.when(F.col("doc_id") % 2 == 0, 2000.0).otherwise(595.0)
    return P.multi_column(X.words(spark, sf_dir).withColumn("page_width", width))


@query("headings", """
doc_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
numbered AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS i, unnest(ls) AS text FROM doc_lines),
spans AS (
  SELECT doc_id, i // 8 + 1 AS page, i % 8 + 1 AS line_no, CASE WHEN i % 8 = 0 THEN 16 WHEN i % 10 = 9 THEN 13 ELSE 11 END AS size,
    CASE WHEN i % 8 = 0 THEN 16 WHEN i % 10 = 9 THEN 2 ELSE 0 END AS flags, text, i FROM numbered),
weights AS (SELECT doc_id, size, sum(length(text)) AS chars, min(i) AS seen FROM spans GROUP BY 1, 2),
body AS (SELECT doc_id, size AS b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, seen) AS r FROM weights) WHERE r = 1)
SELECT s.doc_id, s.page, s.line_no, s.size, s.flags = 16 AS bold, s.flags = 2 AS italic,
  regexp_replace(s.text, '^\\s+|\\s+$', '', 'g') AS text, CASE WHEN s.size >= b + 4 THEN 1 WHEN s.size >= b + 2 THEN 2 ELSE 0 END AS level
FROM spans s JOIN body b ON s.doc_id = b.doc_id WHERE regexp_replace(s.text, '^\\s+|\\s+$', '', 'g') <> ''""")
def headings(spark, sf_dir):
    return P.headings(X.spans(spark, sf_dir)).drop("block_no")


# --- fields and sensitive values ---------------------------------------------

# identifier texts and the paged documents together
SCANNED = S.ids_sql() + ",\n" + PAGES.strip() + S.SCANNED


def scanned(spark, sf_dir) -> DataFrame:
    return X.scanned_texts(spark, sf_dir)


def _fields_sql() -> str:
    parts = []
    for i, (name, pattern, cap) in enumerate(V.FIELD_PATTERNS):
        parts.append(
            f"SELECT doc_id, page, {i} AS fi, {S.q(name)} AS field, unnest(regexp_extract_all(t, {S.q(pattern)})) AS v, "
            f"unnest(generate_series(1, len(regexp_extract_all(t, {S.q(pattern)})))) AS pos, {cap or 1 << 30} AS cap FROM collapsed")
    return SCANNED + """,
collapsed AS (SELECT doc_id, page, ' ' || regexp_replace(text, '\\s+', ' ', 'g') || ' ' AS t FROM scanned),
hits AS (""" + " UNION ALL ".join(parts) + """),
firsts AS (SELECT doc_id, page, field, cap, trim(v) AS value, min(pos) AS pos FROM hits GROUP BY 1, 2, 3, 4, 5),
pans AS (SELECT doc_id, page, value FROM firsts WHERE field = 'PAN'),
kept AS (SELECT f.* FROM firsts f LEFT JOIN pans p ON f.doc_id = p.doc_id AND f.page = p.page AND f.value = p.value AND f.field = 'TAN' WHERE p.value IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, field ORDER BY pos) - 1 AS ord FROM kept)
SELECT doc_id, page, field, ord, value FROM ranked WHERE ord < cap"""


@query("extract_fields", _fields_sql())
def extract_fields(spark, sf_dir):
    return E.extract_fields(scanned(spark, sf_dir).drop("source"))


_DETECTED = SCANNED + S.detections_sql("scanned", "doc_id, page, source")


@query("scan_sensitive", _DETECTED + "SELECT doc_id, page, type, value, conf, count(*) AS n FROM detections GROUP BY ALL")
def scan_sensitive(spark, sf_dir):
    return E.scan_sensitive(scanned(spark, sf_dir)).groupBy("doc_id", "page", "type", "value", "conf").agg(F.count(F.lit(1)).alias("n"))


@query("scan_positions", SCANNED + S.spots_sql("scanned", "doc_id, page") + """
SELECT doc_id, page, type, value, conf, CAST(s AS BIGINT) AS start, CAST(s + n AS BIGINT) AS "end" FROM spots""")
def scan_positions(spark, sf_dir):
    return E.scan_sensitive(scanned(spark, sf_dir)).select(
        "doc_id", "page", "type", "value", "conf", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_FRAGS = S.ids_sql() + """,
frags AS (
  SELECT doc_id, page, unnest(string_split_regex(text, '\\s+')) AS w, unnest(generate_series(1, len(string_split_regex(text, '\\s+')))) AS word_no FROM id_texts),
placed AS (
  SELECT *, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id, page ORDER BY word_no) - 1 - length(w) AS INTEGER) AS fs, (word_no % 12) * 48.0 AS x0, (word_no % 12) * 48.0 + 4.0 * length(w) AS x1,
    (word_no // 12) * 12.0 AS top, (word_no // 12) * 12.0 + 8.0 AS bottom FROM frags),
joined AS (SELECT doc_id, page, string_agg(w, ' ' ORDER BY word_no) AS text FROM placed GROUP BY 1, 2)
"""


def _fragments(spark, sf_dir) -> DataFrame:
    """The identifier texts as words on a grid of twelve columns."""
    words = X.id_texts(spark, sf_dir).select("doc_id", "page", F.posexplode(F.split("text", r"\s+")).alias("i", "text"))
    no = F.col("i") + 1
    return words.select(
        "doc_id", "page", no.alias("word_no"), "text", ((no % 12) * 48.0).alias("x0"),
        ((no % 12) * 48.0 + 4.0 * F.length("text")).alias("x1"),
        (F.floor(no / 12) * 12.0).cast("double").alias("top"), (F.floor(no / 12) * 12.0 + 8.0).cast("double").alias("bottom"))


@query("locate_detections", _FRAGS + S.spots_sql("joined", "doc_id, page") + """,
boxes AS (
  SELECT d.doc_id, d.page, d.type, d.value, d.s, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom
  FROM spots d JOIN placed p ON d.doc_id = p.doc_id AND d.page = p.page AND p.fs < d.s + d.n AND p.fs + length(p.w) > d.s GROUP BY 1, 2, 3, 4, 5)
SELECT doc_id, page, type, value, CAST(s AS BIGINT) AS start, round(greatest(0, x0 / 600.0::DOUBLE - 0.003), 6) AS x, round(greatest(0, top / 800.0::DOUBLE - 0.005), 6) AS y,
  round(least(1, (x1 - x0) / 600.0::DOUBLE + 0.006), 6) AS w, round(least(1, (bottom - top) / 800.0::DOUBLE + 0.01), 6) AS h FROM boxes""")
def locate_detections(spark, sf_dir):
    pages, spans = E.joined_fragments(_fragments(spark, sf_dir))
    boxes = E.locate_detections(spans, E.scan_sensitive(pages), 600.0, 800.0)
    return boxes.select(
        "doc_id", "page", "type", "value", F.col("start").cast("long").alias("start"), *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


@query("scan_tokens", _FRAGS + ",\ntoken_hits AS (" + " UNION ALL ".join(
    f"SELECT doc_id, page, word_no, w AS text, {S.q(n)} AS type, CAST({c} AS DOUBLE) AS conf FROM placed WHERE regexp_matches(w, {S.q(p)})"
    for n, p, c in V.SENSITIVE_PATTERNS) + ") SELECT * FROM token_hits")
def scan_tokens(spark, sf_dir):
    return E.scan_tokens(_fragments(spark, sf_dir)).select("doc_id", "page", "word_no", "text", "type", "conf")


def _redacted_sql(min_conf: float = 0.0) -> str:
    """CTEs up to masked(doc_id, page, text): spans from split lengths, islands of overlapping spans, text put together."""
    chosen = sorted((p for p in V.SENSITIVE_PATTERNS if p[2] >= min_conf), key=lambda p: -p[2])
    return S.spots_sql("scanned", "doc_id, page, text", chosen) + f""",
fresh AS (SELECT *, CASE WHEN s >= max(s + n) OVER (PARTITION BY doc_id, page ORDER BY s, s + n, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM spots),
grp AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, page ORDER BY s, s + n, rank) AS g FROM fresh),
areas AS (SELECT doc_id, page, any_value(text) AS text, min(s) AS s, max(s + n) AS e, arg_min(type, rank) AS type FROM grp GROUP BY doc_id, page, g),
gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id, page ORDER BY s), 0) AS prev FROM areas),
built AS (
  SELECT doc_id, page, string_agg(substr(text, CAST(prev + 1 AS BIGINT), CAST(s - prev AS BIGINT)) || '[' || type || ']', '' ORDER BY s) || substr(any_value(text), CAST(max(e) + 1 AS BIGINT)) AS text
  FROM gaps GROUP BY doc_id, page),
masked AS (SELECT s.doc_id, s.page, coalesce(b.text, s.text) AS text FROM scanned s LEFT JOIN built b ON s.doc_id = b.doc_id AND s.page = b.page)
"""


@query("redact", SCANNED + _redacted_sql() + "SELECT doc_id, page, text FROM masked")
def redact(spark, sf_dir):
    return E.redact(scanned(spark, sf_dir)).select("doc_id", "page", "text")


# a policy that leaves unsure types in place leaks exactly those
@query("verify_redaction", SCANNED + _redacted_sql(0.9) + S.detections_sql("masked", "doc_id, page") + """
SELECT type, count(*) AS leaks, count(DISTINCT doc_id) AS docs FROM detections GROUP BY 1""")
def verify_redaction(spark, sf_dir):
    return E.verify_redaction(E.redact(scanned(spark, sf_dir), min_conf=0.9))


_VERHOEFF = """
d5 AS (SELECT list(CASE WHEN a < 5 AND b < 5 THEN (a + b) % 5 WHEN a < 5 THEN (a + b) % 5 + 5 WHEN b < 5 THEN (a - b + 5) % 5 + 5 ELSE (a - b + 10) % 5 END ORDER BY a, b) AS d
  FROM generate_series(0, 9) x(a), generate_series(0, 9) y(b)),
"""


@query("validate_ids", _VERHOEFF + SCANNED + S.detections_sql("scanned", "doc_id, page, source", [
    p for p in V.SENSITIVE_PATTERNS if p[0] in dict(V.CHECKED_SHAPES)]) + f""",
ids AS (SELECT DISTINCT doc_id, page, type, value FROM detections),
base AS (SELECT [1,5,7,6,2,8,3,0,9,4] AS p1),
steps AS (SELECT i.*, regexp_replace(value, '\\s', '', 'g') AS v FROM ids i),
digits AS (
  SELECT doc_id, page, type, value, v, list_transform(generate_series(0, 11), lambda k: CAST(substr(v, 12 - k, 1) AS INTEGER)) AS ds FROM steps WHERE type = 'Aadhaar'),
perms AS (
  SELECT g.*, list_transform(generate_series(1, 12), lambda k: list_reduce([ds[k]] || list_transform(generate_series(1, (k - 1) % 8), lambda z: 0), lambda x, z: p1[x + 1])) AS ps
  FROM digits g CROSS JOIN base),
checks AS (SELECT doc_id, page, value, list_reduce([0] || ps, lambda acc, x: d[acc * 10 + x + 1]) = 0 AS good FROM perms CROSS JOIN d5)
SELECT i.doc_id, i.page, i.type, i.value, CASE i.type WHEN 'GSTIN' THEN {S.gstin_check_sql('i.value')} = substr(i.value, 15, 1)
  WHEN 'Aadhaar' THEN c.good ELSE true END AS ok
FROM ids i LEFT JOIN checks c ON i.doc_id = c.doc_id AND i.page = c.page AND i.value = c.value AND i.type = 'Aadhaar'""")
def validate_ids(spark, sf_dir):
    return E.validate_ids(scanned(spark, sf_dir).drop("source"))


@query("pii_inventory", _DETECTED + """
SELECT source, type, count(*) AS n_matches, count(DISTINCT value) AS n_values, count(DISTINCT doc_id) AS n_docs,
  CAST(grouping(source, type) AS INTEGER) AS level FROM detections GROUP BY CUBE (source, type)""")
def pii_inventory(spark, sf_dir):
    return E.pii_inventory(E.scan_sensitive(scanned(spark, sf_dir)))
