"""Queries over document sets and operations: merging, selecting, comparing, audit, jobs, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagetables.operators import docset as D, quality as Q
from pagetables.session import new_folder
from pagetables.streaming import audit as A, continuity as C, folder as W
from workloads import fixtures as X, sql as S
from workloads.registry import query

PAGES = S.pages_sql()


def _pages(spark, sf_dir) -> DataFrame:
    return X.pages_text(spark, sf_dir).select("doc_id", "page", "text")


# --- merging and cutting -----------------------------------------------------

@query("merge_docs", PAGES + """,
orders_of AS (SELECT DISTINCT doc_id, doc_id % 40 AS bundle_id, -doc_id AS ord FROM pages_text)
SELECT bundle_id, p.doc_id, page, row_number() OVER (PARTITION BY bundle_id ORDER BY ord, page) AS new_page
FROM pages_text p JOIN orders_of o ON p.doc_id = o.doc_id""")
def merge_docs(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    order = X.documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 40).alias("bundle_id"), (-F.col("doc_id")).alias("ord"))
    return D.merge_docs(pages, order).select("bundle_id", "doc_id", "page", "new_page")


# reversed, repeated, clipped and junk parts
_SPECS = ["1-3,5,8-10", "5-1", "10-20,2", "3, 1 , 2,1", "x,2-", "odd", "even", "all", "0-2", "1-1000000000000,1"]


@query("select_pages", PAGES + """,
sizes AS (SELECT doc_id, CAST(max(page) AS BIGINT) AS n FROM pages_text GROUP BY 1),
specs AS (SELECT *, [""" + ", ".join(S.q(s) for s in _SPECS) + """][doc_id % 10 + 1] AS spec FROM sizes),
parts AS (SELECT doc_id, n, spec, unnest(string_split(spec, ',')) AS part, unnest(generate_series(1, len(string_split(spec, ',')))) AS k FROM specs),
ranges AS (
  SELECT doc_id, n, k, TRY_CAST(regexp_extract(trim(part), '^([0-9]+)', 1) AS BIGINT) AS a,
    coalesce(TRY_CAST(regexp_extract(trim(part), '-\\s*([0-9]+)$', 1) AS BIGINT), TRY_CAST(regexp_extract(trim(part), '^([0-9]+)', 1) AS BIGINT)) AS b
  FROM parts WHERE regexp_matches(trim(part), '^[0-9]+(\\s*-\\s*[0-9]+)?$')),
wanted AS (
  SELECT doc_id, k, unnest(generate_series(greatest(1, least(a, b)), least(n, greatest(a, b)))) AS page FROM ranges
  UNION ALL SELECT doc_id, 1, unnest(generate_series(1, n)) FROM specs WHERE spec = 'all'
  UNION ALL SELECT doc_id, 1, unnest(generate_series(1, n, 2)) FROM specs WHERE spec = 'odd'
  UNION ALL SELECT doc_id, 1, unnest(generate_series(2, n, 2)) FROM specs WHERE spec = 'even'),
firsts AS (SELECT doc_id, page, min(k * 1000000 + page) AS place FROM wanted GROUP BY 1, 2)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS new_page FROM firsts""")
def select_pages(spark, sf_dir):
    specs = X.documents(spark, sf_dir).select(
        "doc_id", F.element_at(F.array(*[F.lit(s) for s in _SPECS]), (F.col("doc_id") % 10).cast("int") + 1).alias("spec"))
    return D.select_pages(X.page_numbers(spark, sf_dir), specs).select("doc_id", "page", "new_page")


@query("split_pages", PAGES + "SELECT doc_id, page, (page - 1) // 3 + 1 AS part, (page - 1) % 3 + 1 AS part_page FROM pages_text")
def split_pages(spark, sf_dir):
    return D.split_pages(_pages(spark, sf_dir), "every", 3).select("doc_id", "page", "part", "part_page")


# pages turned round, the first one kept at both ends, third pages left out
@query("reorder_pages", PAGES + """,
sizes AS (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS n FROM pages_text)
SELECT doc_id, page, n - page + 2 AS position FROM sizes WHERE page <> 3 UNION ALL SELECT doc_id, page, 1 FROM sizes WHERE page = 1""")
def reorder_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    sizes = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    listed = sizes.select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    manifest = listed.where("page <> 3").select("doc_id", "page", (F.col("n") - F.col("page") + 2).alias("position")).unionByName(
        sizes.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("position")))
    return D.reorder_pages(pages, manifest).select("doc_id", "page", "position")


@query("number_pages", PAGES + """
SELECT doc_id, page, 'Footer   •   Page ' || row_number() OVER (PARTITION BY doc_id ORDER BY page) || ' of ' || count(*) OVER (PARTITION BY doc_id) AS label FROM pages_text""")
def number_pages(spark, sf_dir):
    return D.number_pages(_pages(spark, sf_dir), "nofm", "Footer").select("doc_id", "page", "label")


@query("paginate_text", """
raw AS (SELECT doc_id, string_split_regex(replace(text, chr(9), '    '), '\\r?\\n') AS ls FROM documents),
numbered AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS k, unnest(ls) AS s FROM raw),
cut AS (SELECT doc_id, k, s, unnest(generate_series(0, greatest(0, (length(s) - 1) // 75))) AS j FROM numbered),
pieces AS (SELECT doc_id, substr(s, j * 75 + 1, 75) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS i FROM cut)
SELECT doc_id, i // 47 + 1 AS page, i % 47 + 1 AS line_on_page, text FROM pieces""")
def paginate_text(spark, sf_dir):
    return D.paginate_text(X.documents(spark, sf_dir).select("doc_id", "text"))


# --- comparing ---------------------------------------------------------------

_TOKENS = S.VERSIONS + """,
ta AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS token FROM ver_a),
tb AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS token FROM ver_b),
ca AS (SELECT doc_id, token, count(*) AS n FROM ta WHERE token <> '' GROUP BY 1, 2),
cb AS (SELECT doc_id, token, count(*) AS n FROM tb WHERE token <> '' GROUP BY 1, 2),
both_t AS (SELECT coalesce(ca.doc_id, cb.doc_id) AS doc_id, coalesce(ca.token, cb.token) AS token, coalesce(ca.n, 0) AS old_n, coalesce(cb.n, 0) AS new_n
  FROM ca FULL JOIN cb ON ca.doc_id = cb.doc_id AND ca.token = cb.token)
"""


@query("compare_versions", _TOKENS + """
SELECT doc_id, token, old_n, new_n, CASE WHEN new_n > old_n THEN 'add' ELSE 'del' END AS op FROM both_t WHERE old_n <> new_n""")
def compare_versions(spark, sf_dir):
    return D.compare_versions(*X.doc_versions(spark, sf_dir))[0]


@query("compare_summary", _TOKENS + """
SELECT doc_id, CAST(sum(greatest(new_n - old_n, 0)) AS BIGINT) AS added, CAST(sum(greatest(old_n - new_n, 0)) AS BIGINT) AS removed,
  CAST(sum(least(old_n, new_n)) AS BIGINT) AS same, bool_and(old_n = new_n) AS identical FROM both_t GROUP BY 1""")
def compare_summary(spark, sf_dir):
    return D.compare_versions(*X.doc_versions(spark, sf_dir))[1]


@query("compare_pages", S.VERSIONS + """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page) AS page,
  CASE WHEN b.doc_id IS NULL THEN 'only_a' WHEN a.doc_id IS NULL THEN 'only_b' WHEN a.text = b.text THEN 'same' ELSE 'changed' END AS state
FROM ver_a a FULL JOIN ver_b b ON a.doc_id = b.doc_id AND a.page = b.page""")
def compare_pages(spark, sf_dir):
    return D.compare_pages(*X.doc_versions(spark, sf_dir))


# --- operations --------------------------------------------------------------

@query("audit_rollup", S.AUDIT + """
SELECT tool_id, status, count(*) AS n_actions, count(*) FILTER (status = 'error') AS n_errors, round(avg(CASE WHEN status = 'error' THEN 1 ELSE 0 END), 6) AS error_share,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, CAST(grouping(tool_id, status) AS INTEGER) AS level
FROM audit GROUP BY ROLLUP (tool_id, status)""")
def audit_rollup(spark, sf_dir):
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")}
    return Q.audit_rollup(X.audit_log(spark, sf_dir)).withColumns(shown)


@query("job_rollup", S.AUDIT + """,
jobs AS (
  SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS a, max(ts) AS b, count(*) AS total, count(*) FILTER (status <> 'error') AS ok, count(*) FILTER (status = 'error') AS bad
  FROM audit GROUP BY 1, 2),
timed AS (SELECT *, CASE WHEN bad > 0 THEN 'error' ELSE 'done' END AS status, CAST(floor(epoch(b)) - floor(epoch(a)) AS BIGINT) AS seconds FROM jobs)
SELECT CAST(day AS VARCHAR) AS day, status, count(*) AS n_jobs, CAST(sum(total) AS BIGINT) AS items, CAST(sum(ok) AS BIGINT) AS succeeded,
  CAST(sum(bad) AS BIGINT) AS failed, CAST(sum(seconds) AS BIGINT) AS seconds, max(seconds) AS longest FROM timed GROUP BY 1, 2""")
def job_rollup(spark, sf_dir):
    return Q.job_rollup(X.batch_jobs(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


# --- streams -----------------------------------------------------------------

def _in_portions(df: DataFrame, day: str, portions: int, run) -> None:
    """Rows arrive day by day in a few portions of about the same size; `run(folder)` after each."""
    folder = new_folder(df.sparkSession, "arriving")
    numbered = df.withColumn("_day", F.unix_date(F.to_date(day)))
    cuts = numbered.approxQuantile("_day", [i / portions for i in range(1, portions)], 0.01)
    low = None
    for high in [*cuts, None]:
        part = numbered
        if low is not None:
            part = part.where(F.col("_day") > low)
        if high is not None:
            part = part.where(F.col("_day") <= high)
        part.drop("_day").write.mode("append").parquet(folder)
        run(folder)
        low = high


@query("watch_folder", PAGES + f"""
SELECT doc_id, page, {S.type_sql('text')} AS doc_type, {S.script_sql('text')} AS script, length(text) AS n_chars FROM pages_text""")
def watch_folder(spark, sf_dir):
    source, out = new_folder(spark, "arriving"), new_folder(spark, "typed")
    _pages(spark, sf_dir).repartition(8, "doc_id", "page").write.parquet(source)
    stream = W.typed_pages(W.watch_folder(spark, source, files_per_batch=3))
    W.append_to(stream, out, new_folder(spark, "progress")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# without late rows every closed hour agrees with the batch count; the last two hours stay open
@query("audit_stream", S.AUDIT + """,
hours AS (SELECT date_trunc('hour', ts) AS h, tool_id, count(*) AS n_actions, count(*) FILTER (status = 'error') AS n_errors FROM audit GROUP BY 1, 2)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, tool_id, n_actions, n_errors FROM hours
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM audit)""")
def audit_stream(spark, sf_dir):
    log = X.audit_log(spark, sf_dir)
    out, progress = new_folder(spark, "hours"), new_folder(spark, "progress")

    def run(folder):
        events = spark.readStream.schema(log.schema).parquet(folder)
        W.append_to(A.audit_stream(events), out, progress).awaitTermination()

    _in_portions(log, "ts", 3, run)
    return spark.read.parquet(out).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "tool_id", "n_actions", "n_errors")


@query("continuity_stream", S.CHECKED + "SELECT account_id, seq, balance_p, previous, verdict FROM checked")
def continuity_stream(spark, sf_dir):
    book = X.ledger(spark, sf_dir)
    out, progress = new_folder(spark, "continuity"), new_folder(spark, "progress")

    def run(folder):
        rows = spark.readStream.schema(book.schema).parquet(folder)
        C.continuity_stream(
            rows, out, progress, opening="opening_p", balance="balance_p", debit="debit_p", credit="credit_p", tolerance=1
        ).awaitTermination()

    _in_portions(book, "o_orderdate", 4, run)
    return spark.read.parquet(f"{out}/checked").select("account_id", "seq", "balance_p", "previous", "verdict")
