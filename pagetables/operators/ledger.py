"""Statement lines to ledger rows, and checks of the running balance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions.cells import (
    behind_lead_date, bind, date_of, in_order, is_amount, is_bare_amount, is_number, lead_date, one_line, parse_number, strip,
)
from ..functions.scans import ordered_scan, places_of, spread_by_page

CANON = [name for name, _ in V.HEADER_SYNONYMS]
# rows of one account per chunk of the balance scan
SEQ_CHUNK = 65536


# --- headers -----------------------------------------------------------------

def header_names(cells: Column) -> Column:
    """Canonical name per cell ('' for none): left to right, each name used once."""

    def step(acc: Column, text: Column) -> Column:
        options = [F.when(text.rlike(p) & ~F.array_contains(acc, n), n) for n, p in V.HEADER_SYNONYMS]
        return F.concat(acc, F.array(F.coalesce(*options, F.lit(""))))

    clean = F.transform(cells, lambda c: F.lower(one_line(c)))
    return F.aggregate(clean, F.array().cast("array<string>"), step)


def _usable(names: Column) -> Column:
    return (
        (F.size(F.filter(names, lambda n: n != "")) >= 3)
        & F.array_contains(names, "balance")
        & (F.array_contains(names, "debit") | F.array_contains(names, "credit"))
    )


def match_headers(lines: DataFrame) -> DataFrame:
    """Adds `names` (array, null when the line is no header) to lines with `cells`.

    Only lines that mention a balance pay for the matching; the others are told by one look at the whole line.
    """
    hint = F.array_join("cells", "\n").rlike("(?i)bal")
    maybe = F.exists("cells", lambda c: c.rlike(r"(?i)balance|^\s*bal\.?\s*$"))
    return lines.withColumn("names", F.when(
        hint & maybe, bind(header_names(F.col("cells")), lambda names: F.when(_usable(names), names))))


def find_header(lines: DataFrame) -> DataFrame:
    """The first header line per document: doc_id, header_page, header_line, header_cells, names, n_cols."""
    at = F.struct("page", "line_no")
    # widths are counted by hash; only header lines, which are few, meet an aggregation of structs, which sorts
    width = lines.groupBy("doc_id").agg(F.max(F.size("cells")).alias("n_cols"))
    first = match_headers(lines).where("names is not null").groupBy("doc_id").agg(
        F.min(at).alias("at"), F.min_by(F.struct("cells", "names"), at).alias("h"))
    first = first.withColumnRenamed("doc_id", "_of")
    return first.join(width, F.col("_of").eqNullSafe(F.col("doc_id"))).select(
        "doc_id", F.col("at.page").alias("header_page"), F.col("at.line_no").alias("header_line"),
        F.col("h.cells").alias("header_cells"), F.col("h.names").alias("names"), "n_cols",
    )


def body_lines(lines: DataFrame, header: DataFrame) -> DataFrame:
    """Lines below the first header."""
    at = spread_by_page(lines, header.select("doc_id", "header_page", "header_line"))
    return at.where(F.struct("page", "line_no") > F.struct("header_page", "header_line"))


# marks of a cell, as bits
_FILLED, _DATE, _NUMBER = 1, 2, 4


def marked_cells(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, marks): per cell whether it is filled, a date, an amount, in a byte each.

    What `column_kinds` counts, in a fraction of the bytes of the cells, so that lines can move without their texts.
    """
    def mark(text: Column) -> Column:
        # no date is an amount: each has two separators or a month within, which no amount has
        kinds = F.when(text == "", 0).when(is_bare_amount(text), _FILLED + _NUMBER).when(date_of(text).isNotNull(), _FILLED + _DATE)
        return kinds.when(is_amount(text), _FILLED + _NUMBER).otherwise(_FILLED).cast("byte")

    marks = F.transform(F.transform("cells", lambda c: strip(c)), mark)
    return lines.select("doc_id", "page", "line_no", marks.alias("marks"))


def column_kinds(lines: DataFrame) -> DataFrame:
    """Per document and column: date, amount or text by 60 % of the filled cells; n = filled cells.

    Takes lines with `cells`, or with the `marks` of `marked_cells`.
    """
    marked = lines if "marks" in lines.columns else marked_cells(lines)
    cells = marked.select("doc_id", F.posexplode_outer("marks").alias("col", "mark")).where("col is not null")
    filled = F.col("n") > 0
    return (
        cells.groupBy("doc_id", "col")
        .agg(*[F.count_if(F.col("mark").bitwiseAND(F.lit(bit).cast("byte")) != 0).alias(n)
               for n, bit in (("n", _FILLED), ("n_date", _DATE), ("n_number", _NUMBER))])
        .withColumn(
            "kind",
            F.when(~filled, "empty")
            .when(F.col("n_date") / F.when(filled, F.col("n")) >= 0.6, "date")
            .when(F.col("n_number") / F.when(filled, F.col("n")) >= 0.6, "amount")
            .otherwise("text"),
        )
    )


# names filled from content, in this order: name, kind, which free column
_FILLS = [
    ("date", "date", "first"), ("value_date", "date", "first"), ("balance", "amount", "last"),
    ("debit", "amount", "first"), ("credit", "amount", "first"), ("particulars", "text", "most"),
]


def repair_mapping(header: DataFrame, kinds: DataFrame) -> DataFrame:
    """Header names checked against, and completed from, the content of the columns.

    Works on one short array per document. Adds `mapping` (name per column) and `kinds`.
    """
    per_doc = kinds.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("col", F.struct("kind", "n")))).alias("by_col"))
    columns = F.sequence(F.lit(0), F.col("n_cols") - 1)
    joined = header.join(per_doc, "doc_id", "left").withColumn(
        "kinds",
        F.transform(columns, lambda j: F.coalesce(
            F.try_element_at("by_col", j), F.struct(F.lit("empty").alias("kind"), F.lit(0).cast("long").alias("n")))),
    ).withColumn("names", F.transform(columns, lambda j: F.coalesce(F.get("names", j), F.lit(""))))
    kept = F.zip_with("names", "kinds", lambda m, k: F.when(
        (m.isin("debit", "credit", "balance") & (k.kind == "date"))
        | (m.isin("date", "value_date") & (k.kind == "amount")), "").otherwise(m))

    def fill(mapping: Column, step: Column) -> Column:
        slots = F.zip_with(mapping, "kinds", lambda m, k: F.struct((m == "").alias("free"), k.alias("k")))
        ranked = F.transform(slots, lambda s, j: F.when(
            s.free & (s.k.kind == step.kind),
            F.struct(
                F.when(step.which == "last", -j).when(step.which == "most", -s.k.n).otherwise(j).alias("rank"),
                j.alias("j"))))
        target = F.array_min(ranked)["j"]
        return F.when(F.array_contains(mapping, step["name"]), mapping).otherwise(bind(
            target, lambda t: F.transform(mapping, lambda m, j: F.when(j == t, step["name"]).otherwise(m))))

    steps = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(w).alias("which")) for n, k, w in _FILLS])
    return joined.withColumn("kept", kept).withColumn("mapping", F.aggregate(steps, F.col("kept"), fill)).drop(
        "by_col", "kept")


# --- line roles --------------------------------------------------------------

def _mentions(text: str, words: Sequence[str]) -> Column:
    """Whether any of the words is in the text: a cheap test in front of a pattern."""
    return reduce(or_, [F.col(text).contains(w) for w in words])


def split_lines(lines: DataFrame, header: DataFrame) -> DataFrame:
    """Adds `role` (preamble, header, blank, opening, skip, repeat, work), `joined` and `opening` to the lines."""
    at = spread_by_page(match_headers(lines), header.select("doc_id", "header_page", "header_line"))
    here, first = F.struct("page", "line_no"), F.struct("header_page", "header_line")
    joined = strip(F.array_join("cells", " "))
    numbers = F.filter("cells", lambda c: is_number(c))
    tagged = at.withColumn("joined", joined).withColumn("_lower", F.lower("joined"))
    role = (
        F.when(here < first, "preamble")
        .when(here == first, "header")
        .when(F.col("joined") == "", "blank")
        .when(_mentions("_lower", V.OPENING_WORDS) & F.col("joined").rlike(V.OPENING_LINE), "opening")
        .when(_mentions("_lower", V.SKIP_WORDS) & F.col("joined").rlike(V.SKIP_LINE), "skip")
        .when(F.col("names").isNotNull(), "repeat")
        .otherwise("work")
    )
    return (
        tagged.withColumn("role", role)
        .withColumn("opening", F.when(F.col("role") == "opening", parse_number(F.try_element_at(numbers, F.lit(-1)))))
        .drop("header_page", "header_line", "names", "_lower")
    )


def skipped_lines(roles: DataFrame) -> DataFrame:
    """(doc_id, n_skipped): lines below the header left out for a total, carried balance or page mark in them.

    The words are looked for anywhere in a line, so the count tells whether transactions may be among them.
    """
    return roles.groupBy("doc_id").agg(F.count_if(F.col("role") == "skip").alias("n_skipped"))


def opening_balances(roles: DataFrame) -> DataFrame:
    """The last opening line with an amount per document."""
    return roles.groupBy("doc_id").agg(
        F.max_by("opening", F.when(F.col("opening").isNotNull(), F.struct("page", "line_no"))).alias("opening"))


def preamble(roles: DataFrame) -> DataFrame:
    """Lines above the header, filled cells joined by two blanks."""
    text = F.array_join(F.filter(F.transform("cells", lambda c: strip(c)), lambda c: c != ""), "  ")
    return roles.where("role = 'preamble'").select("doc_id", "page", "line_no", text.alias("text")).where("text <> ''")


# --- transactions ------------------------------------------------------------

def named_cells(roles: DataFrame, mapping: DataFrame) -> DataFrame:
    """Lines with one column of text per canonical name, the other filled cells in `extra`."""
    facts = mapping.select("doc_id", "mapping", "header_cells")
    joined = spread_by_page(roles, facts)
    named = [strip(F.get("cells", F.array_position("mapping", n).cast("int") - 1)).alias(n) for n in CANON]
    unnamed = F.filter(
        F.transform("cells", lambda c, j: F.struct(
            j.alias("j"), F.coalesce(F.get("header_cells", j), F.lit("")).alias("header"), strip(c).alias("text"))),
        lambda e: (F.coalesce(F.get("mapping", e.j), F.lit("")) == "") & (e.text != ""))
    # most documents have a name for every column
    all_named = ~F.array_contains("mapping", "") & (F.size("cells") <= F.size("mapping"))
    extra = F.when(all_named, F.array().cast("array<struct<j: int, header: string, text: string>>")).otherwise(unnamed)
    return joined.select("doc_id", "page", "line_no", "y", "role", "opening", *named, extra.alias("extra"))


def nearest_anchor(named: DataFrame) -> DataFrame:
    """Gives every transaction line the dated line nearest by height (the earlier one on a tie).

    Distance counts pages as 1000 points. The previous and the next dated line come
    from a page-wise scan, so long documents stay spread. Adds `anchor`, `is_anchor` and `height`, and the columns that
    tell `fold_transactions` where the lines lie.
    """
    height = F.col("y") + V.PAGE_OFFSET * (F.col("page") - 1)
    work = named.where("role = 'work'").drop("role", "opening")
    marked = work.withColumn("is_anchor", lead_date("date").isNotNull()).withColumn("height", height)
    marked = marked.withColumn(
        "here", F.when(F.col("is_anchor"), F.struct("height", "page", "line_no")))
    scanned = ordered_scan(
        marked, ["doc_id"], "page", ["line_no"], before={"previous": "here"}, after={"next": "here"}, placed=True)
    up, down = F.abs(F.col("height") - F.col("previous.height")), F.abs(F.col("next.height") - F.col("height"))
    other = F.when(F.col("next").isNull() | (up <= down), F.col("previous")).otherwise(F.col("next"))
    return scanned.withColumn("anchor", F.coalesce("here", other)).where("anchor is not null").drop("here", "previous", "next")


AMOUNTS = ("debit", "credit", "balance")


def _joined(members: Column | str, name: str) -> Column:
    return F.array_join(F.filter(F.transform(members, lambda m: m[name]), lambda t: t != ""), " ")


def _page_parts(anchored: DataFrame) -> DataFrame:
    """What the lines of one page add to a dated line, as one row: no list holds more than a page's lines.

    Lines that come from `nearest_anchor` lie together by page already and do not move.
    """
    member = F.struct(
        "height", "line_no", "is_anchor", "particulars", "ref", *[f"{n}_amount" for n in AMOUNTS],
        F.when(F.col("is_anchor"), F.col("date")).alias("date"),
        F.when(F.col("is_anchor"), F.col("value_date")).alias("value_date"), "extra")
    places = places_of(anchored)
    here = {"doc_id": F.col("doc_id"), "of": F.col("page")}  # what the places stand for
    keys = places or [value.alias(name) for name, value in here.items()]
    told = [F.first(value).alias(name) for name, value in here.items()] if places else []
    grouped = anchored.withColumns({f"{n}_amount": parse_number(n) for n in AMOUNTS}).groupBy(
        *keys, F.col("anchor.page").alias("page"), F.col("anchor.line_no").alias("line_no")).agg(
        *told, in_order(F.collect_list(member)).alias("members"))
    amounts = [F.get(F.filter(F.transform("members", lambda m: m[f"{n}_amount"]), lambda a: a.isNotNull()), 0).alias(n) for n in AMOUNTS]
    return grouped.select(
        "doc_id", "page", "line_no", "of", F.get(F.filter("members", lambda m: m.is_anchor), 0).alias("own"), *amounts,
        F.size("members").alias("n_lines"), _joined("members", "particulars").alias("particulars"),
        _joined("members", "ref").alias("ref"), F.flatten(F.transform("members", lambda m: m.extra)).alias("extra"))


def fold_transactions(anchored: DataFrame) -> DataFrame:
    """One row per dated line: texts joined downwards, amounts from the dated line or the first other line.

    Lines are folded per page first, then the pages of a dated line, in their order. So a dated line that all further pages
    of a document belong to gathers a row per page, whose texts make its one output cell.
    """
    own = F.when(F.col("own").isNotNull(), F.struct(*[F.col("own")[n].alias(n) for n in ("date", "value_date", *(f"{n}_amount" for n in AMOUNTS))]))
    page_part = F.struct("of", own.alias("own"), *AMOUNTS, "n_lines", "particulars", "ref", "extra")
    grouped = _page_parts(anchored).groupBy("doc_id", "page", "line_no").agg(in_order(F.collect_list(page_part)).alias("pages"))

    def first(value) -> Column:
        return F.get(F.filter(F.transform("pages", value), lambda x: x.isNotNull()), 0)

    parts = grouped.withColumn("own", first(lambda m: m.own)).select(
        "doc_id", "page", "line_no", F.aggregate("pages", F.lit(0), lambda acc, m: acc + m.n_lines).alias("n_lines"),
        F.col("own.date").alias("date_text"), F.col("own.value_date").alias("value_date_text"),
        _joined("pages", "particulars").alias("particulars"), _joined("pages", "ref").alias("ref_text"),
        *[F.coalesce(F.col("own")[f"{n}_amount"], first(lambda m: m[n])).alias(n) for n in AMOUNTS],
        F.flatten(F.transform("pages", lambda m: m.extra)).alias("extra"),
    )
    columns = F.array_sort(F.array_distinct(F.transform("extra", lambda e: F.struct(e.j.alias("j"), e.header.alias("header")))))
    extras = F.map_from_entries(F.transform(columns, lambda k: F.struct(
        F.concat((k.j + 1).cast("string"), F.lit(":"), k.header).alias("k"),
        F.array_join(F.transform(F.filter("extra", lambda e: e.j == k.j), lambda e: e.text), " ").alias("v"))))
    return parts.withColumn("value_date", bind(strip("value_date_text"), date_of)).select(
        "doc_id", "page", "line_no",
        lead_date("date_text").alias("date"),
        "value_date",
        F.when(F.col("value_date").isNull(), F.col("value_date_text")).alias("value_text"),
        F.trim("particulars").alias("particulars"),
        F.trim(F.concat_ws(" ", F.nullif(behind_lead_date("date_text"), F.lit("")), F.col("ref_text"))).alias("ref"),
        *AMOUNTS, extras.alias("extras"), "n_lines",
    )


def number_rows(rows: DataFrame) -> DataFrame:
    """Adds `seq`, the position of a ledger row in its document."""
    return ordered_scan(rows, ["doc_id"], "page", ["line_no"], number="seq")


# --- validation --------------------------------------------------------------

def check_continuity(
    ledger: DataFrame,
    key: str = "account_id",
    order: Sequence[str] = ("seq",),
    chunk: str | Column | None = None,
    opening: str | None = "opening",
    debit: str = "debit",
    credit: str = "credit",
    balance: str = "balance",
    tolerance=V.TOLERANCE,
    number: str | None = None,
    openings: DataFrame | None = None,
) -> DataFrame:
    """Adds `previous` and `verdict`: ok, bad, missing or unchecked.

    A row is compared with the last readable balance above it, else with the
    opening balance; without either it stays unchecked. The scan runs over blocks of
    the first order column, or over `chunk`. `number` also adds the position of the row.
    `openings` (key, opening) adds the opening balances, if the rows have none; they travel with the state of the scan.
    """
    chunk = F.floor(F.col(order[0]) / SEQ_CHUNK) if chunk is None else chunk
    scanned = ordered_scan(ledger, [key], chunk, list(order), number=number, before={"previous": balance}, facts=openings)
    previous = F.coalesce("previous", opening) if opening else F.col("previous")
    scanned = scanned.withColumn("previous", previous)
    zero = F.lit(0)
    expected = F.col("previous") - F.coalesce(debit, zero) + F.coalesce(credit, zero)
    off = F.abs(expected - F.col(balance)) > F.lit(tolerance).cast(scanned.schema[balance].dataType)
    return scanned.withColumn(
        "verdict",
        F.when(F.col(balance).isNull(), "missing")
        .when(F.col("previous").isNull(), "unchecked")
        .when(off, "bad").otherwise("ok"),
    )


def statement_summary(
    checked: DataFrame, key: str = "account_id", opening: str = "opening", order: Sequence[str] = ("seq",),
    debit: str = "debit", credit: str = "credit", balance: str = "balance"
) -> DataFrame:
    """Totals, closing balance, verdict counts and confidences per account."""
    zero = F.lit(0)
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    totals = checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(opening).alias("opening"),
        F.max_by(balance, F.when(F.col(balance).isNotNull(), place)).alias("closing"),
        F.sum(F.coalesce(debit, zero)).alias("total_debits"),
        F.sum(F.coalesce(credit, zero)).alias("total_credits"),
        F.count_if(F.col("verdict") == "ok").alias("n_ok"),
        F.count_if(F.col("verdict") == "bad").alias("n_bad"),
        F.count_if(F.col("verdict") == "missing").alias("n_missing"),
    )
    checked_rows = F.col("n_ok") + F.col("n_bad")
    return totals.withColumns({
        "confidence": F.when(checked_rows > 0, F.round(100.0 * F.col("n_ok") / F.when(checked_rows > 0, checked_rows), 1)).otherwise(0.0),
        "strict": F.round(100.0 * F.col("n_ok") / F.col("n_rows"), 1),
    })


def warnings(summary: DataFrame, key: str = "account_id") -> DataFrame:
    """One row per warning of a statement."""
    texts = F.array(
        F.when(F.col("opening").isNull(), V.WARN_NO_OPENING),
        F.when(F.col("n_missing") > 0, F.concat(F.col("n_missing").cast("string"), F.lit(V.WARN_MISSING))),
        F.when(F.col("n_bad") > 0, F.concat(F.col("n_bad").cast("string"), F.lit(V.WARN_BAD))),
    )
    return summary.select(key, F.posexplode(texts).alias("ord", "warning")).where("warning is not null")


def review_rows(checked: DataFrame) -> DataFrame:
    """Rows to look at: balance missing or not continuous."""
    return checked.where(F.col("verdict").isin("bad", "missing"))


def pick_statement(summaries: DataFrame, key: str = "doc_id", tag: str = "tag", ord: str = "ord") -> DataFrame:
    """The candidate with the best (strict, confidence, rows), the first one on a tie."""
    rank = F.struct("strict", "confidence", "n_rows", -F.col(ord))
    return summaries.groupBy(key).agg(F.max_by(F.struct(*[c for c in summaries.columns if c != key]), rank).alias("best")).select(
        key, "best.*")


def review_report(checked: DataFrame, key: str = "account_id", debit: str = "debit", credit: str = "credit") -> DataFrame:
    """Sums per account and review flag, per account, and overall."""
    flag = F.when(F.col("verdict").isin("bad", "missing"), "CHECK").otherwise("")
    return (
        checked.withColumn("review", flag)
        .rollup(key, "review")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.coalesce(debit, F.lit(0))).alias("total_debits"),
            F.sum(F.coalesce(credit, F.lit(0))).alias("total_credits"),
            F.grouping_id().cast("int").alias("level"),
        )
    )


def validation_report(summary: DataFrame, key: str = "account_id") -> DataFrame:
    """The validation sheet as rows of (key, ord, item, value)."""
    def money(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("not found"))

    values = [
        F.col("n_rows").cast("string"), money("opening"), money("closing"), F.col("total_debits").cast("string"),
        F.col("total_credits").cast("string"), F.col("n_ok").cast("string"), F.col("n_bad").cast("string"),
        F.concat(F.col("confidence").cast("string"), F.lit("%")), (F.col("n_bad") + F.col("n_missing")).cast("string"),
    ]
    pairs = F.array(*[
        F.struct(F.lit(n).alias("item"), v.alias("value")) for n, v in zip(V.VALIDATION_ITEMS, values, strict=True)])
    return summary.select(key, F.posexplode(pairs).alias("ord", "p")).select(key, "ord", "p.item", "p.value")


def portfolio_health(summary: DataFrame, key: str = "account_id", worst: int = 10) -> tuple[DataFrame, DataFrame]:
    """Over many statements: shares and quartiles in one row, and the `worst` accounts by strict confidence."""
    clean = F.col("n_ok") == F.col("n_rows")
    overall = summary.agg(
        F.count(F.lit(1)).alias("n_statements"),
        F.count_if(clean).alias("n_clean"),
        F.round(F.avg(clean.cast("int")), 4).alias("clean_share"),
        F.sum(F.col("n_bad") + F.col("n_missing")).alias("review_backlog"),
        F.round(F.avg("strict"), 2).alias("mean_strict"),
        F.min("strict").alias("min_strict"),
    )
    lowest = summary.orderBy("strict", F.col("n_rows").desc(), key).limit(worst)
    return overall, lowest
