"""Cleaning, scoring, linking and choosing of table rows.

Rows are (doc_id, page, row_no, cells array<string>); a `tag` column may separate
competing layouts of the same document and is then part of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..functions.cells import (
    cell_kind, date_of, decimal_tokens, in_order, is_amount, is_bare_amount, is_date, is_number, long_cells, parse_date,
    parse_number, strip,
)
from ..functions.scans import ordered_scan, spread_by_page
from ..session import stored


def _filled(cells: Column | str) -> Column:
    return F.filter(cells, lambda c: strip(c) != "")


def type_cells(cells: DataFrame, text: str = "text", id_digits: int | None = None) -> DataFrame:
    """Adds kind, num, dt, txt; with `id_digits`, digit strings that long stay text."""
    kind = cell_kind(text)
    if id_digits:
        kind = F.when(F.regexp_replace(text, ",", "").rlike(rf"^\s*\d{{{id_digits},}}\s*$"), "text").otherwise(kind)
    typed = cells.withColumn("kind", kind)
    return typed.withColumns({
        "num": F.when(F.col("kind") == "number", parse_number(strip(text))),
        "dt": F.when(F.col("kind") == "date", parse_date(text)),
        "txt": strip(text),
    })


def clean_cells(rows: DataFrame, drop_empty_columns: bool = True, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Newlines to blanks, trimmed, empty rows gone, padded; optionally without all-empty columns.

    Row numbers are renewed per page.
    """
    keys = list(keys)
    tidy = F.transform("cells", lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))
    rows = rows.withColumn("cells", tidy).where(F.exists("cells", lambda c: c != ""))
    used = long_cells(rows, *keys)
    if drop_empty_columns:
        used = used.where("text <> ''")
    keep = used.groupBy(*keys).agg(F.array_sort(F.collect_set("col")).alias("keep"))
    pages = rows.select(*keys, "page").distinct().join(keep, keys)
    joined = rows.join(pages, [*keys, "page"])
    padded = F.transform("keep", lambda j: F.coalesce(F.get("cells", j), F.lit("")))
    on_page = Window.partitionBy(*keys, "page").orderBy("row_no")
    return joined.select(
        *[c for c in rows.columns if c not in ("cells", "row_no")],
        F.row_number().over(on_page).alias("row_no"), padded.alias("cells"))


def drop_sparse_columns(rows: DataFrame, share: float = 0.03) -> DataFrame:
    """Without columns filled in less than `share` of the rows with several cells; at least two stay or none goes."""
    wide = rows.where(F.size("cells") > 1)
    per_column = (
        long_cells(wide, "doc_id")
        .groupBy("doc_id", "col").agg(F.count_if(strip("text") != "").alias("n"))
    )
    total = wide.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    keep = (
        per_column.join(total, "doc_id").where(F.col("n") >= F.col("total") * share)
        .groupBy("doc_id").agg(F.array_sort(F.collect_set("col")).alias("keep"))
        .where(F.size("keep") >= 2)
    )
    pages = rows.select("doc_id", "page").distinct().join(keep, "doc_id", "left")
    kept = F.when(
        F.col("keep").isNotNull() & (F.size("cells") > 1),
        F.transform("keep", lambda j: F.coalesce(F.get("cells", j), F.lit(""))),
    ).otherwise(F.col("cells"))
    return rows.join(pages, ["doc_id", "page"]).withColumn("cells", kept).drop("keep")


# marks of a cell, as bits
_FILLED, _NUMBER, _DATE, _JAMMED = 1, 2, 4, 8


def _marks(cells: str = "cells") -> Column:
    """Per cell an int: filled, amount, date, several decimal amounts; each cell is typed once, an empty one not at all."""
    def bit(test: Column, value: int) -> Column:
        return F.when(test, value).otherwise(0)

    def mark(text: Column) -> Column:
        typed = bit(is_amount(text), _NUMBER) + bit(date_of(text).isNotNull(), _DATE) + bit(decimal_tokens(text) >= 2, _JAMMED)
        # a bare amount is no date, and one decimal at most
        return F.when(text == "", 0).when(is_bare_amount(text), _FILLED + _NUMBER).otherwise(typed + _FILLED)

    return F.transform(F.transform(cells, lambda c: strip(F.replace(c, F.lit("\n"), F.lit(" ")))), mark)


def score_grid(rows: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Layout quality per key: coherent columns, width, data rows, fill, and a penalty for jammed amounts."""
    keys = list(keys)
    rows = rows.where(F.exists("cells", lambda c: strip(c) != ""))
    marked = rows.withColumn("marks", _marks())
    # an amount over several lines is none to the row, though it is one to its column
    broken = F.array_join("cells", "").contains("\n")
    amounts = F.when(broken, F.exists("cells", lambda c: is_number(c))).otherwise(F.exists("marks", lambda m: m.bitwiseAND(_NUMBER) != 0))
    cells = marked.withColumn("data", amounts).select(*keys, "data", F.posexplode_outer("marks").alias("col", "mark")).where("col is not null")
    per_column = cells.groupBy(*keys, "col").agg(
        *[F.count_if(F.col("mark").bitwiseAND(bit) != 0).alias(n)
          for n, bit in (("n", _FILLED), ("n_number", _NUMBER), ("n_date", _DATE), ("n_jammed", _JAMMED))],
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("data").alias("n_data"),
    )
    share = F.greatest("n_number", "n_date") / F.col("n")
    coherent = (F.col("n") >= 2) & (share >= 0.6)
    # every row has a first cell, so the first column counts the rows
    totals = per_column.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"),
        F.max(F.when(F.col("col") == 0, F.col("n_data"))).alias("n_data"),
        F.count_if(F.col("n") > 0).alias("n_cols"),
        F.sum("n").alias("n_filled"),
        F.sum("n_jammed").alias("n_jammed"),
        F.count_if(F.when(F.col("n") >= 2, coherent)).alias("n_coherent"),
    )
    value = (
        10.0 * F.col("n_coherent") + 1.5 * F.col("n_cols") + F.least(F.lit(15.0), F.col("n_data") / F.lit(5.0))
        + 8.0 * (F.col("n_filled") / (F.col("n_rows") * F.greatest("n_cols", F.lit(1))))
        - 35.0 * (F.col("n_jammed") / F.greatest("n_filled", F.lit(1)))
    )
    return totals.withColumn(
        "score",
        F.when(F.col("n_rows") < 2, 0.0).when(F.col("n_cols") < 2, 1.0).otherwise(F.round(value, 2)))


def pick_page_candidate(candidates: DataFrame, ruled: str = "ruled", stream: str = "stream") -> DataFrame:
    """Per page the best score (first on a tie); a whitespace layout replaces a ruled one that loses many rows.

    Input: doc_id, page, ord, engine, score, n_rows; engine names begin with the kind of layout.
    """
    one = F.struct("ord", "engine", "score", "n_rows")
    rank = F.struct("score", -F.col("ord"))
    best = candidates.where("n_rows > 0").groupBy("doc_id", "page").agg(
        F.max_by(one, rank).alias("best"),
        F.max_by(one, F.when(F.col("engine").startswith(stream), rank)).alias("stream"))
    swap = (
        F.col("best.engine").startswith(ruled)
        & (F.col("stream.n_rows") > F.col("best.n_rows") * 1.4)
        & (F.col("stream.score") >= F.col("best.score") * 0.8)
    )
    return best.withColumn("chosen", F.when(F.coalesce(swap, F.lit(False)), F.col("stream")).otherwise(F.col("best"))).select(
        "doc_id", "page", "chosen.*")


def pick_document_candidate(candidates: DataFrame) -> DataFrame:
    """Per document the largest score x (1 + rows / 1000), the first on a tie."""
    weight = F.col("score") * (1 + F.lit(0.001) * F.col("n_rows"))
    one = F.struct(*[c for c in candidates.columns if c != "doc_id"])
    return candidates.groupBy("doc_id").agg(F.max_by(one, F.struct(weight, -F.col("ord"))).alias("best")).select(
        "doc_id", "best.*")


def _signature(cells: Column | str) -> Column:
    return F.transform(cells, lambda c: F.lower(strip(c)))


def link_pages(rows: DataFrame) -> DataFrame:
    """Drops header rows repeated at the top of later pages.

    Headers are rows among the first three of the first page with two or more filled
    cells and no amount. Later pages lose exact repeats, then at most one near repeat.
    """
    header = (F.size(F.filter("cells", lambda c: c != "")) >= 2) & ~F.exists("cells", lambda c: is_number(c))
    on_page = Window.partitionBy("doc_id", "page").orderBy("row_no")
    # three rows of each page move, and of their cells only what may be a header
    top = rows.where("page is not null").select(
        "doc_id", "page", "row_no", F.when(header, _signature("cells")).alias("sig"),
        F.row_number().over(on_page).alias("at")).where("at <= 3")
    headers = top.groupBy("doc_id", "page").agg(F.collect_set("sig").alias("sigs")).groupBy("doc_id").agg(
        F.min("page").alias("first_page"), F.min_by("sigs", "page").alias("headers"))
    located = spread_by_page(rows, headers).withColumn("sig", _signature("cells"))
    later = F.col("page") > F.col("first_page")
    exact = F.array_contains("headers", F.col("sig"))
    near = F.exists("headers", lambda h: F.size(F.filter(
        F.zip_with(h, "sig", lambda a, b: (a != "") & (a == b)), lambda same: same)) >= F.greatest(
            F.lit(2), F.floor(F.size(h) * F.lit(0.6)).cast("int")))
    marked = located.withColumns({"exact": later & exact, "near": later & near}).drop("headers", "first_page", "sig")
    # a page of nothing but repeats has no start and vanishes
    start = F.min(F.when(~F.col("exact"), F.col("row_no"))).over(Window.partitionBy("doc_id", "page"))
    at = F.col("row_no")
    return marked.withColumn("start", start).where(
        (at > F.col("start")) | ((at == F.col("start")) & ~F.col("near"))).select(*rows.columns)


def drop_repeated_headers(rows: DataFrame) -> DataFrame:
    """Combined-sheet variant: later pages lose leading rows equal to a nearly full row of page one.

    The rows of page one go along as one list per document, no longer than a page.
    """
    first_page = rows.groupBy("doc_id").agg(F.min("page").alias("first_page"))
    full = (F.size("cells") >= 2) & (F.size(_filled("cells")) >= F.size("cells") - 1)
    headers = (
        spread_by_page(rows, first_page).where((F.col("page") == F.col("first_page")) & full)
        .groupBy("doc_id").agg(F.collect_set("cells").alias("headers"))
    )
    known = first_page.join(headers, "doc_id", "left")
    repeat = F.coalesce(F.array_contains("headers", F.col("cells")), F.lit(False))
    marked = spread_by_page(rows, known).withColumn("repeat", (F.col("page") > F.col("first_page")) & repeat).drop(
        "headers", "first_page")
    start = F.min(F.when(~F.col("repeat"), F.col("row_no"))).over(Window.partitionBy("doc_id", "page"))
    return marked.withColumn("start", start).where(F.col("row_no") >= F.col("start")).select(*rows.columns)


def _numeric_row(cells: Column | str) -> Column:
    return F.exists(cells, lambda c: is_number(c) | is_date(c))


def stack_wrapped_headers(rows: DataFrame) -> DataFrame:
    """Joins a wrapped header line to the line above it.

    Two neighbouring rows without numbers or dates merge when the lower row's two or
    more filled cells all lie under filled ones. In a run of such pairs every other
    one merges, which needs only the distance to the last row that cannot start one.
    """
    slim = rows.withColumn("numeric", _numeric_row("cells"))
    paired = ordered_scan(
        slim.withColumn("me", F.struct("cells", "numeric")), ["doc_id"], "page", ["row_no"],
        number="position", after={"below": "me"})
    under = F.zip_with("below.cells", "cells", lambda b, a: F.struct(
        (F.coalesce(strip(b), F.lit("")) != "").alias("b"), (F.coalesce(strip(a), F.lit("")) != "").alias("a")))
    fits = (F.size(F.filter(under, lambda u: u.b)) >= 2) & ~F.exists(under, lambda u: u.b & ~u.a)
    merges = F.coalesce(~F.col("numeric") & ~F.col("below.numeric") & fits, F.lit(False))
    # the second scan reads its input twice
    paired = stored(paired.withColumn("merges", merges).withColumn("stop", F.when(~F.col("merges"), F.col("position"))), "paired")
    scanned = ordered_scan(paired, ["doc_id"], "page", ["row_no"], before={"last_stop": "stop"})
    offset = F.col("position") - F.coalesce("last_stop", F.lit(0)) - 1
    starts = F.col("merges") & (offset % 2 == 0)
    # the row after a start is swallowed: it is not a start itself and its distance is odd
    swallowed = (offset % 2 == 1)
    joined = F.zip_with("cells", "below.cells", lambda a, b: F.when(
        F.coalesce(strip(b), F.lit("")) != "", strip(F.concat_ws(" ", a, b))).otherwise(F.coalesce(a, F.lit(""))))
    return scanned.withColumn("cells", F.when(starts, joined).otherwise(F.col("cells"))).where(~swallowed).select(*rows.columns)


_FIRST_WORD, _AFTER_FIRST_WORD = r"^(\S+)", r"^\S+\s+"


def _peeled(cell: Column, steps: Column, filled: Column) -> Column:
    """What `steps` splits make of a cell: the parts split off, what is left after each split, and the row's filled cells.

    A date followed by text comes off; so does the first word in a row of three or more filled cells; other text stays
    in the part and nothing is left.
    """
    texts = F.array().cast("array<string>")
    start = F.struct(texts.alias("parts"), texts.alias("left"), cell.alias("rest"), filled.cast("int").alias("filled"))

    def split(state: Column, _: Column) -> Column:
        text = strip(state["rest"])
        dated = text.rlike(V.DATE_THEN_TEXT)
        label = (state["filled"] >= 3) & text.rlike(r"^\S+\s+\S")
        part = F.when(dated, F.regexp_extract(text, V.DATE_THEN_TEXT, 1)).when(
            label, F.regexp_extract(text, _FIRST_WORD, 1)).otherwise(state["rest"])
        rest = F.when(dated, F.regexp_extract(text, V.DATE_THEN_TEXT, 2)).when(
            label, F.regexp_replace(text, _AFTER_FIRST_WORD, "")).otherwise("")
        return F.struct(
            F.concat(state["parts"], F.array(part)).alias("parts"), F.concat(state["left"], F.array(rest)).alias("left"),
            rest.alias("rest"), F.when(dated | label, state["filled"] + 1).otherwise(state["filled"]).alias("filled"))

    return F.aggregate(F.slice(F.sequence(F.lit(0), steps), 2, steps), start, split)


def _splits() -> tuple[list[Column], Column]:
    """Counts of `text` per column, and whether a column with these counts is split."""
    hit = strip("text").rlike(V.DATE_THEN_TEXT)
    counts = [
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"),
        F.count_if(hit & is_number(F.regexp_extract(strip("text"), V.DATE_THEN_TEXT, 2))).alias("numeric")]
    return counts, F.expr("n >= 3 and (hits >= 6 or hits / n >= 0.5) and not numeric > hits * 0.4")


def date_splits(rows: DataFrame) -> DataFrame:
    """(doc_id, splits): how often each column of a document is to be split; documents without a split are absent.

    A split leaves other columns' texts alone and its own first part never starts a date with text, so whether a column is split at all
    follows from one count of its texts. How often follows from one more count, of what each split would leave. What
    gathers per document is a number per column and split, not rows.
    """
    counts, good = _splits()
    # every split takes a word at least, and the last one stands at the last date with text behind it
    reach = F.regexp_extract(strip("text"), V.TEXT_TO_LAST_DATE, 0)
    depth = F.when(reach != "", F.size(F.split(reach, r"\s+")) - 1).otherwise(0)
    first = stored(
        long_cells(rows, "doc_id").where(strip("text") != "").groupBy("doc_id", "col").agg(*counts, F.max(depth).alias("depth"))
        .where(good).select("doc_id", "col", "depth"), "split_columns")
    per_document = first.groupBy("doc_id").agg(in_order(F.collect_list(F.struct("col", "depth"))).alias("chosen"))
    told = spread_by_page(rows.select("doc_id", "page", "cells"), per_document)
    told = told.withColumn("filled", F.size(_filled("cells"))).select(
        "doc_id", "cells", "filled", "chosen", F.explode("chosen").alias("at")).where(strip(F.get("cells", F.col("at.col"))) != "")
    # with two filled cells the other one, if it is split before, makes the row a header-like one
    earlier = F.filter("chosen", lambda c: (c.col < F.col("at.col")) & F.coalesce(
        strip(F.get("cells", c.col)).rlike(V.DATE_THEN_TEXT), F.lit(False)))
    left = _peeled(F.get("cells", F.col("at.col")), F.col("at.depth"), F.col("filled") + F.size(earlier))["left"]
    levels = told.select("doc_id", F.col("at.col").alias("col"), F.posexplode(left).alias("level", "text"))
    on_column = Window.partitionBy("doc_id", "col").orderBy("level")
    further = (
        levels.where(strip("text") != "").groupBy("doc_id", "col", "level").agg(*counts).where(good)
        .withColumn("_nr", F.row_number().over(on_column) - 1).where("level = _nr")
        .groupBy("doc_id", "col").agg(F.count(F.lit(1)).cast("int").alias("more")))
    found = first.join(further, ["doc_id", "col"], "left").select("doc_id", "col", (F.coalesce("more", F.lit(0)) + 1).alias("n"))
    by_column = found.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "n"))).alias("by_column"), F.max("col").alias("last"))
    return by_column.select("doc_id", F.transform(
        F.sequence(F.lit(0), F.col("last")), lambda j: F.coalesce(F.try_element_at("by_column", j), F.lit(0))).alias("splits"))


def split_leading_date(rows: DataFrame) -> DataFrame:
    """Splits columns of 'date more text' in two, leftmost first, until none is left.

    The number of splits of each column is known beforehand (`date_splits`), so the rows are rewritten once. A row too
    short for a column is not made longer. Null cells count as blank.
    """
    told = spread_by_page(rows, date_splits(rows), "left")
    nothing = F.struct(F.array().cast("array<string>").alias("cells"), F.size(_filled("cells")).alias("filled"))

    def next_cell(state: Column, j: Column) -> Column:
        cell = F.coalesce(F.get("cells", j), F.lit(""))
        done = _peeled(cell, F.coalesce(F.get("splits", j), F.lit(0)), state["filled"])
        return F.struct(F.concat(state["cells"], done["parts"], F.array(done["rest"])).alias("cells"), done["filled"].alias("filled"))

    places = F.slice(F.sequence(F.lit(-1), F.size("cells") - 1), 2, F.size("cells"))
    split = F.aggregate(places, nothing, next_cell)["cells"]
    return told.withColumn("cells", F.when(F.col("splits").isNull(), F.col("cells")).otherwise(split)).select(*rows.columns)


def split_anchor_date(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Splits the date column of a document (doc_id, anchor_col) where text follows the date in half of its rows or more.

    Rows of one cell are prose: they do not count and stay. Text that begins with a time counts as no text, so
    a column of dates with times stays whole. In a document that is split every row of several cells gets a cell more.
    """
    anchored = stored(spread_by_page(rows, anchors.select("doc_id", "anchor_col"), "left"), "anchored")
    cell = F.coalesce(strip(F.get("cells", F.col("anchor_col"))), F.lit(""))
    date = F.trim(F.regexp_extract(cell, V.DATE_PREFIX, 0))
    rest = strip(F.regexp_replace(cell, V.DATE_PREFIX, ""))
    wide = (F.size("cells") > 1) & F.col("anchor_col").isNotNull()
    glued = (date != "") & (rest != "") & ~rest.rlike(V.TIME_FIRST)
    telling = anchored.where(wide).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(glued).alias("hits")).where(
        "hits >= n * 0.5").select("doc_id", F.lit(True).alias("_split"))
    told = spread_by_page(anchored, telling, "left")
    two = F.when(date != "", F.array(date, rest)).otherwise(F.array(cell, F.lit("")))
    at = F.col("anchor_col")
    tail = F.slice("cells", at + 2, F.greatest(F.size("cells") - at - 1, F.lit(0)))
    split = F.concat(F.slice("cells", F.lit(1), at), two, tail)
    return told.withColumn("cells", F.when(wide & F.col("_split"), split).otherwise(F.col("cells"))).select(*rows.columns)


def detect_header_row(rows: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The fullest row (more than two cells, no amount) above the first row with an amount; null without one."""
    keys = list(keys)
    at = F.struct("page", "row_no")
    has_number = F.exists("cells", lambda c: cell_kind(c) == "number")
    first = rows.groupBy(*keys).agg(F.min(F.when(has_number, at)).alias("first_number"))
    located = rows.join(rows.select(*keys, "page").distinct().join(first, keys), [*keys, "page"])
    filled = F.size(_filled("cells"))
    ok = ~has_number & (filled > 2) & (F.col("first_number").isNull() | (at < F.col("first_number")))
    rank = F.when(ok, F.struct(filled, -F.col("page"), -F.col("row_no")))
    return located.groupBy(*keys).agg(
        F.max_by(at, rank).alias("at"), F.max_by("cells", rank).alias("cells")
    ).select(*keys, F.col("at.page").alias("page"), F.col("at.row_no").alias("row_no"), "cells")


def concat_grids(rows: DataFrame) -> DataFrame:
    """Pages stacked to one table per document: `row` runs over the document, cells padded to the widest row."""
    width = rows.groupBy("doc_id").agg(F.max(F.size("cells")).alias("width"))
    numbered = ordered_scan(rows, ["doc_id"], "page", ["row_no"], number="row")
    padding = F.array_repeat(F.lit(""), F.col("width") - F.size("cells"))
    return spread_by_page(numbered, width, pages=rows).withColumn("cells", F.concat("cells", padding)).drop("width")
