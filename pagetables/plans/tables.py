"""Words to generic tables: layouts compete per page and per document, the best is cleaned up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions.scans import spread_by_page
from ..operators import geometry, grid
from ..session import stored
from .statements import candidate_lines, per_candidate, per_document, stored_lines

# the whitespace layouts in order; a ruled one stands before them
_TAGS = [(g, s) for g in V.MIN_GAPS for s in V.COVER_SHARES]
# number of the layout put together page by page, behind the document-wide ones
PER_PAGE = len(_TAGS)
RULE_DISTANCE = 2.0


def _ruled_rows(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of the cells between rules, as wide as the fullest row of their page."""
    merged = geometry.merge_rules(rules, RULE_DISTANCE).select("doc_id", "page", "orient", "pos")
    cells = stored(geometry.lattice_cells(words, merged), "ruled")
    width = cells.groupBy("doc_id", "page").agg((F.max("col_no") + 1).cast("int").alias("width"))
    rows = cells.groupBy("doc_id", "page", "row_no").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("col_no").cast("int").alias("j"), "text"))).alias("by_column"))
    filled = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda j: F.coalesce(F.try_element_at("by_column", j), F.lit("")))
    return rows.join(width, ["doc_id", "page"]).select(
        "doc_id", "page", F.lit(0).alias("ord"), F.lit("ruled").alias("engine"), F.col("row_no").cast("int").alias("row_no"), filled.alias("cells"))


def page_candidates(words: DataFrame, rules: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, page, ord, engine, row_no, cells) of the layouts of each page: between rules, if given, and by whitespace.

    Of whitespace layouts with equal cells only the first is kept; ties would choose it anyway. No step needs more than
    one page together. `lines` are those of the words, if they are stored already.
    """
    lines = stored_lines(words) if lines is None else lines
    seps = stored(geometry.distinct_geometries(geometry.column_separators(lines, scope="page")), "separators")
    number = F.coalesce(*[F.when((F.col("min_gap") == g) & (F.col("share") == s), i + 1) for i, (g, s) in enumerate(_TAGS)])
    streams = geometry.assign_columns(lines, seps).where(F.exists("words", lambda w: w.text != "")).select(
        "doc_id", "page", number.alias("ord"), F.concat(F.lit("stream-"), F.col("min_gap").cast("int").cast("string")).alias("engine"),
        F.col("line_no").cast("int").alias("row_no"), "cells")
    return streams if rules is None else streams.unionByName(_ruled_rows(words, rules))


def page_tables(words: DataFrame, rules: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, engine, row_no, cells): the best-scoring layout of every page, repeated headers gone.

    A whitespace layout replaces a ruled one that loses many rows (see `pick_page_candidate`). `lines` are those of the
    words, if they are stored already.
    """
    rows = stored(page_candidates(words, rules, lines), "candidates")
    scored = grid.score_grid(rows, keys=("doc_id", "page", "ord"))
    engines = rows.select("doc_id", "page", "ord", "engine").distinct()
    picked = stored(grid.pick_page_candidate(scored.join(engines, ["doc_id", "page", "ord"])), "picked")
    return grid.link_pages(stored(rows.join(picked.select("doc_id", "page", "ord"), ["doc_id", "page", "ord"]).drop("ord"), "chosen"))


def layout_candidates(words: DataFrame, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Linked rows of each document-wide layout and of the best layouts page by page, stored, and the engines used.

    (doc_id and ord as one key, page, row_no, cells); (doc_id, engines). Then what they are made of, stored: the lines of
    the words, and the lines of each document-wide layout (doc_id and ord as one key, page, line_no, y, cells).
    """
    lines = stored_lines(words)
    wide = stored(per_candidate(candidate_lines(lines)).select("doc_id", "page", "line_no", "y", "cells"), "cells")
    chosen = stored(page_tables(words, rules, lines), "paged")
    paged = chosen.select(F.struct("doc_id", F.lit(PER_PAGE).alias("ord")).alias("doc_id"), "page", "row_no", "cells")
    rows = wide.select("doc_id", "page", F.col("line_no").alias("row_no"), "cells")
    linked = stored(grid.link_pages(rows).unionByName(paged), "linked")
    engines = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_set("engine")).alias("engines"))
    return linked, engines, lines, wide


def best_layout(linked: DataFrame) -> DataFrame:
    """(doc_id, ord, score, n_rows): the layout of each document that scores best."""
    scored = per_document(grid.score_grid(linked)).select("doc_id", "ord", "score", "n_rows")
    return stored(grid.pick_document_candidate(scored), "chosen")


def finished_tables(linked: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of the layouts chosen, dates split and headers stacked."""
    flat = per_document(linked)
    pages = flat.select("doc_id", "ord", "page").distinct().join(best.select("doc_id", "ord"), ["doc_id", "ord"])
    rows = flat.join(pages, ["doc_id", "ord", "page"]).drop("ord")
    return grid.stack_wrapped_headers(stored(grid.split_leading_date(rows), "split"))


def words_to_tables(words: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The best-scoring layout per document, with repeated headers gone, dates split, headers stacked.

    The document-wide layouts compete with the one that takes the best layout of each page.
    """
    linked = layout_candidates(words, rules)[0]
    return finished_tables(linked, best_layout(linked))


def dated_records(words: DataFrame) -> DataFrame:
    """Rows (doc_id, page, row_no, cells): a record per date and the lines under it, other lines as one cell of prose.

    Columns come from the lines between the first and the last date of all pages. Text behind the date of a record gets a cell of its
    own; columns that are nearly empty go.
    """
    lines = stored(geometry.to_lines(geometry.cluster_rows_tol(words)), "lines")
    regions = stored(geometry.region(lines), "regions")
    cells = stored(geometry.cells_between(lines, geometry.region_separators(lines, regions, words)).drop("words"), "cells")
    inside = cells.join(regions, ["doc_id", "page"]).where(F.col("line_no").between(F.col("first_line"), F.col("last_line")))
    found = geometry.date_anchor_column(inside.select("doc_id", "page", "cells"))
    # a document without a date has no records, but its lines stay
    anchors = stored(cells.select("doc_id").distinct().join(found, "doc_id", "left").fillna(0, ["anchor_col"]), "anchors")
    records = geometry.fold_by_anchor(cells.select("doc_id", "page", "line_no", "cells"), regions, anchors)
    rows = stored(records.select("doc_id", "page", F.col("line_no").alias("row_no"), "cells"), "records")
    return grid.drop_sparse_columns(stored(grid.split_anchor_date(rows, anchors), "split"))


def record_tables(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (doc_id, page, row_no, cells) of documents by the way that suits them.

    A document of which most pages are ruled is read between its rules, any other as dated records. A page
    of words without rules counts as a page that is not ruled; words outside all rules of a ruled document are not part of a table.
    """
    # a page without rules must count among the pages of its document
    pages = words.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(None).cast("string").alias("orient"))
    modes = stored(geometry.choose_mode(rules.select("doc_id", "page", "orient").unionByName(pages)).select("doc_id", "mode"), "modes")
    told = stored(spread_by_page(words, modes), "told")
    ruled = _ruled_rows(told.where("mode = 'lattice'").drop("mode"), rules).select("doc_id", "page", "row_no", "cells")
    records = dated_records(told.where("mode = 'stream'").drop("mode"))
    return ruled.unionByName(records.withColumn("row_no", F.col("row_no").cast("int")))
