"""Words or lines to ledgers: geometry candidates, reconstruction, validation, choice of the best.

Stages that are read more than once are written to the shared folder, so nothing is
computed twice and a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as V
from ..operators import geometry, ledger
from ..session import stored


def named_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line_no, y, cells) with their role and one text per ledger column, stored.

    Documents without a header drop out.
    """
    header = stored(ledger.find_header(lines), "header")
    mapping = stored(ledger.repair_mapping(header, ledger.column_kinds(ledger.body_lines(ledger.marked_cells(lines), header))), "mapping")
    return stored(ledger.named_cells(ledger.split_lines(lines, header), mapping), "named")


def ledger_of(named: DataFrame) -> DataFrame:
    """Checked ledger rows with `seq`, `opening` and `verdict` of named lines; documents without a dated line drop out."""
    rows = ledger.fold_transactions(ledger.nearest_anchor(named))
    folded = stored(rows, "folded")
    return ledger.check_continuity(
        folded, key="doc_id", order=("page", "line_no"), chunk="page", number="seq", openings=ledger.opening_balances(named))


def lines_to_ledger(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line_no, y, cells) to checked ledger rows with `seq`, `opening` and `verdict`.

    Documents without a header or a dated line drop out.
    """
    return ledger_of(named_lines(lines))


def stored_lines(words: DataFrame) -> DataFrame:
    """The lines of the words, stored; plans that need them in several steps make them once."""
    return stored(geometry.to_lines(geometry.cluster_rows(words)), "lines")


def candidate_lines(lines: DataFrame) -> DataFrame:
    """Lines with cells for the document-wide geometries that differ, numbered by `ord`; the lines are read several times.

    Of geometries with equal cells only the first is kept; ties would choose it anyway.
    """
    seps = stored(geometry.distinct_geometries(geometry.column_separators(lines)), "separators")
    tags = [(g, s) for g in V.MIN_GAPS for s in V.COVER_SHARES]
    number = F.coalesce(*[
        F.when((F.col("min_gap") == g) & (F.col("share") == s), i) for i, (g, s) in enumerate(tags)])
    cells = geometry.assign_columns(lines, seps).withColumns({"ord": number, "y": F.col("top")})
    return cells.where(F.exists("words", lambda w: w.text != "")).drop("words")


def per_candidate(lines: DataFrame) -> DataFrame:
    """Document and candidate as one key, so all candidates run in the same jobs."""
    return lines.withColumn("doc_id", F.struct("doc_id", "ord")).drop("ord")


def per_document(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "doc_id"]
    return df.select("doc_id.doc_id", "doc_id.ord", *rest)


def words_to_ledger(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen summaries, their checked ledger rows) per document; documents without a ledger drop out."""
    lines = stored(per_candidate(candidate_lines(stored_lines(words))).select("doc_id", "page", "line_no", "y", "cells"), "cells")
    checked = stored(lines_to_ledger(lines), "checked")
    best = ledger.pick_statement(per_document(ledger.statement_summary(checked, key="doc_id", order=("page", "line_no"))))
    best = stored(best, "chosen")
    rows = per_document(checked)
    pages = rows.select("doc_id", "ord", "page").distinct().join(best.select("doc_id", "ord"), ["doc_id", "ord"])
    return best, rows.join(pages, ["doc_id", "ord", "page"])
