"""Writers of tables and ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scans import ordered_scan
from ..operators.grid import concat_grids, drop_repeated_headers
from ..operators.ledger import preamble, review_report, review_rows, statement_summary, validation_report, warnings
from ..session import stored


def csv_line(cells: Column | str) -> Column:
    """Cells as one CSV line; quotes only where needed."""
    return F.array_join(F.transform(cells, lambda c: F.when(
        c.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)), ",")


def bucket_of(doc: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")


def write_tables(rows: DataFrame, path: str, layout: str = "one", fmt: str = "parquet", buckets: int = 256) -> None:
    """Table rows to files, in folders by document bucket, never one folder per document.

    layout 'one': pages stacked, repeated headers dropped, `row` over the document;
    'per_page': page and row number kept. CSV output is (doc_id, page, row, one text line).
    Rows are spread by document and page, so one huge document uses many writers.
    """
    if layout == "one":
        # read three times: for the widths, the rows of each page, and the rows themselves; numbering leaves them spread by page
        out = concat_grids(stored(drop_repeated_headers(rows), "kept"))
    else:
        out = rows.withColumn("row", F.col("row_no").cast("long")).repartition("doc_id", "page")
    out = out.select("doc_id", "page", "row", "cells").withColumn("bucket", bucket_of("doc_id", buckets))
    out = out.sortWithinPartitions("bucket", "doc_id", "page", "row")
    if fmt == "csv":
        out = out.select("bucket", "doc_id", "page", "row", csv_line("cells").alias("line"))
    writer = out.write.mode("errorifexists").partitionBy("bucket")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_statement_bundle(
    checked: DataFrame, path: str, roles: DataFrame | None = None, key: str = "account_id", preamble_lines: int | None = None,
    **columns,
) -> None:
    """Ledger with review flags, totals, validation items, warnings, rows to review and preamble (its first `preamble_lines`, if given).

    The ledger is written first; all that follows from it is read from the files written, so `checked` is computed once.
    Parts go to a folder of this call and the manifest, written last, names it: a call that is repeated or broken off
    leaves no double rows. `columns` are those of `statement_summary`. Read it with `read_statement_bundle`.
    """
    spark = checked.sparkSession
    run = f"{path}/parts/{uuid.uuid4().hex}"
    flag = F.when(F.col("verdict").isin("bad", "missing"), "CHECK").otherwise("")
    flagged = checked.withColumn("review", flag)
    flagged.write.parquet(f"{run}/ledger")
    book = spark.read.schema(flagged.schema).parquet(f"{run}/ledger")
    summary = statement_summary(book, key, **columns)
    money = {k: columns[k] for k in ("debit", "credit") if k in columns}
    summary.write.parquet(f"{run}/summary")
    summary = spark.read.schema(summary.schema).parquet(f"{run}/summary")
    parts = {
        "totals": review_report(book, key, **money), "validation": validation_report(summary, key),
        "warnings": warnings(summary, key), "review_rows": review_rows(book)}
    if roles is not None:
        numbered = ordered_scan(preamble(roles), ["doc_id"], "page", ["line_no"], number="ord")
        parts["preamble"] = numbered if preamble_lines is None else numbered.where(F.col("ord") <= preamble_lines)
    for name, rows in parts.items():
        rows.write.parquet(f"{run}/{name}")
    names = ["ledger", "summary", *parts]
    spark.createDataFrame([(n, f"{run}/{n}") for n in names], "part string, folder string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/manifest")


def read_statement_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of the last bundle that was written whole, by name."""
    return {r["part"]: spark.read.parquet(r["folder"]) for r in spark.read.parquet(f"{path}/manifest").collect()}
