"""Watched folders: arriving page files get types, scripts, fields and sensitive values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.privacy import extract_fields, scan_sensitive
from ..operators.profile import classify_doc_type, script_hint


def watch_folder(spark: SparkSession, path: str, schema: str = "doc_id long, page int, text string",
                 fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of pages from new files of a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def typed_pages(pages: DataFrame) -> DataFrame:
    return script_hint(classify_doc_type(pages)).select(
        "doc_id", "page", "doc_type", "script", F.length("text").alias("n_chars"))


def page_fields(pages: DataFrame) -> DataFrame:
    return extract_fields(pages)


def page_detections(pages: DataFrame) -> DataFrame:
    return scan_sensitive(pages)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that handles what is there and ends."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
