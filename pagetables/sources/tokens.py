"""Readers of token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.cells import strip

# the twelve TSV columns of an OCR run
OCR_COLUMNS = (
    "level int, page_num int, block_num int, par_num int, line_num int, word_num int, "
    "left double, top double, width double, height double, conf string, text string"
)


def read_ocr_tokens(
    spark: SparkSession,
    path: str,
    min_conf: float = 25.0,
    scale_x: float = 1.0,
    scale_y: float = 1.0,
    document: str = "column",
    header: bool = True,
) -> DataFrame:
    """OCR TSV files to words in points: level 5, text not blank, confidence high enough or unreadable.

    The document is a leading doc_id column, or with document='file' the file name.
    """
    schema = f"doc_id long, {OCR_COLUMNS}" if document == "column" else OCR_COLUMNS
    raw = spark.read.csv(path, sep="\t", schema=schema, header=header, quote="", escape="", mode="PERMISSIVE")
    if document == "file":
        raw = raw.select("*", F.col("_metadata.file_name").alias("doc_id"))
    conf = F.col("conf").try_cast("double")
    return (
        raw.where("level = 5")
        .withColumn("text", strip("text"))
        .where((F.col("text") != "") & F.coalesce(conf >= min_conf, F.lit(True)))
        .select(
            "doc_id",
            F.col("page_num").alias("page"),
            "block_num", "line_num",
            F.col("word_num").alias("word_no"),
            (F.col("left") * scale_x).alias("x0"),
            ((F.col("left") + F.col("width")) * scale_x).alias("x1"),
            (F.col("top") * scale_y).alias("top"),
            ((F.col("top") + F.col("height")) * scale_y).alias("bottom"),
            "text",
            conf.alias("conf"),
        )
    )


def normalize_words(items: DataFrame) -> DataFrame:
    """Text items (x, baseline from the page bottom, width, height, text, page_height) to words from the top."""
    text = strip("text")
    height = F.coalesce(F.nullif(F.col("height"), F.lit(0.0)), F.lit(8.0))
    width = F.coalesce(F.nullif(F.col("width"), F.lit(0.0)), F.length(text) * height * 0.5)
    line = F.col("page_height") - F.col("baseline")
    return items.where(text != "").select(
        "doc_id", "page", "word_no",
        F.col("x").alias("x0"),
        (F.col("x") + width).alias("x1"),
        (line - height).alias("top"),
        (line + height * 0.25).alias("bottom"),
        text.alias("text"),
        F.lit(None).cast("double").alias("conf"),
    )
