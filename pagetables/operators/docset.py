"""Operations on sets of paged documents: merge, select, split, reorder, number, paginate, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scans import BLOCK, ordered_scan, range_chunks, spread_by_page

# pages of one document per chunk of a scan
PAGE_CHUNK = 1024


def merge_docs(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages of several documents as bundles; `order` has bundle_id, ord, doc_id.

    Pages are renumbered over the bundle. A document may occur in several bundles or twice in one.
    """
    # the place of a document in its bundle, counted over parts of equal size, groups the chunks
    ranked = ordered_scan(
        range_chunks(order, ["bundle_id", "ord", "doc_id"]), ["bundle_id"], "_range", ["ord", "doc_id"], number="_rank").drop("_range")
    joined = spread_by_page(pages, ranked)
    chunk = F.struct("_rank", F.floor(F.col("page") / PAGE_CHUNK).alias("block"))
    return ordered_scan(
        joined, ["bundle_id"], chunk, ["page"], number="new_page", block=F.floor(F.col("_rank") / BLOCK)).drop("_rank")


def page_ranges(spec: Column | str) -> Column:
    """'1-3,5,8-10', 'all', 'odd' or 'even' as an array of (low, high, step), high null meaning the last page.

    Reversed ranges are swapped, junk is ignored. Nothing is expanded to single pages.
    """
    spec = F.col(spec) if isinstance(spec, str) else spec

    def part_range(part: Column) -> Column:
        # absurdly long numbers mean a page far behind the end
        a = F.coalesce(F.regexp_extract(part, r"^(\d+)", 1).try_cast("long"), F.lit(2**62))
        last = F.regexp_extract(part, r"-\s*(\d+)$", 1)
        b = F.when(last == "", a).otherwise(F.coalesce(last.try_cast("long"), F.lit(2**62)))
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.greatest(a, b)
        return F.when(part.rlike(r"^\d+(\s*-\s*\d+)?$"), _range(low, high, 1))

    def _range(low: Column, high: Column, step: int) -> Column:
        return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(step).alias("step"))

    parts = F.filter(F.transform(F.split(spec, ","), lambda p: part_range(F.trim(p))), lambda r: r.isNotNull())
    endless = F.lit(None)
    return (
        F.when(spec == "all", F.array(_range(F.lit(1), endless, 1)))
        .when(spec == "odd", F.array(_range(F.lit(1), endless, 2)))
        .when(spec == "even", F.array(_range(F.lit(2), endless, 2)))
        .otherwise(parts)
    )


def select_pages(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Pages named by a spec per document (doc_id, spec), in the order of the spec; adds new_page.

    A page counts where the spec names it first; pages beyond the document do not exist.
    """
    joined = spread_by_page(pages, specs.select("doc_id", page_ranges("spec").alias("_ranges")))
    page = F.col("page")
    named = F.transform("_ranges", lambda r: (page >= r.low) & (page <= F.coalesce(r.high, page)) & ((page - r.low) % r.step == 0))
    placed = joined.withColumn("_first", F.array_position(named, True)).where("_first > 0").drop("_ranges")
    chunk = F.struct("_first", F.floor(page / PAGE_CHUNK).alias("block"))
    return ordered_scan(placed, ["doc_id"], chunk, ["page"], number="new_page").drop("_first")


def split_pages(pages: DataFrame, mode: str = "every", n: int = 1, specs: DataFrame | None = None) -> DataFrame:
    """Adds `part` (from 1) and `part_page`; mode 'every' n pages, 'single', or 'ranges' with specs."""
    if mode == "ranges":
        return select_pages(pages, specs).withColumn("part", F.lit(1)).withColumnRenamed("new_page", "part_page")
    n = 1 if mode == "single" else n
    i = F.col("page") - 1
    return pages.withColumns({
        "part": (F.floor(i / n) + 1).cast("int"), "part_page": (i % n + 1).cast("int")})


def reorder_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages in the positions of a manifest (doc_id, position, page): moved, repeated, or left out."""
    return pages.join(manifest, ["doc_id", "page"])


def number_pages(pages: DataFrame, fmt: str = "n", prefix: str = "") -> DataFrame:
    """Adds `label`: the page number, or 'Page n of m', behind an optional prefix."""
    chunk = F.floor(F.col("page") / PAGE_CHUNK)
    numbered = ordered_scan(pages, ["doc_id"], chunk, ["page"], number="_n")
    if fmt == "nofm":
        total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_m"))
        numbered = spread_by_page(numbered, total)
        label = F.concat(F.lit("Page "), F.col("_n").cast("string"), F.lit(" of "), F.col("_m").cast("string"))
    else:
        label = F.col("_n").cast("string")
    if prefix:
        label = F.concat(F.lit(prefix + "   •   "), label)
    return numbered.withColumn("label", label).drop("_n", "_m")


def paginate_text(docs: DataFrame, size: float = 11.0, page: tuple[float, float] = (595.28, 841.89), margin: float = 48.0) -> DataFrame:
    """Texts as monospaced pages: (doc_id, page, line_on_page, text).

    Tabs become four blanks, long lines are cut to the page width, an empty line stays a line.
    """
    height = size * 1.45
    max_chars = int((page[0] - 2 * margin) // (size * 0.6))
    lines_per_page, y = 0, page[1] - margin
    while not y < margin:
        lines_per_page, y = lines_per_page + 1, y - height
    raw = F.split(F.replace("text", F.lit("\t"), F.lit("    ")), r"\r?\n")
    pieces = F.flatten(F.transform(raw, lambda s: F.when(F.length(s) <= max_chars, F.array(s)).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.floor((F.length(s) - 1) / max_chars).cast("int")),
            lambda k: F.substring(s, k * max_chars + 1, F.lit(max_chars))))))
    keys = [c for c in docs.columns if c != "text"]
    i = F.col("i")
    return docs.select(*keys, F.posexplode_outer(pieces).alias("i", "text")).where("i is not null").select(
        *keys, (F.floor(i / lines_per_page) + 1).cast("int").alias("page"),
        (i % lines_per_page + 1).cast("int").alias("line_on_page"), "text")


def _token_counts(pages: DataFrame, name: str) -> DataFrame:
    tokens = pages.select("doc_id", F.explode_outer(F.split("text", r"\s+")).alias("token")).where("token <> ''")
    return tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias(name))


def compare_versions(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words added and removed per document as multisets: (diff rows, summary).

    Both sides are counted per token before they meet. A word that only moved shows no difference.
    """
    zero = F.lit(0)
    both = _token_counts(a, "old_n").join(_token_counts(b, "new_n"), ["doc_id", "token"], "full").select(
        "doc_id", "token", F.coalesce("old_n", zero).alias("old_n"), F.coalesce("new_n", zero).alias("new_n"))
    change = F.col("new_n") - F.col("old_n")
    diff = both.where("old_n <> new_n").select(
        "doc_id", "token", "old_n", "new_n", F.when(change > 0, "add").otherwise("del").alias("op"))
    summary = both.groupBy("doc_id").agg(
        F.sum(F.greatest(change, zero)).alias("added"), F.sum(F.greatest(-change, zero)).alias("removed"),
        F.sum(F.least("old_n", "new_n")).alias("same"),
    ).withColumn("identical", (F.col("added") == 0) & (F.col("removed") == 0))
    return diff, summary


def compare_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per page: only_a, only_b, changed or same, by the hash of the text."""
    def hashed(pages: DataFrame, name: str) -> DataFrame:
        return pages.select("doc_id", "page", F.sha2("text", 256).alias(name))

    both = hashed(a, "ha").join(hashed(b, "hb"), ["doc_id", "page"], "full")
    return both.select("doc_id", "page", F.when(F.col("hb").isNull(), "only_a").when(F.col("ha").isNull(), "only_b").when(
        F.col("ha") == F.col("hb"), "same").otherwise("changed").alias("state"))
