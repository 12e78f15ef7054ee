"""Positioned words to lines, columns, cells and records.

Words: doc_id, page, word_no, x0, x1, top, bottom, text. A page is the unit that stays
together (it is bounded by paper size); a document never has to be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..functions.cells import bind, in_order, long_cells, starts_with_date, strip
from ..functions.scans import spread_by_page
from ..session import stored

PAGE = ["doc_id", "page"]


# --- lines -------------------------------------------------------------------

def cluster_rows(words: DataFrame) -> DataFrame:
    """Adds `line_no` (from 1 per page): a line ends where a word starts below everything before it."""
    order = Window.partitionBy(*PAGE).orderBy("top", "x0", "word_no")
    above = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    height = F.greatest(F.lit(2.0), F.col("bottom") - F.col("top"))
    breaks = F.coalesce(F.col("top") > above - F.least(F.lit(3.0), height * 0.25), F.lit(True))
    flagged = words.withColumn("_new", breaks.cast("int"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn("line_no", F.sum("_new").over(so_far).cast("int")).drop("_new")


def _upper_median(values: Column) -> Column:
    """The element at half the length of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def cluster_rows_tol(words: DataFrame, tol: float | None = None) -> DataFrame:
    """Adds `line_no` by vertical tolerance: a gap above `tol` (default 0.6 x median height) between
    neighbouring word centres starts a line."""
    centre = (F.col("top") + F.col("bottom")) / 2
    words = words.withColumn("_cy", centre)
    order = Window.partitionBy(*PAGE).orderBy("_cy", "x0", "word_no")
    if tol is None:
        # the upper median, found once for a page; a list of heights would be sorted again for each word
        words = words.withColumn("_h", F.col("bottom") - F.col("top")).withColumn("_tol", F.expr(
            "percentile_disc(0.5) WITHIN GROUP (ORDER BY _h DESC) OVER (PARTITION BY doc_id, page)") * 0.6).drop("_h")
    else:
        words = words.withColumn("_tol", F.lit(float(tol)))
    words = words.withColumn(
        "_new", F.coalesce(F.col("_cy") - F.lag("_cy").over(order) > F.col("_tol"), F.lit(True)).cast("int"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return words.withColumn("line_no", F.sum("_new").over(so_far).cast("int")).drop("_cy", "_new", "_tol")


def to_lines(clustered: DataFrame) -> DataFrame:
    """One row per line with its words by x (reuses the partitioning of the clustering)."""
    return clustered.groupBy(*PAGE, "line_no").agg(
        F.min("top").alias("top"),
        F.max("bottom").alias("bottom"),
        in_order(F.collect_list(F.struct("x0", "top", "word_no", "x1", "text"))).alias("words"),
    )


def line_gaps(words: Column | str = "words") -> Column:
    """Horizontal gaps between neighbouring words of a line."""
    words = F.col(words) if isinstance(words, str) else words
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))),
        lambda i: F.get(words, i)["x0"] - F.get(words, i - 1)["x1"])


def line_text(words: Column | str = "words") -> Column:
    return F.array_join(F.transform(words, lambda w: w.text), " ")


def page_text(words: DataFrame) -> DataFrame:
    """Reading-order text per page: blanks collapsed, one row of text per line, empty lines dropped."""
    return text_of_lines(to_lines(cluster_rows(words)))


def text_of_lines(lines: DataFrame) -> DataFrame:
    """`page_text` of words that are lines already."""
    lines = lines.withColumn("text", F.trim(F.regexp_replace(line_text(), r"\s+", " "))).where("text <> ''")
    ordered = in_order(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda e: e.text), "\n").alias("text"))


# --- column separators -------------------------------------------------------

def column_separators(
    lines: DataFrame,
    min_gaps: Sequence[float] = tuple(V.MIN_GAPS),
    shares: Sequence[float] = tuple(V.COVER_SHARES),
    scope: str = "document",
) -> DataFrame:
    """Separators from whitespace coverage: key, min_gap, share, seps array<double> (possibly empty),
    and n_wide, the number of lines that are no prose under the gap.

    One pass counts, per 2-point bin, how many words of each kind of line begin to cover
    or cease to cover it (two increments per word, summed map-side); the line kind that
    serves as basis is chosen afterwards on the histogram, which is no longer than a page is wide.
    """
    keys = ["doc_id"] if scope == "document" else PAGE
    floors = {g: max(g, V.GAP_FLOOR) for g in min_gaps}
    gaps = line_gaps()

    def tabular(floor: float) -> Column:
        return F.size(F.filter("gaps", lambda g: g >= floor)) >= 2

    kinds = {f"tab{i}": tabular(f) for i, f in enumerate(floors.values())}
    marked = lines.withColumn("gaps", gaps).select(
        *keys, "words", F.array_max("gaps").alias("widest"), *[k.alias(n) for n, k in kinds.items()], (F.size("words") > 1).alias("multi"),
        F.lit(True).alias("any"))
    names = [*kinds, "multi", "any"]
    stats = marked.groupBy(*keys).agg(
        *[F.count_if(n).alias(f"n_{n}") for n in names],
        *[F.count_if(F.col("widest") >= f).alias(f"wide{i}") for i, f in enumerate(floors.values())],
        F.min(F.array_min(F.transform("words", lambda w: w.x0))).alias("min_x"),
        F.max(F.array_max(F.transform("words", lambda w: w.x1))).alias("max_x"),
    )

    def bin_of(x: Column) -> Column:
        return F.floor(x / V.BIN).cast("int")

    steps = marked.select(
        *keys, *names,
        F.explode_outer(F.flatten(F.transform("words", lambda w: F.array(
            F.struct(F.greatest(bin_of(w.x0), F.lit(0)).alias("bin"), F.lit(1).alias("d")),
            F.struct((bin_of(w.x1) + 1).alias("bin"), F.lit(-1).alias("d")))))).alias("step"),
    )
    histogram = steps.groupBy(*keys, F.col("step.bin").alias("bin")).agg(
        *[F.sum(F.when(F.col(n), F.col("step.d")).otherwise(0)).alias(n) for n in names])
    # the scan starts at the leftmost word even when the basis starts further right
    start = stats.select(*keys, bin_of(F.col("min_x")).alias("bin"), *[F.lit(0).cast("long").alias(n) for n in names])
    histogram = histogram.unionByName(start).groupBy(*keys, "bin").agg(*[F.sum(n).alias(n) for n in names])

    # all candidates share one pass over the bins of a key: a column per gap and per (gap, share)
    order = Window.partitionBy(*keys).orderBy("bin")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    table = histogram.join(stats, keys)
    cover, low = {}, {}
    for i in range(len(min_gaps)):
        tab = f"tab{i}"
        basis = F.when(F.col(f"n_{tab}") >= 3, tab).when(F.col("n_multi") >= 2, "multi").otherwise("any")

        def chosen(prefix: str, tab: str = tab, basis: Column = basis) -> Column:
            return F.when(basis == tab, F.col(prefix + tab)).when(basis == "multi", F.col(prefix + "multi")).otherwise(
                F.col(prefix + "any"))

        cover[f"cover{i}"] = F.sum(chosen("")).over(upto)
        for k, share in enumerate(shares):
            low[f"low{i}_{k}"] = F.col(f"cover{i}") <= F.greatest(F.lit(1), F.floor(chosen("n_") * share))
    marked_bins = table.withColumns(cover).withColumns(low)
    was = {f"was_{n}": F.coalesce(F.lag(n).over(order), F.lit(False)) for n in low}
    marked_bins = marked_bins.withColumns(was)
    opened = {
        f"at_{n}": F.last(F.when(F.col(n) & ~F.col(f"was_{n}"), F.col("bin")), ignorenulls=True).over(ahead) for n in low}
    marked_bins = marked_bins.withColumns(opened)

    def separator(n: str, gap: float) -> Column:
        closes = ~F.col(n) & F.col(f"was_{n}") & ((F.col("bin") - F.col(f"at_{n}")) * V.BIN >= gap)
        return F.array_sort(F.collect_list(F.when(closes, (F.col(f"at_{n}") + F.col("bin")) / 2 * V.BIN)))

    wide = marked_bins.groupBy(*keys).agg(
        *[F.max(f"wide{i}").alias(f"wide{i}") for i in range(len(min_gaps))], F.max("n_any").alias("n_any"),
        *[separator(f"low{i}_{k}", gap).alias(f"seps{i}_{k}") for i, gap in enumerate(min_gaps) for k in range(len(shares))])
    found = wide.select(*keys, "n_any", F.explode_outer(F.array(*[
        F.struct(F.lit(gap).alias("min_gap"), F.lit(share).alias("share"), F.col(f"wide{i}").alias("n_wide"),
                 F.col(f"seps{i}_{k}").alias("seps"))
        for i, gap in enumerate(min_gaps) for k, share in enumerate(shares)])).alias("g")).select(*keys, "n_any", "g.*")
    if scope == "page":
        # a page of one line has no columns
        found = found.withColumn(
            "seps", F.when(F.col("n_any") < 2, F.array().cast("array<double>")).otherwise(F.col("seps")))
    return found.drop("n_any")


def _band(x: Column, seps: Column | str = "seps") -> Column:
    return F.size(F.filter(seps, lambda s: s <= x))


def _is_prose(words: Column, min_gap: Column) -> Column:
    return _is_narrow(_widest_gap(words), min_gap)


def _widest_gap(words: Column | str = "words") -> Column:
    """The widest gap between neighbouring words of a line, null for a line of one word."""
    return F.when(F.size(words) > 1, F.array_max(line_gaps(words)))


def _is_narrow(widest: Column, min_gap: Column) -> Column:
    return F.coalesce(widest < F.greatest(min_gap, F.lit(V.GAP_FLOOR)), F.lit(False))


def _cells_by_band(words: Column, seps: Column) -> Column:
    """Texts per column by where the middle of each word lies; columns without a word cost one look."""
    middles = F.transform(words, lambda w: (w.x0 + w.x1) / 2)
    own = F.transform(middles, lambda x: _band(x, seps))
    texts = F.transform(words, lambda w: w.text)
    return bind(texts, lambda ts: bind(own, lambda b: F.transform(
        F.sequence(F.lit(0), F.size(seps)),
        lambda j: F.when(F.array_contains(b, j), F.array_join(F.filter(ts, lambda _, i: F.get(b, i) == j), " ")).otherwise(""))))


def cells_of_line(words: Column, seps: Column, prose: Column) -> Column:
    """Texts per column; a line of prose stays whole in the band of its first word."""
    first = F.get(words, 0)
    whole = bind(_band((first.x0 + first.x1) / 2, seps), lambda at: F.transform(
        F.sequence(F.lit(0), F.size(seps)), lambda j: F.when(j == at, line_text(words)).otherwise("")))
    return F.when(prose, whole).otherwise(_cells_by_band(words, seps))


def assign_columns(lines: DataFrame, seps: DataFrame) -> DataFrame:
    """Lines to `cells` arrays, one row per line and geometry in `seps` (document or page scope).

    The cells of a line depend on the separators and on whether it is prose under the gap, so they are made once for all
    geometries that agree in both.
    """
    keys = [c for c in PAGE if c in seps.columns]
    tagged = seps.groupBy(*keys, "seps").agg(F.collect_list(F.struct("min_gap", "share")).alias("tags"))
    geo = tagged.groupBy(*keys).agg(F.collect_list(F.struct("seps", "tags")).alias("geo"))
    measured = lines.withColumn("_widest", _widest_gap())
    joined = measured.join(geo, PAGE) if "page" in keys else spread_by_page(measured, geo)

    def of_kind(prose: bool) -> Column:
        return F.struct(F.lit(prose).alias("prose"), F.filter(
            "geo.tags", lambda t: _is_narrow(F.col("_widest"), t.min_gap) == prose).alias("tags"))

    # an outer generator, since the optimizer would make the kinds once more for the test of another
    per_kind = joined.withColumn("geo", F.explode("geo")).select(
        *lines.columns, "geo.seps", F.explode_outer(F.array(of_kind(False), of_kind(True))).alias("kind")).where(F.size("kind.tags") > 0)
    cells = cells_of_line(F.col("words"), F.col("seps"), F.col("kind.prose"))
    return per_kind.select(*lines.columns, "kind.tags", cells.alias("cells")).select(
        *lines.columns, F.explode("tags").alias("tag"), "cells").select(*lines.columns, "tag.min_gap", "tag.share", "cells")


def global_geometry(lines: DataFrame) -> DataFrame:
    """Lines with cells under every document-wide geometry (gap and share candidates).

    The lines are read several times; store them first.
    """
    return assign_columns(lines, stored(column_separators(lines), "separators"))


def distinct_geometries(seps: DataFrame) -> DataFrame:
    """Without geometries that give a document (or page) the same cells as an earlier one.

    Cells depend on the separators and on which lines count as prose; the wide lines
    of a larger gap are among those of a smaller one, so equal counts are equal sets.
    """
    keys = [c for c in PAGE if c in seps.columns]
    first = F.struct("min_gap", "share")
    return seps.groupBy(*keys, "seps", "n_wide").agg(F.min(first).alias("first")).select(
        *keys, "first.min_gap", "first.share", "seps")


# --- ruled tables ------------------------------------------------------------

def merge_rules(rules: DataFrame, min_dist: float) -> DataFrame:
    """Rule positions no further apart than `min_dist` (chained) become their mean."""
    keys = [*PAGE, "orient"]
    order = Window.partitionBy(*keys).orderBy("pos")
    new = F.coalesce(F.col("pos") - F.lag("pos").over(order) > min_dist, F.lit(True)).cast("int")
    grouped = rules.withColumn("_new", new).withColumn(
        "_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(*keys, "_group").agg(F.avg("pos").alias("pos"), F.count(F.lit(1)).alias("n_merged")).drop("_group")


def choose_mode(rules: DataFrame, enough: int = 5, share: float = 0.6) -> DataFrame:
    """'lattice' when enough pages have enough vertical and horizontal rules, else 'stream'."""
    pages = rules.groupBy(*PAGE).agg(
        F.count_if(F.col("orient") == "v").alias("n_v"), F.count_if(F.col("orient") == "h").alias("n_h"))
    ruled = (F.col("n_v") >= enough) & (F.col("n_h") >= enough)
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(ruled).alias("n_ruled")
    ).withColumn("mode", F.when(F.col("n_ruled") >= F.col("n_pages") * share, "lattice").otherwise("stream"))


def lattice_cells(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Words into the cells between vertical and horizontal rules: doc_id, page, row_no, col_no, text.

    Words outside are dropped; empty cells and rows do not appear.
    """
    def sorted_rules(orient: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("orient") == orient, F.col("pos"))))

    edges = rules.groupBy(*PAGE).agg(sorted_rules("v").alias("v"), sorted_rules("h").alias("h"))
    lined = cluster_rows_tol(words).join(edges, PAGE)

    def within(x: Column, at: str) -> Column:
        return (F.get(at, 0) <= x) & (x < F.get(at, F.size(at) - 1))

    # what lies outside goes by two comparisons; a test of the band itself would find it once more
    across, down = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    placed = lined.where(within(down, "h") & within(across, "v")).withColumns({
        "row_no": _band(down, F.col("h")) - 1, "col_no": _band(across, F.col("v")) - 1})
    ordered = in_order(F.collect_list(F.struct("line_no", "x0", "word_no", "text")))
    return placed.groupBy(*PAGE, "row_no", "col_no").agg(
        F.trim(F.regexp_replace(F.array_join(F.transform(ordered, lambda e: e.text), " "), r"\s+", " ")).alias("text"))


# --- records of several lines ------------------------------------------------

def region(lines: DataFrame) -> DataFrame:
    """First and last line per page with a date in the left 55 % of the page's word span."""
    span = Window.partitionBy(*PAGE)
    low = F.min(F.array_min(F.transform("words", lambda w: w.x0))).over(span)
    high = F.max(F.array_max(F.transform("words", lambda w: w.x1))).over(span)
    limited = lines.withColumn("limit", low + (high - low) * 0.55)
    left = line_text(F.filter("words", lambda w: w.x0 < F.col("limit")))
    dated = limited.where(left.rlike(V.DATE_ANYWHERE))
    return dated.groupBy(*PAGE).agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def region_separators(lines: DataFrame, regions: DataFrame, words: DataFrame, share: float = 0.1) -> DataFrame:
    """(doc_id, seps): middles of the gaps that at most `share` of the lines of all regions of a document cover.

    A gap is at least 3 points and half the median word height wide. A document without any region counts
    all its lines. Lines are counted once per 2-point bin, map-side; what is left per document is no longer than a page is wide.
    """
    marked = lines.join(regions, PAGE, "left").withColumn(
        "inside", F.coalesce(F.col("line_no").between(F.col("first_line"), F.col("last_line")), F.lit(False)))
    per_line = marked.select(
        "doc_id", "inside", F.array_min(F.transform("words", lambda w: w.x0)).alias("low"),
        F.array_max(F.transform("words", lambda w: w.x1)).alias("high"))
    facts = per_line.groupBy("doc_id").agg(
        F.min("low").alias("min_x"), F.max("high").alias("max_x"), F.count(F.lit(1)).alias("n_all"), F.count_if("inside").alias("n_inside"))
    # the upper median, over counted heights
    counted = words.select("doc_id", (F.col("bottom") - F.col("top")).alias("h")).groupBy("doc_id").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY h DESC)").alias("height"))
    facts = facts.join(counted, "doc_id").withColumns({
        "n_bins": F.floor((F.col("max_x") - F.col("min_x")) / V.BIN) + 2,
        "least": F.greatest(F.lit(1.5 * V.BIN), F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(10.0)) * 0.5)})
    facts = stored(facts, "region_facts")
    placed = spread_by_page(marked.select("doc_id", "page", "inside", "words"), facts.select("doc_id", "min_x", "n_inside"))

    def bin_of(x: Column) -> Column:
        return F.floor((x - F.col("min_x")) / V.BIN)

    used = placed.where(F.col("inside") | (F.col("n_inside") == 0)).select("doc_id", F.explode_outer(F.array_distinct(F.flatten(
        F.transform("words", lambda w: F.sequence(bin_of(w.x0), F.greatest(bin_of(w.x0), bin_of(w.x1))))))).alias("bin")).where("bin is not null")
    cover = used.groupBy("doc_id", "bin").agg(F.count(F.lit(1)).alias("n")).join(facts, "doc_id")
    basis = F.when(F.col("n_inside") > 0, F.col("n_inside")).otherwise(F.col("n_all"))
    solid = cover.where(F.col("n") > F.floor(F.greatest(F.lit(1), basis) * share)).select("doc_id", "bin")
    # the bins before the first and behind the last one end a gap too
    ends = facts.select("doc_id", F.explode(F.array(F.lit(-1).cast("long"), F.col("n_bins"))).alias("bin"))
    edges = solid.unionByName(ends).withColumn("next", F.lead("bin").over(Window.partitionBy("doc_id").orderBy("bin")))
    gaps = edges.join(facts.select("doc_id", "min_x", "least"), "doc_id")
    middle = F.col("min_x") + (F.col("bin") + 1 + F.col("next")) / 2 * V.BIN
    wide = (F.col("next") - F.col("bin") - 1 > 0) & ((F.col("next") - F.col("bin") - 1) * V.BIN >= F.col("least"))
    return gaps.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(wide, middle))).alias("seps"))


def cells_between(lines: DataFrame, seps: DataFrame) -> DataFrame:
    """Lines to `cells` by where the middle of each word lies; no line is kept whole."""
    return spread_by_page(lines, seps).withColumn("cells", _cells_by_band(F.col("words"), F.col("seps"))).drop("seps")


def date_anchor_column(rows: DataFrame) -> DataFrame:
    """Leftmost column with at least 60 % of the most date votes; 0 without any date."""
    votes = long_cells(rows, "doc_id").groupBy("doc_id", "col").agg(
        F.count_if(starts_with_date("text")).alias("votes"))
    per_doc = votes.groupBy("doc_id").agg(
        F.max("votes").alias("most"), F.collect_list(F.struct("col", "votes")).alias("all"))
    good = F.filter("all", lambda e: (e.votes >= F.col("most") * F.lit(0.6)) & (F.col("most") > 0))
    return per_doc.select("doc_id", F.coalesce(F.array_min(F.transform(good, lambda e: e.col)), F.lit(0)).alias("anchor_col"))


def _fold(records: DataFrame) -> DataFrame:
    """Joins the cells of the lines of a record, column by column."""
    grouped = records.groupBy(*PAGE, "record", "prose").agg(
        in_order(F.collect_list(F.struct("line_no", "cells"))).alias("parts"))
    width = F.array_max(F.transform("parts", lambda p: F.size(p.cells)))
    joined = F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.array_join(
        F.filter(F.transform("parts", lambda p: F.get(p.cells, j)), lambda c: F.coalesce(c, F.lit("")) != ""), " "))
    return grouped.select(
        *PAGE, F.get("parts", 0)["line_no"].alias("line_no"), "prose", F.size("parts").alias("n_lines"), joined.alias("cells"))


def _prose(cells: str = "cells") -> Column:
    return F.array(F.array_join(F.filter(cells, lambda c: strip(c) != ""), " "))


def fold_by_anchor(rows: DataFrame, regions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Undated lines of the region join the record above; lines outside become one-cell prose.

    rows: doc_id, page, line_no, cells.
    """
    joined = rows.join(regions, PAGE, "left")
    joined = joined.join(
        joined.select(*PAGE).distinct().join(anchors, "doc_id"), PAGE)
    inside = F.coalesce(F.col("line_no").between(F.col("first_line"), F.col("last_line")), F.lit(False))
    starts = ~F.col("inside") | (F.col("line_no") == F.col("first_line")) | starts_with_date(F.get("cells", F.col("anchor_col")))
    order = Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = joined.withColumn("inside", inside).withColumn("_new", starts.cast("int"))
    records = marked.withColumn("record", F.sum("_new").over(order)).withColumn("prose", ~F.col("inside")).withColumn(
        "cells", F.when(F.col("prose"), _prose()).otherwise(F.col("cells")))
    return _fold(records.where(F.size(F.filter("cells", lambda c: c != "")) > 0))


def fold_by_gap(rows: DataFrame) -> DataFrame:
    """Below the fullest line a record starts only after a large vertical gap, if large gaps are telling.

    rows: doc_id, page, line_no, cy, height, cells.
    """
    page = Window.partitionBy(*PAGE)
    order = page.orderBy("line_no")
    filled = F.size(F.filter("cells", lambda c: strip(c) != ""))
    gapped = rows.withColumn("gap", F.col("cy") - F.lag("cy").over(order)).withColumn("filled", filled)
    positive = F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))).over(page)
    heights = F.collect_list("height").over(page)
    gapped = gapped.withColumns({
        "limit": F.coalesce(_upper_median(positive), _upper_median(heights)) * 1.5,
        "header_line": F.max_by("line_no", F.struct("filled", -F.col("line_no"))).over(page),
    })
    n_gaps, n_big = F.count("gap").over(page), F.count_if(F.col("gap") > F.col("limit")).over(page)
    gapped = gapped.withColumns({"n_gaps": n_gaps, "n_big": n_big})
    telling = (F.col("n_gaps") > 0) & (
        F.col("n_big") >= F.greatest(F.lit(1), F.floor(F.col("n_gaps") * 0.15))) & (F.col("n_big") <= F.col("n_gaps") * 0.75)
    above = F.col("line_no") < F.col("header_line")
    starts = (F.col("line_no") <= F.col("header_line")) | ~telling | (F.col("gap") > F.col("limit"))
    marked = gapped.withColumn("prose", above).withColumn("_new", starts.cast("int")).withColumn(
        "record", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return _fold(marked.withColumn("cells", F.when(F.col("prose"), _prose()).otherwise(F.col("cells"))))


def nearest_column(items: DataFrame, col_gap: float) -> DataFrame:
    """Adds `col_no`: anchors are x positions more than `col_gap` right of the last anchor of the page.

    The few distinct x of a page are folded in order; an item takes the nearest anchor, the left one on a tie.
    """
    xs = items.groupBy(*PAGE).agg(F.array_sort(F.collect_set("x0")).alias("xs"))
    anchors = F.aggregate(
        "xs", F.array().cast("array<double>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) > col_gap), F.concat(acc, F.array(x))).otherwise(acc))
    joined = items.join(xs.withColumn("anchors", anchors).drop("xs"), PAGE)
    ranked = F.transform("anchors", lambda a, k: F.struct(F.abs(a - F.col("x0")).alias("d"), k.alias("k")))
    return joined.withColumn("col_no", F.array_min(ranked)["k"]).drop("anchors")
