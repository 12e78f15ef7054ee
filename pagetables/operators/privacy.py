"""Field extraction, sensitive values, redaction and checksum validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..functions.cells import bind, in_order, strip
from ..functions.ids import aadhaar_is_valid, gstin_is_valid
from ..functions.prefixes import cut, pieces, running_max, running_sum

# word boundary over ASCII word characters, whatever the Java version does
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
# patterns that may begin with a character outside words
_OPEN_STARTS = (r"[A-Za-z0-9._%+\-]", r"(?:\+91")
# what a text must hold before a pattern is tried; the others need a run of digits
_NEEDS = {
    "IFSC": "[A-Z]{4}0", "Email": "@", "Emails": "@", "Invoice No.": "(?i)bill|inv", "Amounts": "[₹RI]",
    "Dates": r"\d[/\-.]\d", "DIN": "(?i)din",
}
_DIGIT_RUN = "[0-9]{4}"
# set around matches, and what stands for it where a text has it
_MARK, _OTHER = "\x01", "\x02"
# characters per bucket of the span join
_BUCKET = 64


def ascii_words(pattern: str) -> str:
    """The pattern with ASCII word boundaries; in front of or behind a word character one look is enough."""
    flag, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    if body.startswith(r"\b") and not body[2:].startswith(_OPEN_STARTS):
        body = r"(?<!\w)" + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + r"(?!\w)"
    return flag + body.replace(r"\b", _BOUNDARY)


def _may_hold(text: Column, name: str) -> Column:
    need = _NEEDS.get(name, _DIGIT_RUN)
    if need == "@":
        return text.contains(need)
    return text.contains("0") & text.rlike(need) if name == "IFSC" else text.rlike(need)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(ascii_words(pattern)), F.lit(0))


def extract_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """Long table of fields: the given keys, field, ord, value; distinct values in reading order."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, r"\s+", " "), F.lit(" "))
    keys = [c for c in docs.columns if c != text]
    docs = docs.withColumn("_t", spaced).withColumn("_digits", F.col("_t").rlike(_DIGIT_RUN))
    none = F.array().cast("array<string>")

    def found(name: str, pattern: str) -> Column:
        needed = _may_hold(F.col("_t"), name) if name in _NEEDS else F.col("_digits")
        return F.when(needed, F.array_distinct(F.transform(_all(F.col("_t"), pattern), lambda v: F.trim(v)))).otherwise(none)

    values = {n: found(n, p) for n, p, _ in V.FIELD_PATTERNS}
    values["TAN"] = F.array_except(values["TAN"], values["PAN"])
    for name, _, cap in V.FIELD_PATTERNS:
        if cap:
            values[name] = F.slice(values[name], 1, cap)
    bags = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("found")) for n, v in values.items()])
    return (
        docs.select(*keys, F.explode_outer(bags).alias("bag"))
        .select(*keys, "bag.field", F.posexplode("bag.found").alias("ord", "value"))
    )


def _scannable(docs: DataFrame, text: str) -> DataFrame:
    """Adds what `_matched` reads: `_digits`, whether the text has a run of digits, and `_marked`, the text free for marks.

    No pattern takes in a control character or tells two of them apart, so one may stand for the other.
    """
    free = F.when(F.col(text).contains(_MARK), F.translate(F.col(text), _MARK, _OTHER)).otherwise(F.col(text))
    return docs.withColumns({"_digits": F.col(text).rlike(_DIGIT_RUN), "_marked": free})


def _matched(text: str, patterns: list[tuple[str, str, float]]) -> Column:
    """Per pattern a struct (rank, type, conf, parts): the text cut at both ends of every match, so that matches and the text
    between them alternate; no parts where no match can be, a single one where none is. Takes one search of the text."""
    def one(rank: int, name: str, pattern: str, conf: float) -> Column:
        # a number of a director has digits too, and they are known already
        needed = F.col("_digits") if name not in _NEEDS else _may_hold(F.col(text), name)
        needed = F.col("_digits") & needed if name == "DIN" else needed
        parts = F.split(F.regexp_replace("_marked", ascii_words(pattern), f"{_MARK}$0{_MARK}"), _MARK, -1)
        return F.struct(
            F.lit(rank).alias("rank"), F.lit(name).alias("type"), F.lit(conf).alias("conf"), F.when(needed, parts).alias("parts"))

    return F.array(*[one(i, *p) for i, p in enumerate(patterns)])


def _spans(parts: Column) -> Column:
    """The matches with their character spans; positions are running sums over matches and the text between, so the time
    grows with the length of the text. Built once for all patterns, since an expression costs time for its size."""
    def span(value: Column, end: Column) -> Column:
        return F.struct(value.alias("value"), (end - F.length(value)).alias("start"), end.alias("end"))

    def length(i: Column | int) -> Column:
        return F.length(F.get(parts, i))

    def placed(before: Column) -> Column:
        ends = running_sum(F.transform(before, lambda i: length(i) + length(i + 1)))
        return F.zip_with(before, ends, lambda i, end: span(F.get(parts, i + 1), end))

    # behind the last match there is text but no match; most texts have one match of a kind
    return F.when(F.size(parts) == 3, F.array(span(F.get(parts, 1), length(0) + length(1)))).when(
        F.size(parts) > 3, placed(F.sequence(F.lit(0), F.size(parts) - 3, F.lit(2))))


def scan_sensitive(pages: DataFrame, text: str = "text") -> DataFrame:
    """Every match of every type: keys, type, value, conf, start, end (0-based characters); types may overlap."""
    keys = [c for c in pages.columns if c != text]
    return (
        _scannable(pages, text)
        .select(*keys, F.explode_outer(_matched(text, V.SENSITIVE_PATTERNS)).alias("f")).where(F.size("f.parts") > 1)
        # an outer generator, since the optimizer would find the spans once more for the test of another
        .select(*keys, "f.type", "f.conf", F.explode_outer(_spans(F.col("f.parts"))).alias("h"))
        .select(*keys, "type", "h.value", "conf", "h.start", "h.end")
    )


def joined_fragments(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page texts with one blank between fragments, and each fragment with its character span."""
    order = Window.partitionBy("doc_id", "page").orderBy("word_no")
    end = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    spans = words.withColumn("frag_end", end.cast("int")).withColumn("frag_start", F.col("frag_end") - F.length("text"))
    ordered = in_order(F.collect_list(F.struct("word_no", "text")))
    pages = words.groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda e: e.text), " ").alias("text"))
    return pages, spans


def locate_detections(fragments: DataFrame, detections: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Boxes of detections as page fractions: the fragments a match touches, padded and clamped.

    Spans meet through 64-character buckets, so a match only sees fragments near it.
    """
    def bucketed(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn("_bucket", F.explode(F.sequence(
            F.floor(F.col(start) / _BUCKET), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / _BUCKET))))

    frags = bucketed(fragments.select("doc_id", "page", "frag_start", "frag_end", "x0", "x1", "top", "bottom"), "frag_start", "frag_end")
    hits = bucketed(detections, "start", "end")
    # merged: the planner judges detections by the size of the table that their texts come from, and would send them all to the driver
    touching = frags.join(hits.hint("merge"), ["doc_id", "page", "_bucket"]).where("frag_start < end and frag_end > start")
    boxes = touching.groupBy("doc_id", "page", "type", "value", "conf", "start", "end").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    return boxes.select(
        "doc_id", "page", "type", "value", "conf", "start", "end",
        F.greatest(F.lit(0.0), F.col("x0") / page_width - 0.003).alias("x"),
        F.greatest(F.lit(0.0), F.col("top") / page_height - 0.005).alias("y"),
        F.least(F.lit(1.0), (F.col("x1") - F.col("x0")) / page_width + 0.006).alias("w"),
        F.least(F.lit(1.0), (F.col("bottom") - F.col("top")) / page_height + 0.01).alias("h"),
    )


def scan_tokens(words: DataFrame, text: str = "text") -> DataFrame:
    """One detection per word and type whose pattern occurs in the word."""
    hits = F.filter(
        F.array(*[F.when(F.col(text).rlike(ascii_words(p)), F.struct(F.lit(n).alias("type"), F.lit(c).alias("conf")))
                  for n, p, c in V.SENSITIVE_PATTERNS]),
        lambda h: h.isNotNull())
    # most words hold neither a digit nor an at sign and skip the patterns
    hits = F.when(F.col(text).rlike("[0-9@]"), hits)
    return words.withColumn("_hit", F.explode_outer(hits)).where("_hit is not null").select(
        *words.columns, "_hit.type", "_hit.conf")


def _areas(hits: Column) -> Column:
    """Sorted matches (start, end, rank) as disjoint areas: what overlaps is one, with the least rank."""
    reach = running_max(F.transform(hits, lambda h: h.end))

    def united(h: Column, most: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i).start >= F.get(most, i - 1)))

        def areas(at: Column) -> Column:
            return F.transform(at, lambda i, k: bind(F.coalesce(F.get(at, k + 1), F.size(h)), lambda stop: F.struct(
                F.get(h, i).start.alias("start"), F.get(most, stop - 1).alias("end"),
                F.array_min(F.transform(F.slice(h, i + 1, stop - i), lambda x: x["rank"])).alias("rank"))))

        return bind(first, areas)

    return bind(reach, lambda most: united(hits, most))


def redact(docs: DataFrame, text: str = "text", min_conf: float = 0.0) -> DataFrame:
    """Every character of every match masked: matches that overlap become one [type], named after the surest.

    Texts without matches stay as they are. The time grows with the length of a text and the number of its matches.
    """
    chosen = sorted((p for p in V.SENSITIVE_PATTERNS if p[2] >= min_conf), key=lambda p: -p[2])
    types = F.array(*[F.lit(n) for n, _, _ in chosen])
    none = F.array().cast("array<struct<start:int,end:int,rank:int>>")
    per_type = F.transform(_matched(text, chosen), lambda f: F.coalesce(F.transform(
        _spans(f.parts), lambda h: F.struct(h.start.alias("start"), h.end.alias("end"), f["rank"].alias("rank"))), none))
    hits = in_order(F.flatten(per_type)) if chosen else none

    def masked(areas: Column, parts: Column) -> Column:
        # each area with the text since the one before it
        written = F.transform(areas, lambda a, k: F.concat(
            cut(parts, F.coalesce(F.get(areas, k - 1).end, F.lit(0)), a.start), F.lit("["), F.element_at(types, a["rank"] + 1), F.lit("]")))
        rest = cut(parts, F.element_at(areas, -1).end, F.length(F.col(text)))
        return F.concat(F.array_join(written, ""), rest)

    found = _scannable(docs, text).withColumn("_hits", hits)
    whole = bind(F.col("_hits"), lambda h: bind(_areas(h), lambda areas: bind(pieces(F.col(text)), lambda parts: masked(areas, parts))))
    return found.withColumn(text, F.when(F.size("_hits") > 0, whole).otherwise(F.col(text))).drop("_digits", "_marked", "_hits")


def verify_redaction(redacted: DataFrame, text: str = "text") -> DataFrame:
    """Values still found, per type; empty when nothing leaks."""
    return scan_sensitive(redacted, text).groupBy("type").agg(
        F.count(F.lit(1)).alias("leaks"), F.countDistinct("doc_id").alias("docs"))


def validate_ids(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct identifiers per document with the result of their shape or checksum test."""
    keys = [c for c in docs.columns if c != text]
    patterns = {n: p for n, p, _ in V.SENSITIVE_PATTERNS}
    shapes = dict(V.CHECKED_SHAPES)
    bags = F.array(*[
        F.struct(F.lit(n).alias("type"), F.when(_may_hold(F.col(text), n), F.array_distinct(_all(F.col(text), patterns[n]))).alias("values"))
        for n in shapes])
    found = docs.select(*keys, F.explode_outer(bags).alias("b")).select(*keys, "b.type", F.explode("b.values").alias("value"))
    ok = (
        F.when(F.col("type") == "GSTIN", gstin_is_valid("value"))
        .when(F.col("type") == "Aadhaar", aadhaar_is_valid("value"))
        .when(F.col("type") == "PAN", F.col("value").rlike(shapes["PAN"]))
        .when(F.col("type") == "CIN", F.col("value").rlike(shapes["CIN"]))
        .otherwise(F.col("value").rlike(shapes["IFSC"]))
    )
    return found.withColumn("ok", ok)


def pii_inventory(detections: DataFrame) -> DataFrame:
    """Detections by source and type with subtotals: matches, distinct values, documents touched."""
    # matches are first counted per value and document, so subtotals add up short rows
    slim = detections.groupBy("source", "type", "value", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return slim.cube("source", "type").agg(
        F.sum("n").alias("n_matches"),
        F.countDistinct("value").alias("n_values"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.grouping_id().cast("int").alias("level"),
    )
