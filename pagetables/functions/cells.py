"""Typing of cell texts: amounts, dates, kinds, Indian number format.

Everything is built from native expressions, so a projection over cells stays in
one generated stage. Regexes see ASCII digits and blanks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_values as V

AMOUNT = "decimal(38,4)"

_FRACTION = r"(?:\.\d{1,4})?"
# a bare trailing dot is fine behind a whole number, or behind Cr/Dr
_PLAIN = (
    rf"\s*-?\s*(?:{V.DIGITS}{_FRACTION}\s*(?:(?:cr|dr)\.?)?|{V.DIGITS}\s*\.)"
)
_BRACKETED = rf"\(\s*-?\s*{V.DIGITS}{_FRACTION}\s*\)\s*(?:(?:cr|dr)\.?)?"
_BARE = r"^(?:[0-9]{1,3}(?:,[0-9]{2,3})*|[0-9]+)(?:\.[0-9]{1,4})?\z"
MONEY = rf"(?i)^(?:{_PLAIN}|{_BRACKETED})$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, body) -> Column:
    """`body` over a value that is computed once; a plain Python name would repeat the expression in each use."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def in_order(structs: Column) -> Column:
    """Structs without nulls among them, sorted: as `array_sort`, whose comparison is an expression evaluated for each pair."""
    return F.sort_array(structs)


# blanks cut off at both ends
_BLANKS = " \t\n\r\f\v"


def long_cells(rows: DataFrame, *keys: str, value: str = "text") -> DataFrame:
    """Rows with `cells` to one row per cell (keys, col, value).

    The outer generator keeps the optimizer from testing the array first, which would
    compute a derived `cells` several times.
    """
    return rows.select(*keys, F.posexplode_outer("cells").alias("col", value)).where("col is not null")


def strip(col: Column | str) -> Column:
    """Trim every kind of ASCII blank, null becomes ''."""
    return F.coalesce(F.btrim(_c(col), F.lit(_BLANKS)), F.lit(""))


def one_line(col: Column | str) -> Column:
    """Collapse blanks and trim."""
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def _unmarked(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, V.CURRENCY, ""), F.lit(_BLANKS))


def is_bare_amount(s: Column) -> Column:
    """Whether a text without blanks around it is digits, commas and one dot at most in the way of an amount; no date is."""
    return s.rlike(_BARE)


def is_amount(s: Column) -> Column:
    """`is_number` of a text without blanks around it."""
    # an amount without currency marks matches at once; only marked texts are rewritten
    marked = s.rlike("[0-9]") & s.rlike(V.CURRENCY) & _unmarked(s).rlike(MONEY)
    return s.rlike(MONEY) | marked


def is_number(col: Column | str) -> Column:
    return is_amount(strip(col))


def parse_number(col: Column | str) -> Column:
    """Amount as decimal(38,4), null when the text is not an amount.

    Brackets and Dr make it negative, a leading minus flips the sign.
    """
    def amount(s: Column) -> Column:
        value = F.regexp_replace(s, r"[^0-9.]|\.\D*$", "").try_cast(AMOUNT)
        debit = s.rlike(r"(?i)^\(|dr\.?$")
        minus = s.rlike(r"^\(?\s*-")
        return F.when(debit != minus, -value).otherwise(value)

    # most amounts are digits and commas alone, without a sign or mark to look for
    return bind(strip(col), lambda s: F.when(is_bare_amount(s), F.translate(s, ",", "").try_cast(AMOUNT)).when(
        is_amount(s), bind(_unmarked(s), amount)))


_YEAR = r"(?!0000)\d{4}"
DATE_SHAPE = (
    rf"^(?:\d{{1,2}}([/\-.])\d{{1,2}}\1{_YEAR}|\d{{1,2}}([/\-])\d{{1,2}}\2\d{{2}}"
    rf"|\d{{1,2}}-[A-Za-z]{{3}}-(?:{_YEAR}|\d{{2}})|\d{{1,2}} [A-Za-z]{{3,9}} {_YEAR}"
    rf"|{_YEAR}-\d{{1,2}}-\d{{1,2}})$"
)
_FULL_DATE = rf"^\d{{1,2}}([/\-.])\d{{1,2}}\1{_YEAR}\z"
_SHORT_YEAR = r"^(\d{1,2}([/\-])(?:\d{1,2}|[A-Za-z]{3})\2)"


def parse_date(col: Column | str) -> Column:
    """Date from one of ten day-first or ISO layouts, null otherwise."""
    return date_of(strip(col))


def _day_first_to_iso(s: Column) -> Column:
    return F.regexp_replace(s, r"^(\d{1,2})([/\-.])(\d{1,2})\2(\d{4})$", "$4-$3-$1")


def date_of(s: Column) -> Column:
    """`parse_date` of a text without blanks around it."""
    # each step rewrites the text of the one before: short years, then day-first to ISO
    full = F.regexp_replace(s, _SHORT_YEAR + r"(69|[7-9]\d)$", "$119$3")
    full = F.regexp_replace(full, _SHORT_YEAR + r"(\d\d)$", "$120$3")
    iso = _day_first_to_iso(full)
    named = F.translate(full, " ", "-")
    value = F.when(
        s.rlike("[A-Za-z]"),
        F.coalesce(F.try_to_date(named, "d-MMM-yyyy"), F.try_to_date(named, "d-MMMM-yyyy")),
    ).otherwise(iso.try_cast("date"))
    # a date in full needs one rewriting only
    return F.when(s.rlike(_FULL_DATE), _day_first_to_iso(s).try_cast("date")).when(s.rlike(DATE_SHAPE), value)


def is_date(col: Column | str) -> Column:
    return parse_date(col).isNotNull()


def cell_kind(col: Column | str) -> Column:
    """'empty', 'date', 'number' or 'text'; a date is tried before a number."""
    s = strip(col)
    return F.when(s == "", "empty").when(is_date(s), "date").when(is_number(s), "number").otherwise("text")


def lead_date(col: Column | str) -> Column:
    """Date of a cell, or of its first token when other text bled in."""
    def date(s: Column) -> Column:
        first = bind(F.regexp_extract(s, r"^(\S+)", 1), date_of)
        # every layout starts with a digit
        return F.when(F.substring(s, 1, 1).between("0", "9"), F.coalesce(date_of(s), first))

    return bind(strip(col), date)


def behind_lead_date(col: Column | str) -> Column:
    """Text behind the leading date ('' when the cell is all date), blanks collapsed."""
    def behind(s: Column) -> Column:
        rest = one_line(F.regexp_replace(s, r"^\S+", ""))
        first = bind(F.regexp_extract(s, r"^(\S+)", 1), date_of)
        return F.when(date_of(s).isNotNull(), "").when(first.isNotNull(), rest).otherwise(s)

    return bind(strip(col), behind)


def decimal_tokens(col: Column | str) -> Column:
    """How many decimal amounts a cell holds."""
    c = _c(col)
    return F.when(c.rlike(r"\.\d\d"), F.size(F.regexp_extract_all(c, F.lit(V.DECIMAL_TOKEN), F.lit(0)))).otherwise(0)


def starts_with_date(col: Column | str) -> Column:
    return F.coalesce(strip(col).rlike(V.DATE_PREFIX), F.lit(False))


def format_indian(col: Column | str) -> Column:
    """12,34,567.89 from a decimal; halves round to even."""
    n = _c(col)
    text = F.bround(F.abs(n), 2).cast("decimal(38,2)").cast("string")
    whole = F.substring_index(text, ".", 1)
    grouped = F.regexp_replace(whole, r"(\d)(?=(?:\d\d)+\d$)", "$1,")
    return F.when(
        n.isNotNull(),
        F.concat(F.when(n < 0, "-").otherwise(""), grouped, F.lit("."), F.substring_index(text, ".", -1)),
    )


def format_indian_paise(col: Column | str) -> Column:
    """The same format from an integer number of paise."""
    p = F.abs(_c(col))
    whole = F.regexp_replace(p.cast("string"), r".?.$", "")
    whole = F.when(whole == "", "0").otherwise(whole)
    grouped = F.regexp_replace(whole, r"(\d)(?=(?:\d\d)+\d$)", "$1,")
    return F.when(
        _c(col).isNotNull(),
        F.concat(F.when(_c(col) < 0, "-").otherwise(""), grouped, F.lit("."), F.lpad((p % 100).cast("string"), 2, "0")),
    )
