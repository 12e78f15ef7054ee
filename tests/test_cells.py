"""Literal cases of amounts, dates, kinds and formats."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pagetables.functions import cells as C
from pagetables.functions.ids import aadhaar_is_valid, gstin_check_character, gstin_is_valid
from pagetables.operators.docset import select_pages


def values(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", expression("s").alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_amounts(spark):
    cases = {
        "1,04,578.25": "104578.25", "(1,234.00)": "-1234", "5 Dr": "-5", "-5 Dr": "5", "(5) Dr": "-5", "( -5 )": "5",
        "Rs. 500": "500", "₹ 12,000.5": "12000.5", "5.": "5", "INR 7 cr.": "7", "1 23 456": "123456", "-1,234.50": "-1234.5",
        "1,234.50 Dr.": "-1234.5", "12345678901234567890": "12345678901234567890",
        "nil": None, "5.00.": None, "(5).": None, "(5": None, "5)": None, "": None, "-": None, "0.00*": None, "Cr 5": None,
        "1,2345": None, "1.23456": None, None: None,
    }
    got = values(spark, list(cases), C.parse_number)
    assert got == [None if v is None else Decimal(v) for v in cases.values()]
    assert values(spark, list(cases), C.is_number) == [v is not None for v in cases.values()]


def test_dates(spark):
    day = datetime.date
    cases = {
        "12/03/2024": day(2024, 3, 12), "1/4/24": day(2024, 4, 1), "02-Jan-69": day(1969, 1, 2), "02-jan-68": day(2068, 1, 2),
        "5 May 2024": day(2024, 5, 5), "5 August 2024": day(2024, 8, 5), "2024-3-1": day(2024, 3, 1), "1.2.2024": day(2024, 2, 1),
        " 29-02-2024 ": day(2024, 2, 29), "05-Mar-2023": day(2023, 3, 5),
        "31/02/2024": None, "5 Augus 2024": None, "1.2.24": None, "01-02/2024": None, "2024": None, "2024-03": None, "0/1/2024": None,
        "29/02/2023": None, "12/13/2024": None, "": None, None: None, "01/01/0000": None,
    }
    assert values(spark, list(cases), C.parse_date) == list(cases.values())


def test_lead_date(spark):
    texts = ["12/03/2024 abc  def", "12/03/2024", "5 May 2024", "abc 12/03/2024", ""]
    d = datetime.date
    assert values(spark, texts, C.lead_date) == [d(2024, 3, 12), d(2024, 3, 12), d(2024, 5, 5), None, None]
    assert values(spark, texts, C.behind_lead_date) == ["abc def", "", "", "abc 12/03/2024", ""]


def test_indian_format(spark):
    cases = {"1234567.891": "12,34,567.89", "-0.001": "-0.00", "999": "999.00", "1000": "1,000.00", "100000": "1,00,000.00", "2.345": "2.34"}
    got = values(spark, list(cases), lambda c: C.format_indian(F.col(c).cast("decimal(20,4)")))
    assert got == list(cases.values())
    assert values(spark, ["5", "-5", "100", "-123456789"], lambda c: C.format_indian_paise(F.col(c).cast("long"))) == [
        "0.05", "-0.05", "1.00", "-12,34,567.89"]


def test_decimal_tokens(spark):
    assert values(spark, ["1.00 2.00", "12,345.67", "1.2", "a", "1.00,2.00"], C.decimal_tokens) == [2, 1, 0, 0, 1]


def test_checksums(spark):
    # a widely published sample number, and one digit changed
    assert values(spark, ["2363 ", "499118665246", "499118665247", "4991 1866 5246"], aadhaar_is_valid) == [False, True, False, True]
    stem = "27AAPFU0939F1Z"
    assert values(spark, [stem], gstin_check_character) == ["V"]
    assert values(spark, [stem + "V", stem + "W"], gstin_is_valid) == [True, False]


@pytest.mark.parametrize("spec, expected", [
    ("1-3,5,8-10", [1, 2, 3, 5, 8, 9, 10]), ("5-1", [1, 2, 3, 4, 5]), ("10-20", [10, 11, 12]), ("3,1,3", [3, 1]),
    ("even", [2, 4, 6, 8, 10, 12]), ("x, 2", [2]),
])
def test_page_specs(spark, spec, expected):
    pages = spark.range(1, 13).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page"))
    rows = select_pages(pages, spark.createDataFrame([(1, spec)], "doc_id int, spec string")).collect()
    assert [r.page for r in sorted(rows, key=lambda r: r.new_page)] == expected


def test_bare_amounts_are_amounts_and_no_dates(spark):
    """The short ways for plain amounts and full dates agree with the long ones."""
    texts = ["1", "12", "1,234.50", "12,34,567.8912", "1234567.1", "1.", "1.23456", "1,2", "1234,567", "0", ".5", "-5", "5 Cr", "(5.00)", "Rs. 5",
             "12.03.2024", "12/03/2024", "31/02/2024", "1-2-2024", "1/2-2024", "1/2/0000", "1/2/24", "1/2/99", "2024-01-02", "1 Jan 2024", "1-Jan-24", "12\u0085", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r for r in df.select(
        "t", C.is_bare_amount(F.col("t")).alias("bare"), C.is_amount(F.col("t")).alias("amount"), C.parse_number("t").cast("double").alias("n"),
        C.date_of(F.col("t")).cast("string").alias("d")).collect()}
    assert [t for t in texts if got[t].bare] == ["1", "12", "1,234.50", "12,34,567.8912", "1234567.1", "0"]
    assert all(r.amount and r.d is None for r in got.values() if r.bare)
    assert {t: got[t].n for t in texts if got[t].n is not None} == {
        "1": 1, "12": 12, "1,234.50": 1234.5, "12,34,567.8912": 1234567.8912, "1234567.1": 1234567.1, "1.": 1, "0": 0, "-5": -5, "5 Cr": 5,
        "(5.00)": -5, "Rs. 5": 5, "12\u0085": 12}
    assert {t: got[t].d for t in texts if got[t].d} == {
        "12.03.2024": "2024-03-12", "12/03/2024": "2024-03-12", "1-2-2024": "2024-02-01", "1/2/24": "2024-02-01", "1/2/99": "1999-02-01",
        "2024-01-02": "2024-01-02", "1 Jan 2024": "2024-01-01", "1-Jan-24": "2024-01-01"}
