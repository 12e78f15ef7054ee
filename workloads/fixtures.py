"""Input tables of the registered queries, derived with Spark from the given Parquet tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagetables.functions.cells import format_indian_paise, in_order
from pagetables.functions.ids import gstin_check_character
from pagetables.functions.scans import ordered_scan
from pagetables.session import new_folder

ROWS_PER_PAGE = 8
# x positions (points) of the seven drawn columns, the last three right-aligned
COLUMN_X = [39.6844, 96.3764, 153.0684, 300.4676, 402.5132, 476.2128, 555.5816]
# rule positions between them
VERTICALS = [36.0, 94.0, 150.0, 298.0, 345.0, 404.0, 478.0, 560.0]
HEADER = ["Date", "Value Dt", "Particulars", "Chq/Ref", "Withdrawal(Dr)", "Deposit(Cr)", "Balance"]
LINES_PER_PAGE = 8
TITLES = [
    "TRIAL BALANCE as at year end", "Balance Sheet of the firm", "Profit and Loss for the year",
    "IFSC ABCD0123456 with closing balance", "Annual Tax Statement", "Annual Information Statement",
    "GSTR - 1 return", "GSTR-3B summary", "GSTR 2B credit", "CGST rate and SGST rate", "General Ledger extract",
    "Notice under section 143", "TDS certificate", "Invoice No 7", "Capital gain report", "Holding statement",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def stored_once(build):
    """Derived tables are written once per application and input folder, then read like any table."""

    @functools.wraps(build)
    def load(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, f"{build.__name__}{args}")
        if key not in _STORED:
            path = new_folder(spark, build.__name__)
            build(spark, sf_dir, *args).write.parquet(path)
            _STORED[key] = path
        return spark.read.parquet(_STORED[key])

    return load


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents spread over all tasks; the given file is a single row group, read by one task.

    Only the columns a query takes are moved, and none are written.
    """
    return table(spark, sf_dir, "documents").repartition("doc_id")


def when_key(col: str, modulus: int, rest: int) -> Column:
    return F.col(col) % modulus == rest


@stored_once
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with running balances in paise; some balances wrong, off by one or missing."""
    paise = F.round(F.col("o_totalprice") * 100).cast("long")
    debit = F.col("o_orderkey") % 20 < 11
    base = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("account_id"),
        "o_orderkey",
        "o_orderdate",
        "o_orderpriority",
        F.when(debit, paise).alias("debit_p"),
        F.when(~debit, paise).alias("credit_p"),
        F.when(debit, -paise).otherwise(paise).alias("delta_p"),
    )
    moved = ordered_scan(
        base, ["account_id"], F.trunc("o_orderdate", "month"), ["o_orderdate", "o_orderkey"],
        number="seq", running={"moved_p": "delta_p"},
    )
    opening = F.lit(10_000_000) + F.col("account_id") * 100
    true_balance = F.col("opening_p") + F.col("moved_p")
    return (
        moved.withColumn("opening_p", opening)
        .withColumn(
            "balance_p",
            F.when(when_key("o_orderkey", 89, 7), None)
            .when(when_key("o_orderkey", 97, 13), true_balance + 2)
            .when(when_key("o_orderkey", 97, 14), true_balance + 1)
            .otherwise(true_balance),
        )
        .select("account_id", "seq", "o_orderkey", "o_orderdate", "o_orderpriority", "opening_p",
                "debit_p", "credit_p", "balance_p")
    )


def _page_no() -> Column:
    return (F.floor((F.col("seq") - 1) / ROWS_PER_PAGE) + 1).cast("int")


def page_lines(book: DataFrame, footer: bool, bleeding: bool, places: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page, lines array<struct<y, cells>>) of ledger rows, a row per page, lines by height; with `n_pages` for a footer.

    `places`: columns that stand for account and page, if the rows are dealt by them.
    """
    doc, i = F.col("account_id"), F.col("seq") - 1
    slot = (i % ROWS_PER_PAGE).cast("int")
    y0 = F.lit(80) + slot * 36
    even = doc % 2 == 0
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    first = F.when(doc % 5 == 0, F.concat(day, F.lit(" 123456"))).otherwise(day) if bleeding else day
    money = [F.coalesce(format_indian_paise(c), F.lit("")) for c in ("debit_p", "credit_p", "balance_p")]
    empty = F.lit("")
    dated = F.array(
        first, day,
        F.concat(F.lit("TXN/"), F.col("o_orderkey").cast("string"), F.lit("/"), F.substring("o_orderpriority", 1, 1)),
        F.when(F.col("o_orderkey") % 5 < 3, (F.col("o_orderkey") + 100000).cast("string")).otherwise(""),
        *money,
    )
    narration = F.array(
        empty, empty,
        F.concat(F.lit("BATCH "), (F.col("o_orderkey") % 1000).cast("string"), F.lit(" NOTE")),
        empty, empty, empty, empty,
    )
    pair = F.array(
        F.struct((y0 + F.when(even, 12).otherwise(0)).cast("double").alias("y"), dated.alias("cells")),
        F.struct((y0 + F.when(even, 0).otherwise(12)).cast("double").alias("y"), narration.alias("cells")),
    )
    keys = [doc.alias("doc_id"), _page_no().alias("page")]
    told = [F.first(c).alias(c) for c in ("doc_id", "page")] if places else []
    pages = book.select(*keys, *places, "opening_p", *(["n_pages"] if footer else []), pair.alias("pair")).groupBy(
        *(places or ("doc_id", "page"))).agg(
        *told, F.max("opening_p").alias("opening_p"), *([F.max("n_pages").alias("n_pages")] if footer else []),
        F.flatten(F.collect_list("pair")).alias("rows"))
    doc = F.col("doc_id")

    def one(text: Column, col: int = 0) -> Column:
        return F.array(*[text if k == col else empty for k in range(7)])

    on_first = F.col("page") == 1
    opening_cells = F.array(
        empty, empty, F.lit("OPENING BALANCE"), empty, empty, empty, format_indian_paise("opening_p"))
    extra = [
        (20.0, one(F.concat(F.lit("ACCOUNT "), doc.cast("string"), F.lit(" STATEMENT OF ACCOUNT"))), on_first),
        (32.0, one(F.lit("Branch Main Road City")), on_first),
        (44.0, F.array(*[F.lit(h) for h in HEADER]), on_first | (doc % 3 == 0)),
        (56.0, opening_cells, on_first & (doc % 7 != 0)),
    ]
    if footer:
        extra.append((985.0, one(F.concat(
            F.lit("Page "), F.col("page").cast("string"), F.lit(" of "), F.col("n_pages").cast("string"))), F.lit(True)))
    framing = F.filter(F.array(*[
        F.when(shown, F.struct(F.lit(y).alias("y"), cells.alias("cells"))) for y, cells, shown in extra]), lambda e: e.isNotNull())
    return pages.select("doc_id", "page", in_order(F.concat(framing, "rows")).alias("lines"))


@stored_once
def statement_lines(spark: SparkSession, sf_dir: str, footer: bool = True, bleeding: bool = True) -> DataFrame:
    """Printed statement lines (doc_id, page, line_no, y, cells) of every account.

    The rows of the ledger are dealt to pages, where they meet the number of pages, before lines are made of them. A row
    without an account has a place too.
    """
    places = ("_account", "_page", "_known")
    book = ledger(spark, sf_dir).withColumns({
        "_known": F.col("account_id").isNotNull(), "_account": F.coalesce("account_id", F.lit(0)), "_page": _page_no()})
    if footer:
        sizes = book.groupBy("_account", "_known").agg(F.max("_page").alias("n_pages"))
        numbers = sizes.withColumn("_page", F.explode(F.sequence(F.lit(1), "n_pages")))
        book = book.join(numbers.hint("shuffle_hash"), list(places))
    else:
        book = book.repartition(*places)
    pages = page_lines(book, footer, bleeding, places)
    # an outer generator, since the optimizer would make the lines once more for the test of another; no page is without lines
    return pages.select("doc_id", "page", F.posexplode_outer("lines").alias("i", "line")).select(
        "doc_id", "page", (F.col("i") + 1).alias("line_no"), "line.y", "line.cells")


@stored_once
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned words of the statements: 4 points per character, lines 8 points high.

    The rows of the ledger are dealt to pages before lines and words are made of them, so nothing larger moves.
    """
    lines = page_lines(ledger(spark, sf_dir).repartition("account_id", _page_no()), False, False)
    left_of = F.array(*[F.lit(x) for x in COLUMN_X])

    def words_of(y: Column, text: Column, col: Column) -> Column:
        parts = F.split(text, " ")
        left = F.element_at(left_of, col + 1)
        start = F.when(col >= 4, left - 4 * F.length(text)).otherwise(left)

        def word(w: Column, k: Column) -> Column:
            offset = F.when(k == 0, 0).otherwise(F.length(F.array_join(F.slice(parts, F.lit(1), k), " ")) + 1)
            return F.struct(y.alias("y"), col.alias("col"), k.alias("k"), (start + 4 * offset).alias("x0"), w.alias("text"))

        # an empty or missing cell has no words
        return F.when(text != "", F.transform(parts, word)).otherwise(F.array())

    on_line = F.transform("lines", lambda line: F.flatten(F.transform(line.cells, lambda text, col: words_of(line.y, text, col))))
    # numbered in the order of height, column and place, within the one row of a page
    placed = lines.select("doc_id", "page", F.posexplode(in_order(F.flatten(on_line))).alias("i", "word"))
    return placed.select(
        "doc_id", "page",
        (F.col("i") + 1).alias("word_no"),
        F.col("word.x0").alias("x0"),
        (F.col("word.x0") + 4 * F.length("word.text")).alias("x1"),
        F.col("word.y").alias("top"),
        (F.col("word.y") + 8).alias("bottom"),
        F.col("word.text").alias("text"),
        F.lit(None).cast("double").alias("conf"),
    )


@stored_once
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled lines: column borders and one line above each transaction; a quarter of the documents lack borders."""
    per_page = (
        ledger(spark, sf_dir)
        .groupBy(F.col("account_id").alias("doc_id"), (F.floor((F.col("seq") - 1) / ROWS_PER_PAGE) + 1).cast("int").alias("page"))
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
    )
    vertical = F.when(F.col("doc_id") % 4 != 3, F.array(*[F.lit(v) for v in VERTICALS])).otherwise(
        F.array().cast("array<double>"))
    horizontal = F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: F.lit(76.0) + 36.0 * k)
    one = per_page.select("doc_id", "page", F.lit("v").alias("orient"), F.explode(vertical).alias("pos"))
    two = per_page.select("doc_id", "page", F.lit("h").alias("orient"), F.explode(horizontal).alias("pos"))
    return one.unionByName(two)


def ocr_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR output rows (points x 2) with noise, empty boxes and the four non-word levels."""
    w = words(spark, sf_dir)
    twice = [
        F.round(F.col("x0") * 2).cast("int").alias("left"),
        F.round(F.col("top") * 2).cast("int").alias("top"),
        F.round((F.col("x1") - F.col("x0")) * 2).cast("int").alias("width"),
        F.round((F.col("bottom") - F.col("top")) * 2).cast("int").alias("height"),
    ]
    line_no = F.floor(F.col("top") / 12).cast("int")
    spread = F.col("doc_id") * 31 + line_no * 17 + F.col("word_no") * 7
    conf = F.when(spread % 23 == 0, -1).otherwise(spread % 101).cast("double")
    tokens = w.select(
        "doc_id", F.lit(5).alias("level"), F.col("page").alias("page_num"), F.lit(1).alias("block_num"),
        F.lit(1).alias("par_num"), line_no.alias("line_num"), F.col("word_no").cast("int").alias("word_num"),
        *twice, conf.alias("conf"),
        F.when(spread % 41 == 0, " ").otherwise(F.col("text")).alias("text"),
    )
    boxes = w.groupBy("doc_id", F.col("page").alias("page_num")).agg(F.max("x1").alias("x1")).select(
        "doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("level"), "page_num", F.lit(1).alias("block_num"),
        F.lit(1).alias("par_num"), F.lit(0).alias("line_num"), F.lit(0).alias("word_num"), F.lit(0).alias("left"),
        F.lit(0).alias("top"), F.round(F.col("x1") * 2).cast("int").alias("width"), F.lit(2000).alias("height"),
        F.lit(-1.0).alias("conf"), F.lit("").alias("text"),
    )
    return tokens.unionByName(boxes)


@stored_once
def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of eight lines of every document, with image coverage and ruled-line counts."""
    docs = documents(spark, sf_dir).select("doc_id", "source", F.split("text", "\n").alias("lines"))
    n_pages = F.ceil(F.size("lines") / LINES_PER_PAGE).cast("int")
    pages = docs.select(
        "doc_id", "source",
        F.posexplode(F.transform(
            F.sequence(F.lit(0), n_pages - 1),
            lambda p: F.array_join(F.slice("lines", p * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n"),
        )).alias("p", "text"),
    ).withColumn("page", F.col("p") + 1)
    spread = F.col("doc_id") + F.col("page")
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("doc_id") % 17).cast("int") + 1)
    titled = F.when(
        (F.col("page") == 1) & (F.col("doc_id") % 17 < 16), F.concat(title, F.lit("\n"), F.col("text"))
    ).otherwise(F.col("text"))
    script = F.lit("क" * 60)
    text = (
        F.when(F.col("doc_id") % 30 == 0, script)
        .when(F.col("doc_id") % 6 == 0, F.concat(titled, F.lit("\n"), script))
        .when(spread % 20 == 0, F.substring("text", 1, 10))
        .otherwise(titled)
    )
    return pages.select(
        "doc_id", "source", "page", text.alias("text"),
        F.when(spread % 10 == 0, 0.9).otherwise(0.1).alias("image_coverage"),
        (F.col("doc_id") * F.col("page") % 9).cast("int").alias("ruled_lines"),
    )


@stored_once
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page) of every page of text: the texts move once, to be cut in pages, and are not written."""
    return pages_text.__wrapped__(spark, sf_dir).select("doc_id", "page")


def id_texts(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    """One text per customer holding Indian identifiers, an amount, a date, an invoice, an e-mail and phones."""
    k = F.col("c_custkey")
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def letter(n: Column) -> Column:
        return F.substring(letters, (n % 26).cast("int") + 1, F.lit(1))

    pan = F.concat(
        letter(F.floor(k / 676)), letter(F.floor(k / 26)), letter(k), F.lit("P"), letter(k),
        F.lpad((k * 7 % 10000).cast("string"), 4, "0"), letter(k * 3))
    stem = F.concat(F.lpad((k % 37 + 1).cast("string"), 2, "0"), pan, F.lit("1Z"))
    good = gstin_check_character(stem)
    base36 = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    shifted = F.substring(base36, F.instr(base36, good) % 36 + 1, F.lit(1))
    gstin = F.concat(stem, F.when(k % 5 == 0, shifted).otherwise(good))
    aadhaar = F.concat(F.lit("2"), F.lpad((k * 7919 % 10_000_000_000).cast("string"), 10, "0"), (k % 10).cast("string"))
    spaced = F.concat_ws(" ", F.substring(aadhaar, 1, 4), F.substring(aadhaar, 5, 4), F.substring(aadhaar, 9, 4))
    text = F.concat(
        F.lit("Invoice No: INV-"), k.cast("string"), F.lit(" dated 12/03/2024 for Rs. 1,234.50 and INR "),
        (k * 3).cast("string"), F.lit("\nPAN "), pan, F.lit("  again "), pan, F.lit(" GSTIN "), gstin,
        F.lit("\nAadhaar "), F.when(k % 2 == 0, spaced).otherwise(aadhaar),
        F.lit(" TAN DELA12345F CIN L12345MH2001PLC"), F.lpad((k % 1000000).cast("string"), 6, "0"),
        F.lit(" DIN: "), F.lpad((k % 100000000).cast("string"), 8, "0"),
        F.lit(" IFSC ABCD0"), F.lpad((k % 1000000).cast("string"), 6, "0"),
        F.lit("\nmail user"), k.cast("string"), F.lit("@example.org phone 98"), F.lpad((k % 100000000).cast("string"), 8, "0"),
        F.lit(" card 4111 1111 1111 "), F.lpad((k % 10000).cast("string"), 4, "0"),
    )
    customers = table(spark, sf_dir, "customer") if customers is None else customers
    return customers.select(
        k.alias("doc_id"), F.lit(1).alias("page"), F.col("c_mktsegment").alias("source"), text.alias("text"))


def scanned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifier texts and all document pages."""
    docs = documents(spark, sf_dir).select(
        (F.col("doc_id") + 1_000_000_000).alias("doc_id"), "source", F.split("text", "\n").alias("lines"))
    n_pages = F.ceil(F.size("lines") / LINES_PER_PAGE).cast("int")
    pages = docs.select("doc_id", "source", F.posexplode(F.transform(
        F.sequence(F.lit(0), n_pages - 1),
        lambda p: F.array_join(F.slice("lines", p * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n"))).alias("p", "text"))
    pages = pages.select("doc_id", (F.col("p") + 1).alias("page"), "source", "text")
    # texts move once, as documents; a page is the work of the task that has its document's text. A customer is a few bytes
    # that become a text, so the number of parts is told: by the bytes, all of them would be put together in one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").repartition(parts, "c_custkey")
    return id_texts(spark, sf_dir, ids).unionByName(pages)


def doc_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the paged documents: lines dropped, upper-cased, pages dropped and added."""
    docs = documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines"))
    n_pages = F.ceil(F.size("lines") / LINES_PER_PAGE).cast("int")

    def page_lines(p: Column) -> Column:
        return F.slice("lines", p * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE))

    a = docs.select("doc_id", F.posexplode(F.transform(
        F.sequence(F.lit(0), n_pages - 1), lambda p: F.array_join(page_lines(p), "\n"))).alias("p", "text")
    ).select("doc_id", (F.col("p") + 1).alias("page"), "text")

    def edited(p: Column) -> Column:
        numbered = F.transform(page_lines(p), lambda s, i: F.struct(s.alias("s"), (p * LINES_PER_PAGE + i + 1).alias("n")))
        kept = F.filter(numbered, lambda e: (F.col("doc_id") + e.n) % 50 != 0)
        return F.array_join(F.transform(
            kept, lambda e: F.when((F.col("doc_id") + e.n) % 70 == 1, F.translate(e.s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(e.s)), "\n")

    last = n_pages - F.when(F.col("doc_id") % 25 == 0, 1).otherwise(0)
    texts = F.transform(F.sequence(F.lit(0), n_pages - 1), edited)
    kept = F.slice(texts, F.lit(1), last)
    added = F.when(F.col("doc_id") % 40 == 3, F.concat(kept, F.array(F.lit("one added page")))).otherwise(kept)
    b = docs.select("doc_id", F.posexplode(added).alias("p", "text")).select(
        "doc_id", (F.col("p") + 1).alias("page"), "text")
    return a, b


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text spans with font size and style flags, one span per document line."""
    docs = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    first = F.col("i") % LINES_PER_PAGE == 0
    tenth = F.col("i") % 10 == 9
    return docs.select(
        "doc_id",
        (F.floor(F.col("i") / LINES_PER_PAGE) + 1).cast("int").alias("page"),
        F.lit(1).alias("block_no"),
        (F.col("i") % LINES_PER_PAGE + 1).cast("int").alias("line_no"),
        F.lit(1).alias("span_no"),
        F.when(first, 16.0).when(tenth, 13.2).otherwise(11.0).alias("size"),
        F.when(first, 16).when(tenth, 2).otherwise(0).alias("flags"),
        "text",
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("tool_id"), F.lit("run").alias("action"),
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_id") % 29 == 3, "error").otherwise("success").alias("status"),
        "user_id",
    )


def batch_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per user and day."""
    failed = F.col("status") == "error"
    return (
        audit_log(spark, sf_dir)
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(
            F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count(F.lit(1)).alias("total"),
            F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"),
        )
        .withColumn("status", F.when(F.col("failed") > 0, "error").otherwise("done"))
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth per account; planted differences in count, opening and closing."""
    book = ledger(spark, sf_dir)
    key = F.col("account_id")
    return book.groupBy("account_id").agg(
        (F.count(F.lit(1)) + F.when(F.first(key) % 9 == 0, 2).otherwise(0)).alias("n_rows"),
        F.sum(F.coalesce("debit_p", F.lit(0))).alias("total_debits"),
        F.sum(F.coalesce("credit_p", F.lit(0))).alias("total_credits"),
        (F.max_by("balance_p", F.when(F.col("balance_p").isNotNull(), F.col("seq")))
         + F.when(F.first(key) % 11 == 0, 5).otherwise(0)).alias("closing"),
        F.max("opening_p").alias("opening"),
    )
