"""Redaction, spans, versions, streams."""

from pyspark.sql import functions as F

from pagetables.operators import docset as D, privacy as E, profile as P
from pagetables.session import new_folder
from pagetables.streaming import audit as A, continuity as C, folder as W
from workloads import fixtures as X


def page(spark, *texts):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id int, page int, text string")


def test_identifiers_in_identifiers(spark):
    """A PAN inside a GSTIN is no PAN; a spaced card number begins like an Aadhaar, an unspaced one is also an account."""
    found = E.scan_sensitive(page(spark, "27AAPFU0939F1ZV", "4111 1111 1111 1111", "4111111111111111", "éa@b.co x")).collect()
    assert sorted((r.doc_id, r.type) for r in found) == [
        (0, "GSTIN"), (1, "Aadhaar"), (1, "Card No."), (2, "Account No."), (2, "Card No."), (3, "Email")]
    spans = {(r.doc_id, r.type): (r.start, r.end) for r in found}
    assert spans[1, "Card No."] == (0, 19) and spans[3, "Email"] == (1, 7)


def test_redaction_leaves_nothing(spark, sf_dir):
    ids = X.id_texts(spark, sf_dir)
    assert E.verify_redaction(E.redact(ids)).count() == 0
    assert E.scan_sensitive(ids).count() > 0
    # overlapping matches are masked as a whole, under the surest name
    mixed = page(spark, "pay 4111 1111 1111 1111 now", "to ABCDE1234F@mail.com, ABCDE1234F")
    assert [r.text for r in E.redact(mixed).orderBy("doc_id").collect()] == ["pay [Aadhaar] now", "to [PAN], [PAN]"]
    clean = page(spark, "nothing here at all")
    assert E.redact(clean).collect()[0].text == "nothing here at all"


def test_field_order_and_all_values(spark):
    many = " ".join(f"{d:02d}/01/2024" for d in range(1, 31))
    rows = E.extract_fields(page(spark, f"DIN: 12345678 ABCDE1234F x ABCDE1234F PQRST1234Z {many}")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.field, r.ord)):
        by.setdefault(r.field, []).append(r.value)
    assert by["PAN"] == ["ABCDE1234F", "PQRST1234Z"] and by["DIN"] == ["DIN: 12345678"] and len(by["Dates"]) == 30


def test_doc_type_rules(spark):
    texts = ["withdrawal x deposit y balance", "IFSC\nclosing balance", "GSTR - 1", "GSTR-11", "tds xx certificate", "x"]
    got = P.classify_doc_type(page(spark, *texts)).orderBy("doc_id").collect()
    assert [r.doc_type for r in got] == ["bank_statement", "bank_statement", "gstr1", "generic", "tds", "generic"]


def test_documents_are_typed_from_all_pages(spark):
    blank = ["x"] * 60
    cases = {
        1: (["x" * 25_000 + " trial balance"], "trial_balance", "latin"),
        2: (blank[:20] + ["the Ledger"] + blank, "ledger", "latin"),
        3: (["GSTIN"] + blank[:9] + ["taxable"] + blank, "gst_report", "latin"),
        4: (["taxable"] + blank[:9] + ["GSTIN"] + blank, "generic", "latin"),
        5: (["y" * 500 + " profit &", " ", "loss " + "z" * 500], "profit_loss", "latin"),
        6: (["gstr-1" + "2" * 500, "q" * 500 + "gstr"], "generic", "latin"),
        7: (["ifsc"] + blank + ["balance"], "bank_statement", "latin"),
        8: (blank[:15] + ["\u0915" * 80] + blank[:15], "generic", "devanagari"),
        9: ([None, ""], "generic", "latin"),
    }
    rows = [(d, i, t, 1.0 if d == 2 and i == 12 else 0.0, 12 if d == 8 and i == 20 else 0)
            for d, (texts, _, _) in cases.items() for i, t in enumerate([*(t if d != 2 or k != 11 else "" for k, t in enumerate(texts))], 1)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string, image_coverage double, ruled_lines int")
    got = {r.doc_id: r for r in P.doc_profile(pages).collect()}
    assert {d: (r.doc_type, r.script) for d, r in got.items()} == {d: (t, s) for d, (_, t, s) in cases.items()}
    assert got[2].any_scanned and got[2].needs_ocr and not got[3].any_scanned
    assert got[8].likely_tables and not got[4].likely_tables and got[7].sampled == got[7].n_pages == 62


def test_versions(spark):
    a = page(spark, "a b b c", "same text")
    b = page(spark, "a b d", "same text")
    diff, summary = D.compare_versions(a, b)
    assert sorted((r.token, r.old_n, r.new_n, r.op) for r in diff.collect()) == [
        ("b", 2, 1, "del"), ("c", 1, 0, "del"), ("d", 0, 1, "add")]
    assert [(r.added, r.removed, r.identical) for r in summary.orderBy("doc_id").collect()] == [(1, 2, False), (0, 0, True)]


def test_pagination(spark):
    docs = page(spark, "a\n\n" + "x" * 76 + "\tb").drop("page")
    rows = D.paginate_text(docs).orderBy("page", "line_on_page").collect()
    assert [r.text for r in rows] == ["a", "", "x" * 75, "x    b"]


def test_late_rows_and_sessions(spark):
    """A row older than the watermark is not counted; sessions close after the gap."""
    schema = "id long, ts timestamp, tool_id string, status string, user_id long"
    source, out, progress = new_folder(spark, "in"), new_folder(spark, "out"), new_folder(spark, "progress")

    def send(*times):
        rows = [(i, t, "merge", "error" if i == 0 else "success", 1) for i, t in enumerate(times)]
        spark.createDataFrame(rows, "id long, ts string, tool_id string, status string, user_id long").withColumn(
            "ts", F.to_timestamp("ts")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        W.append_to(A.audit_stream(stream), out, progress).awaitTermination()

    send("2024-01-01 00:10:00", "2024-01-01 00:50:00", "2024-01-01 01:10:00")
    send("2024-01-01 05:00:00")
    send("2024-01-01 00:20:00", "2024-01-01 09:00:00")
    got = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r.n_actions, r.n_errors) for r in got] == [(2, 1), (1, 0), (1, 1)]
    batch = A.audit_sessions(spark.read.schema(schema).parquet(source)).collect()
    assert sorted(r.n_actions for r in batch) == [1, 1, 4]


NAMES = dict(key="account_id", opening="opening_p", balance="balance_p", seq="seq", tolerance=1, debit="debit_p", credit="credit_p")
STATE = "account_id long, carried long, last_seq long"


def test_batches_in_order_give_the_verdicts_of_the_whole(spark, sf_dir):
    book = X.ledger(spark, sf_dir)
    first, after = C.check_batch(book.where("seq <= 5"), spark.createDataFrame([], STATE), **NAMES)
    second, _ = C.check_batch(book.where("seq > 5"), after, **NAMES)
    from workloads.ledger_queries import checked_ledger

    whole = checked_ledger(spark, sf_dir).select("account_id", "seq", "previous", "verdict")
    parts = first.select(*whole.columns).unionByName(second.select(*whole.columns))
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


def test_late_rows_are_flagged_and_change_nothing(spark):
    rows = "account_id long, seq long, opening_p long, debit_p long, credit_p long, balance_p long"
    first = spark.createDataFrame([(1, 1, 0, None, 5, 5), (1, 4, 0, None, 5, None), (None, 2, 0, None, 1, 1)], rows)
    checked, after = C.check_batch(first, spark.createDataFrame([], STATE), **NAMES)
    assert sorted(r.verdict for r in checked.collect()) == ["missing", "ok", "ok"]
    state = sorted(((r.account_id or 0), r.carried, r.last_seq) for r in after.collect())
    assert state == [(0, 1, 2), (1, 5, 4)]
    second = spark.createDataFrame([(1, 3, 0, None, 9, 99), (1, 5, 0, None, 5, 10), (None, 3, 0, None, 1, 4)], rows)
    checked, after = C.check_batch(second, spark.createDataFrame([(None, 1, 2), (1, 5, 4)], STATE), **NAMES)
    got = {((r.account_id or 0), r.seq): (r.verdict, r.late, r.previous, r.balance_p) for r in checked.collect()}
    assert got == {(1, 3): ("late", True, None, 99), (1, 5): ("ok", False, 5, 10), (0, 3): ("bad", False, 1, 4)}
    assert sorted(((r.account_id or 0), r.carried, r.last_seq) for r in after.collect()) == [(0, 4, 3), (1, 10, 5)]


def test_a_batch_touches_only_the_buckets_of_its_accounts(spark):
    """One account beside very many idle ones: one bucket is read and written; a repeated batch gives the same."""
    folder, key = new_folder(spark, "state"), "account_id"
    state = C.BalanceState(spark, folder, STATE, buckets=64)
    idle = spark.range(50_000).select(F.col("id").alias(key), F.col("id").alias("carried"), F.lit(1).cast("long").alias("last_seq"))
    state.write(0, state.manifest(-1), list(range(64)), idle, key)
    assert set(state.manifest(0).values()) == {0} and len(state.manifest(0)) == 64
    bucket = idle.where("account_id = 77").select(C._bucket(key, 64)).first()[0]
    for _ in range(2):
        before = state.read(state.manifest(0), [bucket])
        assert 77 in {r[0] for r in before.select(key).collect()} and before.count() < 2_000
        after = before.withColumn("carried", F.when(F.col(key) == 77, -5).otherwise(F.col("carried")).cast("long"))
        state.write(1, state.manifest(0), [bucket], after, key)
        assert spark.read.parquet(f"{folder}/state/version=1").select("bucket").distinct().count() == 1
        now = state.manifest(1)
        assert now[bucket] == 1 and sum(now.values()) == 1
        whole = state.read(now, list(range(64)))
        assert whole.count() == 50_000 and whole.where("carried = -5").count() == 1


def test_time_of_spans_and_redaction_follows_the_length(spark):
    """Twice the text and matches take about twice the time, and every match is found and masked."""
    import time

    def text(n):
        return "".join(f"mail a{i}@b.co and ABCDE{i % 10000:04d}F {'é' * 20} " for i in range(n))

    took = []
    for n in (500, 4_000, 8_000):
        docs = page(spark, text(n))
        start = time.perf_counter()
        found = E.scan_sensitive(docs)
        assert found.where(F.substring(F.lit(text(n)), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("value")).count() == 0
        assert found.count() == 2 * n
        masked = E.redact(docs).first()["text"]
        assert masked.count("[PAN]") == masked.count("[Email]") == n and len(masked) == len(text(n)) - sum(len(f"a{i}@b.co") - 7 for i in range(n)) - 5 * n
        took.append(time.perf_counter() - start)
    assert took[2] < 3 * took[1] + 2


def test_detections_are_not_sent_to_the_driver(spark):
    words = spark.createDataFrame([(1, 1, 1, "mail", 0.0, 20.0, 0.0, 8.0), (1, 1, 2, "a@b.org", 24.0, 60.0, 0.0, 8.0)],
                                  "doc_id long, page int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    pages, spans = E.joined_fragments(words)
    boxes = E.locate_detections(spans, E.scan_sensitive(pages), 100.0, 100.0)
    assert [(r["value"], r["start"]) for r in boxes.collect()] == [("a@b.org", 5)]
    assert "Broadcast" not in boxes._jdf.queryExecution().executedPlan().toString()
