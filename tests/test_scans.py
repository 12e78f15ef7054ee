"""Ordered scans, also with one key that holds most rows, against plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from pagetables.functions import scans
from pagetables.operators.ledger import check_continuity
from workloads import fixtures as X


def brute(rows):
    out, groups = {}, {}
    for key, pos, v in sorted(rows, key=lambda r: (r[0], r[1])):
        groups.setdefault(key, []).append((pos, v))
    for key, items in groups.items():
        for i, (pos, v) in enumerate(items):
            earlier = [x for _, x in items[:i] if x is not None]
            later = [x for _, x in items[i + 1:] if x is not None]
            out[key, pos] = (
                i + 1, sum(x or 0 for _, x in items[: i + 1]), earlier[-1] if earlier else None, later[0] if later else None)
    return out


def monkeypatch_conf(spark, name, value, request):
    before = spark.conf.get(name)
    request.addfinalizer(lambda: spark.conf.set(name, before))
    spark.conf.set(name, value)


def sample(n_hot, n_keys, seed):
    r = random.Random(seed)
    rows = [(0, i, r.choice([None, r.randint(-9, 9)])) for i in range(n_hot)]
    for k in range(1, n_keys):
        rows += [(k, i, r.choice([None, None, r.randint(-9, 9)])) for i in range(r.randint(1, 12))]
    return rows


def test_scan_matches_loop(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 5)
    rows = sample(700, 200, 1)
    df = spark.createDataFrame(rows, "k int, pos int, v int")
    got = scans.ordered_scan(
        df, ["k"], F.floor(F.col("pos") / 3), ["pos"], number="n", running={"s": "v"}, before={"b": "v"}, after={"a": "v"})
    assert {(r.k, r.pos): (r.n, r.s, r.b, r.a) for r in got.collect()} == brute(rows)


def test_scan_keeps_columns_and_replaces(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None)], "k int, pos int, v int")
    got = scans.ordered_scan(df, ["k"], F.lit(0), ["pos"], before={"v": "v"})
    assert got.columns == ["k", "pos", "v"]
    assert sorted((r.pos, r.v) for r in got.collect()) == [(1, None), (2, 5)]


def test_hot_account_is_split(spark, request):
    """One account holds a third of all rows; the scan spreads it over many tasks and stays right."""
    hot, others = 40_000, 8_000
    ids = spark.range(hot + 10 * others)
    account = F.when(F.col("id") < hot, 0).otherwise(1 + F.col("id") % others)
    book = ids.select(
        account.cast("long").alias("account_id"), F.col("id").alias("seq"), F.lit(0).alias("opening"),
        F.lit(None).cast("long").alias("debit"), F.lit(1).cast("long").alias("credit"))
    balance = F.when(F.col("account_id") == 0, F.col("seq") + 1).otherwise(
        F.floor((F.col("seq") - hot) / others) + 1)
    book = book.withColumn("balance", F.when(F.col("seq") % 1000 != 7, balance))
    checked = check_continuity(book, tolerance=0, chunk=F.floor(F.col("seq") / 512))
    counts = {r.verdict: r["count"] for r in checked.groupBy("verdict").count().collect()}
    missing = book.where("balance is null").count()
    assert counts["missing"] == missing
    assert counts["bad"] <= missing and counts["ok"] == hot + 10 * others - missing - counts["bad"]
    # small partitions would be merged again
    monkeypatch_conf(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false", request)
    biggest = (
        checked.where("account_id = 0").groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).collect()[0][0])
    assert biggest < hot


def test_spread_join_is_the_same_beyond_the_broadcast_limit(spark, request):
    df = spark.range(200).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("page"))
    facts = spark.range(5).select(F.col("id").alias("doc_id"), (F.col("id") * 10).alias("x"))
    small = sorted(map(tuple, scans.spread_by_page(df, facts).select("doc_id", "page", "x").collect()))
    monkeypatch_conf(spark, "spark.sql.autoBroadcastJoinThreshold", "-1", request)
    plan = scans.spread_by_page(df, facts)
    assert sorted(map(tuple, plan.select("doc_id", "page", "x").collect())) == small
    left = scans.spread_by_page(df, facts, "left")
    assert left.count() == 200 and left.where("x is null").count() == df.where("doc_id > 4").count()


def test_null_keys_and_chunks_stay(spark):
    rows = [(None, 1, 5), (None, 2, 7), ("a", None, 1), ("a", 1, 2), ("a", 2000, 3)]
    df = spark.createDataFrame(rows, "k string, page int, v int").withColumn("line", F.lit(1))
    got = scans.ordered_scan(df, ["k"], "page", ["page", "line"], number="n", running={"total": "v"}).collect()
    assert len(got) == 5
    assert sorted(r["total"] for r in got if r["k"] is None) == [5, 12]
    assert max(r["total"] for r in got if r["k"] == "a") == 6


def test_full_rows_move_once(spark, request):
    """Windows and the join with the carried state share one partitioning; null keys do not change that."""
    monkeypatch_conf(spark, "spark.sql.autoBroadcastJoinThreshold", "-1", request)
    monkeypatch_conf(spark, "spark.sql.adaptive.enabled", "false", request)
    rows = [(k, p, k or 0, "x") for k in (None, 1, 2) for p in range(9)]
    df = spark.createDataFrame(rows, "k long, page int, v long, wide string")
    got = scans.ordered_scan(df, ["k"], "page", ["page"], number="n", running={"s": "v"}, before={"b": "v"}, after={"a": "v"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    # exchanges of rows that carry the wide column
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) >= 3
    full = 0
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line and "wide#" in "".join(lines[i + 1 : i + 2]):
            full += 1
    assert full == 1, plan
    assert got.count() == 27


def test_chunks_that_are_composite_have_a_second_level(spark, monkeypatch):
    from pagetables.operators import docset

    monkeypatch.setattr(scans, "BLOCK", 3)
    monkeypatch.setattr(docset, "BLOCK", 3)
    docs = [(d, p) for d in range(40) for p in range(1, 1 + d % 4)] + [(100, p) for p in range(1, 3000)]
    order = [(b, (-7) ** (d % 5) * 1000 + d, d) for b in (0, 1, None) for d in [*range(40), 100] if b != 1 or d % 2]
    got = docset.merge_docs(spark.createDataFrame(docs, "doc_id int, page int"), spark.createDataFrame(order, "bundle_id int, ord int, doc_id int"))
    pages = {}
    for d, p in docs:
        pages.setdefault(d, []).append(p)
    want = []
    for b in (0, 1, None):
        line = [(b, d, p) for _, _, d in sorted(o for o in order if o[0] == b) for p in sorted(pages.get(d, []))]
        want += [(*x, i) for i, x in enumerate(line, 1)]
    rows = [(r.bundle_id, r.doc_id, r.page, r.new_page) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_running_values_and_cut_pieces(spark):
    from pagetables.functions import prefixes

    r = random.Random(4)
    arrays = [[], [3], [r.randint(-9, 9) for _ in range(128)], [r.randint(-99, 99) for _ in range(1000)]]
    df = spark.createDataFrame([(a,) for a in arrays], "v array<int>")
    got = df.select(prefixes.running_sum(F.col("v")).alias("s"), prefixes.running_max(F.col("v")).alias("m")).collect()
    for a, row in zip(arrays, got, strict=True):
        assert row.s == [sum(a[: i + 1]) for i in range(len(a))] and row.m == [max(a[: i + 1]) for i in range(len(a))]
    text = "".join(r.choice("aé\n😀 ") for _ in range(5000))
    spots = [tuple(sorted((r.randint(0, 5000), r.randint(0, 5000)))) for _ in range(60)] + [(0, 0), (0, 5000), (1023, 1025), (1024, 2048), (5000, 5000)]
    df = spark.createDataFrame([(text, a, b) for a, b in spots], "t string, a int, b int")
    got = df.select(prefixes.cut(prefixes.pieces(F.col("t")), F.col("a"), F.col("b")).alias("c")).collect()
    assert [x.c for x in got] == [text[a:b] for a, b in spots]


def test_ledger_rows_move_once_before_words_are_made(spark):
    book = spark.createDataFrame(
        [(1, n, n, datetime.date(2024, 1, n), "1-A", 100, n, None, 100 - n) for n in range(1, 11)],
        "account_id long, seq long, o_orderkey long, o_orderdate date, o_orderpriority string, opening_p long, debit_p long, credit_p long, balance_p long")
    lines = X.page_lines(book.repartition("account_id", X._page_no()), False, False)
    assert [(r["page"], len(r["lines"])) for r in lines.orderBy("page").collect()] == [(1, 20), (2, 4)]
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
