"""Balance continuity over arriving ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import check_continuity
from ..session import stored

STATE_BUCKETS = 1024
# buckets go to so many folders of a batch, sorted, so that a few buckets are found by folder and page index
STATE_PARTS = 16
# rows of an account per block of the join with its state
_BLOCK = 4096


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class BalanceState:
    """The last balance and position of every account, in buckets by the hash of the account.

    A batch reads the buckets of its accounts and writes these anew, under its own number; a manifest of at most
    one row per bucket, written last, says which number holds each bucket. So idle accounts cost nothing, and a batch
    that is tried again starts from the manifest before it and replaces what the failed try left.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = STATE_BUCKETS):
        self.spark, self.folder, self.schema, self.buckets = spark, folder, schema, buckets

    def manifest(self, batch: int) -> dict[int, int]:
        """Bucket to the number of the batch that wrote it, as of the end of a batch; empty before the first."""
        if batch < 0:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.folder}/manifests/{batch}")
        return {r["bucket"]: r["version"] for r in rows.collect()}

    def _rows(self, manifest: dict[int, int]) -> DataFrame:
        return self.spark.createDataFrame(sorted(manifest.items()), "bucket int, version long")

    def read(self, manifest: dict[int, int], touched: list[int]) -> DataFrame:
        held = {b: manifest[b] for b in touched if b in manifest}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/state/version={v}" for v in sorted(set(held.values()))]
        parts = sorted({b % STATE_PARTS for b in held})
        rows = self.spark.read.schema(f"{self.schema}, bucket int, version long, part int").option("basePath", f"{self.folder}/state").parquet(*paths)
        if len(held) <= STATE_PARTS:  # else the join alone leaves the right ones
            rows = rows.where(F.col("part").isin(parts) & F.col("bucket").isin(list(held)))
        # a row per bucket at most, so it is small; older versions of a bucket go
        return rows.join(F.broadcast(self._rows(held)), ["bucket", "version"]).drop("bucket", "version", "part")

    def write(self, batch: int, manifest: dict[int, int], touched: list[int], state: DataFrame, key: str) -> None:
        if touched:
            named = state.withColumn("bucket", _bucket(key, self.buckets)).withColumn("part", F.col("bucket") % STATE_PARTS)
            named.repartition("part").sortWithinPartitions("part", "bucket").write.mode("overwrite").partitionBy("part").parquet(
                f"{self.folder}/state/version={batch}")
        found = manifest | dict.fromkeys(touched, batch)
        self._rows(found).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/{batch}")


def check_batch(
    rows: DataFrame, state: DataFrame, key: str, opening: str, balance: str, seq: str, tolerance, **columns
) -> tuple[DataFrame, DataFrame]:
    """One batch against the state (key, carried, last_seq) of its accounts: (checked rows, state of these accounts after it).

    Adds `previous`, `verdict` and `late`. A row at or before a position that an earlier batch had is late: it has the
    verdict "late" and neither is compared with other rows nor changes the state.
    """
    # the state has one short row per account and joins per account and block of rows
    named = state.withColumnRenamed(key, "_key")
    blocks = rows.withColumn("_block", F.floor(F.col(seq) / _BLOCK))
    places = blocks.select(F.col(key).alias("_place"), F.col("_block").alias("_of")).distinct()
    starts = places.join(named, F.col("_place").eqNullSafe(F.col("_key"))).drop("_key")
    joined = blocks.join(
        starts, [F.col(key).eqNullSafe(F.col("_place")), F.col("_block").eqNullSafe(F.col("_of"))], "left").drop("_block", "_place", "_of")
    joined = joined.withColumn("late", F.coalesce(F.col(seq) <= F.col("last_seq"), F.lit(False)))
    joined = joined.withColumn("_start", F.coalesce("carried", opening)).drop("last_seq")
    scanned = check_continuity(
        joined.withColumns({"_balance": F.when(~F.col("late"), F.col(balance))}), key=key, order=(seq,), opening="_start",
        balance="_balance", tolerance=tolerance, **columns)
    checked = scanned.withColumns({
        "verdict": F.when(F.col("late"), "late").otherwise(F.col("verdict")),
        "previous": F.when(~F.col("late"), F.col("previous"))}).drop("_start", "_balance", "carried")
    latest = rows.groupBy(key).agg(
        F.max_by(balance, F.when(F.col(balance).isNotNull(), F.col(seq))).alias("latest"), F.max(seq).alias("newest"),
        F.max(F.when(F.col(balance).isNotNull(), F.col(seq))).alias("at"))
    both = latest.join(named, F.col(key).eqNullSafe(F.col("_key")), "full")
    # a balance that came late is older than the one carried
    fresh = F.col("at") > F.coalesce("last_seq", F.col("at") - 1)
    after = both.select(
        F.coalesce(key, "_key").alias(key), F.coalesce(F.when(fresh, F.col("latest")), "carried").alias("carried"),
        F.greatest("newest", "last_seq").alias("last_seq"))
    return checked, after


def continuity_stream(
    ledger: DataFrame, out: str, checkpoint: str, key: str = "account_id", seq: str = "seq", opening: str = "opening",
    balance: str = "balance", tolerance="0.01", buckets: int = STATE_BUCKETS, **columns,
) -> StreamingQuery:
    """Checks rows as they arrive, in order of `seq` per account over the batches; rows that come too late are flagged.

    Each micro-batch runs the batch operator, whose scan splits huge accounts, and starts from the state of its own
    accounts alone (see BalanceState). Results go to folders named by the batch number, so a repeated batch changes nothing.
    """
    spark = ledger.sparkSession
    kinds = {c: ledger.schema[c].dataType.simpleString() for c in (key, balance, seq)}
    state = BalanceState(spark, out, f"{key} {kinds[key]}, carried {kinds[balance]}, last_seq {kinds[seq]}", buckets)

    def handle(rows: DataFrame, batch: int) -> None:
        rows = stored(rows, "batch")  # read four times below
        manifest = state.manifest(batch - 1)
        touched = sorted(r[0] for r in rows.select(_bucket(key, buckets)).distinct().collect())
        before = state.read(manifest, touched)
        checked, after = check_batch(rows, before, key, opening, balance, seq, tolerance, **columns)
        checked.write.mode("overwrite").parquet(f"{out}/checked/batch={batch}")
        state.write(batch, manifest, touched, after, key)

    return (
        ledger.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
