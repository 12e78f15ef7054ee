"""Small helpers shared by the operators: reading, row keys, Arrow maps."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm import hashing

BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> F.Column:
    """Names a row by id and text, so that rows that share an id stay apart; equal rows have one key."""
    return F.xxhash64("doc_id", "text")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def modest_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of at most `BATCH_ROWS`, unless the session has a smaller limit.

    Texts of 10 000 rows, Spark's own limit, are held by the JVM and the worker at once.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _let_go() -> None:
    """Gives the memory that a task freed back to the system: workers are used again, and idle ones keep what they have."""
    hashing.forget_powers()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow that lets go of memory when its task ends."""
    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _let_go()

    return run


def each_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """Turns a function of one record batch to the form that mapInArrow takes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return tidy(run)


def crc_remainder(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def held_out(column: str, modulus: int) -> F.Column:
    """The remainder is 2."""
    return crc_remainder(column, modulus) == 2
