"""Quartile bucket digests of whole texts.

Hashed byte triplets (the six of each window of five bytes that hold its last byte) are counted in `BUCKETS` buckets. The
digest is a header, the length in steps of a sixteenth of a power of two, and two bits per bucket: how many of the three
quartiles of all counts its own count exceeds. The difference of two digests adds up the differences of the bucket
codes, capped, and of the length codes, capped; it has a fixed largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetables.llm.rows import tidy

from pagetables.session import stored

BUCKETS = 256
LENGTH_CAP = 64
CODE_MEAN = 1.25  # of two unrelated codes, each 0 to 3 with equal chances
_PAIRS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))  # how far back the two others lie
_FACTORS = np.array([[0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D + 2 * k] for k in range(len(_PAIRS))], np.uint32)


def bucket_counts(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    n = len(data)
    for (i, j), (a, b, c) in zip(_PAIRS, _FACTORS, strict=True):
        if n > j:
            x = data[j:] * a
            x += data[j - i : n - i] * b
            x ^= x >> np.uint32(15)
            x += data[: n - j] * c
            x *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(x >> np.uint32(24), minlength=BUCKETS)
    return counts


def codes(raw: bytes) -> tuple[int, np.ndarray]:
    """(length code, bucket codes)."""
    counts = bucket_counts(raw)
    quartiles = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    return int(round(16 * np.log2(len(raw) + 1))), (counts[:, None] > quartiles).sum(axis=1).astype(np.uint8)


def encode(length: int, bucket: np.ndarray) -> str:
    two = np.unpackbits(bucket[:, None], axis=1)[:, 6:].reshape(-1)
    return f"Q1{length:04x}" + np.packbits(two).tobytes().hex()


def decode(digest: str) -> tuple[int, np.ndarray]:
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(digest[6:]), np.uint8)).reshape(-1, 2)
    return int(digest[2:6], 16), bits[:, 0] * np.uint8(2) + bits[:, 1]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """1 for equal digests, 0 where the difference is that of unrelated ones or more."""
    body = np.abs(a[1].astype(np.int16) - b[1]).sum() / (CODE_MEAN * BUCKETS)
    length = min(abs(a[0] - b[0]), LENGTH_CAP) / LENGTH_CAP
    return float(max(0.0, 1.0 - min(1.0, body) * 0.9 - length * 0.1))


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
COLUMNS = ", ".join(f"{f.name} {'long' if pa.types.is_int64(f.type) else 'string' if pa.types.is_string(f.type) else 'double'}" for f in _OUT)


def _compared(doc_id: int | None, text: str, mine: tuple, after: str, theirs: tuple) -> dict:
    half = len(text) // 2
    edited = (text[: len(text) - half] + after[:half]).encode() if half else text.encode()
    other = codes(edited)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited).hexdigest(), "fingerprint": encode(*mine),
        "edited_fingerprint": encode(*other), "near_edited": likeness(mine, other), "near_next": likeness(mine, theirs)}


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row; a null text is empty. Equal texts have equal fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            out = [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([encode(*codes(x.encode())) for x in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_chars long, fingerprint string")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Digests of each row's text and of the text edited with that of the next row by descending doc_id.

    The last floor(n_chars / 2) characters give way to as many first ones of the next row's text (all of it if it is
    shorter); the last row is followed by the first. Null ids come last, rows with one id by text. A null text is
    empty. A single row is its own next one. Columns other than doc_id and text are ignored.

    Rows are sorted by ranges. Within a range each row meets the one after it; the last of each range waits, and is
    joined with the first of the next range that has rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                mine = codes(text.encode())
                if last is None:
                    rows.append({"doc_id": doc_id, "part": part, "role": "first", "text": text})
                else:
                    rows.append(_compared(*last, text, mine) | {"part": part, "role": "done"})
                last = doc_id, text, mine
            yield pa.RecordBatch.from_pylist(rows, schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": last[0], "part": part, "role": "last", "text": last[1]}], schema)

    schema = pa.schema([*_OUT, ("part", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    found = stored(dealt.mapInArrow(tidy(run), f"{COLUMNS}, part long, role string, text string"), "digests")

    parts = found.where("role = 'first'").select("part")  # one row for each range
    following = parts.withColumn("after", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))))
    last = found.where("role = 'last'").select("part", "doc_id", "text").join(following, "part")
    first = found.where("role = 'first'").select(F.col("part").alias("after"), F.col("text").alias("after_text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([
                _compared(r["doc_id"], r["text"], codes(r["text"].encode()), r["after_text"], codes(r["after_text"].encode())) for r in batch.to_pylist()], _OUT)

    ends = last.join(first, "after").select("doc_id", "text", "after_text").mapInArrow(finish, COLUMNS)
    return found.where("role = 'done'").select(*_OUT.names).unionByName(ends)
