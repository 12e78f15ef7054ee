"""Token ids of a corpus in binary shards with Elias-Fano document boundaries.

A shard holds documents in ascending order of doc_id:

    b"PTIDS001" | ids, little-endian u16 or u32 | doc_ids i64 | null flags u8 | low bits | high bits | samples u64 | footer

The document ends e_0 <= e_1 <= ... (a place in the id array each) are Elias-Fano encoded: of each, `l` low bits lie
packed side by side, and the rest is written in unary: bit (e_i >> l) + i of `high` is set. `samples` holds the place of
every 64th set bit, so that the i-th end is found by counting set bits in a few words. That takes about
2 + log2(ids / documents) bits a document. The footer names sizes and widths; its last 8 bytes are the magic again.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetables.llm import tokens
from pagetables.llm.rows import tidy
from pagetables.session import new_folder, stored

MAGIC = b"PTIDS001"
SAMPLE = 64
_FOOTER = "<QQBB6x8s"  # documents, ids, id width, low bits
_FOOTER_SIZE = struct.calcsize(_FOOTER)


def elias_fano(ends: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(low bits each, packed low bits, high bits as bytes, samples) of ascending integers."""
    ends = ends.astype(np.uint64)
    n, top = len(ends), int(ends[-1]) if len(ends) else 0
    l = max(0, (top // max(n, 1)).bit_length() - 1)
    low = np.zeros(0, np.uint8)
    if l:
        bits = (ends[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little")
    places = (ends >> np.uint64(l)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(places[-1]) + 1 if n else 0) + 63 & ~63, np.uint8)
    high[places] = 1
    return l, low, np.packbits(high, bitorder="little"), places[::SAMPLE].astype("<u8")


class EliasFano:
    """Reads what `elias_fano` made."""

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.l, self.low, self.high, self.samples = n, l, low, high.view("<u8"), samples

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        upper = (places - np.arange(self.n)) << self.l
        if not self.l:
            return upper
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.l].reshape(self.n, self.l)
        return upper + bits.astype(np.int64) @ (1 << np.arange(self.l, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th integer."""
        place = int(self.samples[i // SAMPLE])
        left, word = i % SAMPLE, place >> 6
        bits = int(self.high[word]) >> (place & 63) << (place & 63)
        while (count := bits.bit_count()) <= left:
            left -= count
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        upper = (word << 6) + (bits & -bits).bit_length() - 1 - i
        at = i * self.l
        chunk = int.from_bytes(self.low[at >> 3 : (at + self.l + 7) >> 3].tobytes(), "little")
        return upper << self.l | (chunk >> (at & 7)) & ((1 << self.l) - 1)


class Shard:
    """One file, mapped where the store is a local or mounted folder, else read."""

    def __init__(self, uri: str):
        store, path = pafs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path)
        raw = source.read_buffer()
        n, total, width, l, magic = struct.unpack(_FOOTER, raw[len(raw) - _FOOTER_SIZE :].to_pybytes())
        if magic != MAGIC or raw[:8].to_pybytes() != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        at = 8

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.ids = take("<u2" if width == 2 else "<u4", total)
        self.doc_ids, self.null = take("<i8", n), take("u1", n).astype(bool)
        samples = -(-n // SAMPLE)
        low_bytes = (n * l + 7) // 8
        low = take("u1", low_bytes)
        high = take("u1", len(raw) - _FOOTER_SIZE - 8 * samples - at)
        self.ends = EliasFano(n, l, low, high, take("<u8", samples))

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_store(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encodes and writes all rows; returns the manifest (shard, path, n_docs, n_ids), which is stored beside the shards.

    Each task writes one shard of a range of doc_ids under a name of its own; only files of the manifest count, so a
    repeated or lost task leaves no trace. Null ids come first; equal ids are ordered by text. A null or empty text has
    the end id alone. An empty table has an empty manifest. Columns other than doc_id and text are ignored.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        store, base = pafs.FileSystem.from_uri(folder)
        name, out = f"shard-{uuid.uuid4().hex}.ids", None
        sizes, doc_ids = [], []
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}")
                out.write(MAGIC)
            doc_ids.append(batch.column("doc_id"))
            for _, ids, at in encoder.blocks(batch.column("text")):
                out.write(ids.astype("<u2" if width == 2 else "<u4").tobytes())
                sizes.append(np.diff(at))
        if out is None:
            return
        ends = np.cumsum(np.concatenate(sizes))
        ids = pa.chunked_array(doc_ids).combine_chunks()
        l, low, high, samples = elias_fano(ends)
        null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        for part in (ids.fill_null(0).to_numpy().astype("<i8"), null, low, high, samples):
            out.write(part.tobytes())
        out.write(struct.pack(_FOOTER, len(ends), int(ends[-1]), width, l, MAGIC))
        out.close()
        yield pa.RecordBatch.from_pydict({
            "shard": [TaskContext.get().partitionId()], "path": [f"{folder}/{name}"], "n_docs": [len(ends)], "n_ids": [int(ends[-1])]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return stored(rows.mapInArrow(tidy(run), "shard long, path string, n_docs long, n_ids long"), "manifest")


def read_store(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards of a manifest."""
    shards = manifest.withColumn("before", F.coalesce(  # a row for each shard
        F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                ends = shard.ends.all()
                starts = np.concatenate([[0], ends[:-1]])
                for k in range(0, len(ends), 10_000):
                    a, b = starts[k : k + 10_000], ends[k : k + 10_000]
                    crcs = [tokens.crc(shard.ids[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.doc_ids[k : k + 10_000], mask=shard.null[k : k + 10_000]), pa.array(a + row["before"]),
                        pa.array(b - a), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = shards.select("path", "before").repartition(max(1, manifest.count()))  # one task each
    return shards.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
