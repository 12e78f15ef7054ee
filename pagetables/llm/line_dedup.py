"""Fuzzy line deduplication by MinHash.

A line's set holds its runs of `SHINGLE` characters (bytes outside blanks and all; a shorter line is one shingle).
Lines are near copies at a Jaccard similarity of 0.8 or more. Sixty minima in twelve bands of five give candidates: a
pair at exactly 0.8 shares a band with a probability of 0.99, at 0.9 of 0.9999, whatever the lengths. Candidates are
checked exactly, and of each component of near copies the first line stays (by doc_id, then by its place).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.functions.cells import bind
from pagetables.llm import hashing as H
from pagetables.llm.links import bitmap, in_bitmap, linked, shared_buckets
from pagetables.llm.rows import row_key, signed, tidy
from pagetables.session import stored

U = np.uint64
SHINGLE, BANDS, ROWS = 8, 12, 5
PERCENT = 80
PARTS = 64  # of a component
PORTION = 1 << 16  # bytes of lines that are signed together, so that the work stays near the processor
_FACTORS = [np.uint32(H.salt("permutation", j) >> U(32)) | np.uint32(1) for j in range(BANDS * ROWS)]


def _minima(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of every set, each of the upper halves of the hashes times an odd number of its own.

    The hashes are mixed already, so that a product orders them as a permutation drawn at random does (tested).
    """
    out = np.empty((BANDS * ROWS, len(first) - 1), np.uint32)
    half = (h >> U(32)).astype(np.uint32)
    x = np.empty_like(half)
    for j, factor in enumerate(_FACTORS):
        np.multiply(half, factor, out=x)
        np.minimum.reduceat(x, first[:-1], out=out[j])
    return out.T


def band_hashes(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the bands of every set of shingles (which may repeat), a row of BANDS for each; no set is empty."""
    keys = np.array([H.salt("row", j) | U(1) for j in range(ROWS)])
    bands = np.array([H.salt("band", j) for j in range(BANDS)])
    found = _minima(h, H.bounds(sizes)).reshape(len(sizes), BANDS, ROWS)
    return H.mix((H.mix(found.astype(U)) * keys).sum(axis=2) + bands)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """All lines of a block that have more than blanks, with their names."""
    raw = data.tobytes()
    found = [line for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for line in raw[a:b].split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
    names = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in found), np.uint64, len(found))
    return found, names.view(np.int64)


def _packed(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(lines), np.uint8), H.bounds(np.fromiter(map(len, lines), np.int64, len(lines)))


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of SHINGLE characters (repeats stay), and the place of each row's first.

    A row of fewer characters has one shingle, the whole text. Eight bytes are hashed as one number, others as spans.
    """
    lead = (data & 0xC0) != 0x80
    plain = lead.all()  # a character to a byte
    chars = None if plain else np.append(np.flatnonzero(lead), len(data))
    place = offsets if plain else np.searchsorted(chars[:-1], offsets)
    counts = np.diff(place)
    per_row = np.where(counts >= SHINGLE, counts - SHINGLE + 1, counts > 0)
    first = H.bounds(per_row)
    start = np.arange(first[-1]) + np.repeat(place[:-1] - first[:-1], per_row)
    if plain:
        rows = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        other, stop = first[rows], place[rows + 1]
    else:
        stop = chars[np.minimum(start + SHINGLE, np.repeat(place[1:], per_row))]
        start = chars[start]
        other = np.flatnonzero(stop - start != 8)
        stop = stop[other]
    padded = np.append(data, np.zeros(7, np.uint8))
    h = H.mix(np.ndarray(len(data), "<u8", padded, strides=1).copy()[start])
    if len(other):
        h[other] = H.Spans(data).hash(start[other], stop)
    return h, first


def _portions(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of lines of about PORTION bytes: memory follows the longest line, not the longest text."""
    ends = H.bounds(np.fromiter(map(len, lines), np.int64, len(lines)))
    cuts = np.searchsorted(ends, np.arange(0, ends[-1], PORTION)).tolist()
    yield from (cut for cut in zip(cuts, [*cuts[1:], len(lines)], strict=True) if cut[0] < cut[1])


def signature_rows(docs: DataFrame) -> DataFrame:
    """(sig, node) of the bands of every distinct line; copies met in one task count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in H.blocks(batch.column(0)):
                lines, names = _lines(data, offsets)
                new = []
                for i, name in enumerate(names.tolist()):
                    if name not in seen:
                        seen.add(name)
                        new.append(i)
                lines, names = [lines[i] for i in new], names[new]
                for a, b in _portions(lines):
                    h, first = _shingles(*_packed(lines[a:b]))
                    sigs = band_hashes(h, np.diff(first)).reshape(-1)
                    yield pa.RecordBatch.from_arrays([signed(sigs), pa.array(np.repeat(names[a:b], BANDS))], ["sig", "node"])

    return docs.select("text").mapInArrow(tidy(run), "sig long, node long")


def _text_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The text of each line named."""
    nodes = stored(nodes, "chosen")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in H.blocks(batch.column(0)):
                lines, names = _lines(data, offsets)
                texts, kept = [], []
                for i in np.flatnonzero(in_bitmap(bits.value, names)).tolist():
                    name = int(names[i])
                    if name not in seen:
                        seen.add(name)
                        kept.append(name)
                        texts.append(lines[i].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(texts, pa.string())], ["node", "text"])

    near = docs.select("text").mapInArrow(tidy(run), "node long, text string")
    return near.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _set_list(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, data, offsets in H.blocks(column):
        h, first = _shingles(data, offsets)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            ordered = np.sort(h[a:b])
            out.append(ordered[np.append(ordered[1:] != ordered[:-1], True)] if b > a else ordered)
    return out


def near_lines(docs: DataFrame) -> DataFrame:
    """(node, component) of all distinct lines with a near copy; a node is the xxhash64 of a line."""
    return linked(shared_buckets(signature_rows(docs)), lambda nodes: _text_of(docs, nodes), _set_list, PERCENT)


def _split() -> F.Column:
    return F.split("text", "\n", -1)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(row_key, lines): the places, from 0, of each row's lines that repeat or nearly repeat an earlier line."""
    # keys first: after the split they would read the whole text for each line
    keyed = docs.select("doc_id", row_key().alias("row_key"), _split().alias("lines"))
    lines = keyed.select("doc_id", "row_key", F.posexplode_outer("lines").alias("place", "line"))
    seen = stored(lines.where(F.col("line").rlike("[^ \\t\\r\\x0B\\x0C]")).select(
        F.xxhash64("line").alias("node"), "doc_id", "row_key", "place"), "lines")
    # ids in order, a null id after all others
    spot = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key", "place")
    first = seen.groupBy("node").agg(F.min(spot).alias("first"), F.count("*").alias("copies"))
    first = first.join(near_lines(docs), "node", "left").where("copies > 1 or component is not null").drop("copies")
    # a component of very many lines is told its first line in parts
    first = stored(first.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.lit(PARTS))), "first")
    parts = first.where("component is not null").groupBy("component", "part").agg(F.min("first").alias("first"))
    told = parts.select("component", "part").join(parts.groupBy("component").agg(F.min("first").alias("stay")), "component")
    dropping = first.join(told, ["component", "part"], "left").select("node", F.coalesce("stay", "first").alias("stay"))
    gone = seen.join(dropping, "node").where(
        ~(F.col("row_key").eqNullSafe(F.col("stay.row_key")) & (F.col("place") == F.col("stay.place"))))
    return gone.groupBy("row_key").agg(F.collect_set("place").alias("lines"))  # a row's own lines


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with every line removed that repeats, exactly or nearly, a line before it in the whole table.

    Adds n_lines and n_removed (columns of docs with these names are replaced); all rows and other columns stay. Lines
    end at a newline. Lines of blanks only stay as they are and count as no copy. A null text stays null, with no
    lines; an empty text has one (blank) line. Rows that are equal in id and text lose the same lines. A row with a
    null id comes after all others. Lines of any length are compared whole.
    """
    own = {"__gone_key", "__gone", "__row_key"} & set(docs.columns)
    if own:  # these stand aside
        aside = {c: f"{c}_of_docs" for c in own}
        return dedup_lines(docs.withColumnsRenamed(aside)).withColumnsRenamed({v: k for k, v in aside.items()})
    gone = repeated_lines(docs).withColumnsRenamed({"row_key": "__gone_key", "lines": "__gone"})
    rows = docs.withColumn("__row_key", row_key()).join(gone, F.col("__row_key") == F.col("__gone_key"), "left")
    # places by a hash set, then the lines at them: the time follows the number of lines
    left = F.array_except(F.sequence(F.lit(0), F.size(_split()) - 1), F.col("__gone"))
    kept = F.array_join(bind(_split(), lambda lines: F.transform(left, lambda i: F.get(lines, i))), "\n")
    return rows.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(_split())),
        "n_removed": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")),
    }).withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).drop("__row_key", "__gone_key", "__gone")
