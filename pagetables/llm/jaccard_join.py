"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its runs of `k` words. Sizes fall into bands such that two similar sets lie in the
same band or in neighbouring ones; similar sets of a band differ in at most d elements. The hash domain is cut into p
parts, and a signature is the projection of a set to some of the parts:

- d up to 3: p = d + 3 and every subset of 3 parts; any d changes leave some 3 parts alone;
- larger d: p = d + 1 + s single parts. At least s + 1 parts are equal in both sets, so a set with at most s poor
  parts needs no signature for a poor one: one of the equal parts is rich. A part is poor without elements, or, in
  the first cut of bands of larger sets, with a single one, which may be a shingle that very many documents have.

The same holds for any parts that a set gives up, if with the poor ones they are no more than s; so buckets that very
many sets share (`links.without_crowds`) keep only the sets that cannot spare them.

A set with too many poor parts gets further signatures over a domain cut anew; two such sets meet there. So similar
sets always share the signature of a rich part, and every shared signature is followed by an exact check.
Hashes have 64 bits; that two different shingles or sets share one is not checked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm import hashing as H
from pagetables.llm.links import bitmap, in_bitmap, linked, packed, parts_for, shared_packed
from pagetables.llm.rows import each_batch, row_key, signed, tidy
from pagetables.session import stored

U = np.uint64
RECUTS = 4
PACKED = 1_000_000  # signatures that a task packs together


class Bands:
    """Size bands and the parts of each, for 100 * intersection >= percent * union."""

    def __init__(self, percent: int, largest: int = 1 << 31):
        tops = [1]
        while tops[-1] < largest:
            tops.append((tops[-1] + 1) * 100 // percent)
        self.tops = np.array(tops, np.int64)
        # sets of m and n elements differ in m + n - 2 * intersection <= (m + n) * (100 - percent) / (100 + percent)
        self.most = 2 * self.tops * (100 - percent) // (100 + percent)
        self.rich = np.where(self.most >= 20, 2, 1)
        self.spare = np.where(self.rich == 2, self.most * 9 // 20, np.maximum(8, self.most * 3 // 20))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, sizes)


def _salted(sums: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    for j, part in enumerate(parts):
        sums = sums + np.asarray(part).astype(U) * H.salt("part", j)
    return H.mix(sums)


def _cut(h: np.ndarray, sizes: np.ndarray, recut: int) -> tuple[np.ndarray, np.ndarray]:
    """Element hashes of this cut, in order by set, and what each adds to the sum of its part."""
    if recut:
        h = H.mix(h ^ H.salt("recut", recut))
        at = H.bounds(sizes)
        h = np.concatenate([np.sort(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
    return h, H.mix(h * H.salt("element"))


def signatures(h: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sorted sets, and the place of the set that each belongs to."""
    return signatures_and_spare(h, sizes, bands)[:2]


def signatures_and_spare(h: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sorted sets, the place of the set that each belongs to, and how many of its kind that set can spare (0 to 127)."""
    sigs, rows, spare = [], [], []

    def emit(s: np.ndarray, r: np.ndarray, more: np.ndarray) -> None:
        sigs.append(s)
        rows.append(r)
        spare.append(np.minimum(more, 127))

    def take(h: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.zeros(len(sizes), bool)
        keep[at] = True
        return h[np.repeat(keep, sizes)], sizes[keep]

    def cut(h: np.ndarray, sizes: np.ndarray, ids: np.ndarray, band: np.ndarray, recut: int) -> None:
        most = bands.most[band]
        if recut == RECUTS:  # what no cut has served meets in one bucket per band
            emit(_salted(np.zeros(len(ids), U), band, 3), ids, np.zeros(len(ids), np.int64))
            return
        few = (most >= 1) & (most <= 3)
        poor = [np.zeros(0, np.int64)]
        for which, serve in ((np.flatnonzero(few), _subsets), (np.flatnonzero(most > 3), _singles)):
            if len(which):
                part_h, part_sizes = (h, sizes) if len(which) == len(sizes) else take(h, sizes, which)
                s, r, bad, more = serve(*_cut(part_h, part_sizes, recut), part_sizes, band[which], recut)
                emit(s, ids[which][r], more[r])
                poor.append(which[bad])
        if len(again := np.sort(np.concatenate(poor))):
            cut(*take(h, sizes, again), ids[again], band[again], recut + 1)

    def _singles(h, adds, sizes, band, recut):
        parts = bands.most[band] + 1 + bands.spare[band]
        row = np.repeat(np.arange(len(sizes)), sizes)
        part = ((h >> U(32)) * parts.astype(U)[row]) >> U(32)
        new = np.ones(len(h), bool)
        new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        of, sums = row[first], np.add.reduceat(adds, first)
        # a set that is small for its band has many parts of one element, in any cut; those count from the second cut on
        rich = np.diff(np.append(first, len(h))) >= (1 if recut else bands.rich[band][of])
        of, first = of[rich], first[rich]
        s = _salted(sums[rich], band[of], part[first], recut, 1)
        poor = parts - np.bincount(of, minlength=len(sizes))
        return s, of, np.flatnonzero(poor > bands.spare[band]), np.maximum(bands.spare[band] - poor, 0)

    def _subsets(h, adds, sizes, band, recut):
        parts = bands.most[band] + 3
        row = np.repeat(np.arange(len(sizes)), sizes)
        part = (((h >> U(32)) * parts.astype(U)[row]) >> U(32)).astype(np.int64)
        sums = np.zeros((len(sizes), 6), U)
        np.add.at(sums, (row, part), adds)
        s, of, bad = [], [], []
        for p in (4, 5, 6):
            which = np.flatnonzero(parts == p)
            for j, chosen in enumerate(combinations(range(p), 3)):
                total = sum((sums[which, c] * (H.salt("place", c) | U(1)) for c in chosen), np.zeros(len(which), U))
                some = (sums[np.ix_(which, chosen)] != 0).any(axis=1)
                s.append(_salted(total, band[which], j, recut, 2)[some])
                of.append(which[some])
                bad.append(which[~some])
        return np.concatenate(s), np.concatenate(of), np.unique(np.concatenate(bad)), np.zeros(len(sizes), np.int64)

    own = bands.of(sizes)
    for shift in (0, 1):
        band = own + shift
        which = np.flatnonzero((sizes > 0) & (bands.most[band] > 0))
        if len(which):
            cut(*take(h, sizes, which), which, band[which], 0)
    if not sigs:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(rows), np.concatenate(spare)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, data, offsets in H.blocks(column):
        yield row, *H.word_shingles(*H.word_hashes(data, offsets), k)


def _set_ids(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash per set; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(H.mix(h * H.salt("set")))])
    at = H.bounds(sizes)
    ids = H.mix(sums[at[1:]] - sums[at[:-1]] + sizes.astype(U) * H.salt("size"))
    return np.where(sizes > 0, ids | U(1), U(0))


def document_sets(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, row_key, n_shingles, node): size and identity of each row's shingle set; node is null for an empty set."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, nodes = [], []
        for _, h, n in _sets(batch.column("text"), k):
            sizes.append(n)
            nodes.append(_set_ids(h, n))
        sizes, nodes = np.concatenate(sizes), np.concatenate(nodes).view(np.int64)
        out = [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes), pa.array(nodes, mask=sizes == 0)]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "row_key", "n_shingles", "node"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    return rows.mapInArrow(each_batch(run), "doc_id long, row_key long, n_shingles long, node long")


def signature_rows(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Packed (sig, node) of every distinct set; copies met in one task count once."""
    bands, parts = Bands(percent), parts_for(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, h, sizes in _sets(batch.column(0), k):
                nodes = _set_ids(h, sizes)
                new = np.zeros(len(sizes), bool)
                for i, node in enumerate(nodes.tolist()):
                    if node and node not in seen:
                        seen.add(node)
                        new[i] = True
                sigs, rows, spare = signatures_and_spare(h[np.repeat(new, sizes)], sizes[new], bands)
                held.append((sigs, nodes[new][rows], spare))
                if sum(len(x) for x, *_ in held) > PACKED:
                    sigs, of, spare = map(np.concatenate, zip(*held, strict=True))
                    yield packed(sigs, of, parts, spare)
                    held = []
        if held:
            sigs, of, spare = map(np.concatenate, zip(*held, strict=True))
            yield packed(sigs, of, parts, spare)

    return docs.select("text").mapInArrow(tidy(run), "part long, sig array<long>, node array<long>, spare array<byte>")


def _text_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The text of one row of each node."""
    chosen = stored(sets.join(nodes, "node").groupBy("node").agg(F.min("row_key").alias("row_key")), "chosen")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(chosen, "row_key"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(in_bitmap(bits.value, batch.column("row_key").to_numpy())))

    near = docs.select(row_key().alias("row_key"), "text").mapInArrow(each_batch(run), "row_key long, text string")
    return near.join(chosen, "row_key").dropDuplicates(["node"]).select("node", "text")


def _set_list(column: pa.Array, k: int) -> list[np.ndarray]:
    return [part for _, h, sizes in _sets(column, k) for part in np.split(h, np.cumsum(sizes)[:-1])]


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included).

    Words are runs of bytes other than blanks, with A-Z lower-cased. Rows with fewer than k words have one shingle; a
    null, empty or blank text has none and links with nothing. Equal rows give equal rows. A row with a null doc_id
    takes part; it gets the smallest id of its component, or null where no member has one. Other columns are ignored.
    """
    sets = stored(document_sets(docs, k), "sets")
    groups = linked(
        shared_packed(signature_rows(docs, k, percent)),
        lambda nodes: _text_of(docs, sets, nodes), lambda column: _set_list(column, k), percent, sketched=True)
    by_node = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    by_node = by_node.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = by_node.groupBy("component").agg(F.min("low").alias("component_id"))
    of_node = by_node.join(lowest, "component").select("node", "component_id")
    found = sets.join(of_node, "node", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs without those that link, over any steps, to a document of smaller id; all columns stay.

    Rows without words stay, and so do rows with a null id. Rows that repeat an id of a component's first document
    stay with it.
    """
    gone = jaccard_components(docs, k, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
