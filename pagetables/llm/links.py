"""From signatures to components: candidates that share a bucket, a check of each, and a distributed union-find.

Items are named by a 64-bit `node`; rows (sig, node) say which bucket an item falls into. All steps stream over sorted
or hashed rows: no bucket, neighbour list or component is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm import hashing as H
from pagetables.llm.rows import each_batch, tidy
from pagetables.session import stored

BITMAP_BITS = 1 << 25
SKETCH_BITS = 1 << 12
BLOCK = 256


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sig = head = node = None
    for batch in batches:
        s, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(s):
            continue
        new, again = np.ones(len(s), bool), np.zeros(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        again[1:] = ~new[1:] & (n[1:] == n[:-1])
        if sig is not None and s[0] == sig:
            new[0], again[0] = False, n[0] == node
        at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        heads = np.where(at >= 0, n[at], head if head is not None else 0)
        keep = ~again & (n != heads)
        sig, head, node = s[-1], heads[-1], n[-1]
        rest = [c.filter(pa.array(keep)) for c in batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(s[keep]), pa.array(heads[keep]), pa.array(n[keep]), *rest], ["sig", "head", "node", *batch.schema.names[2:]])


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(sig, head, node): the smallest node of every bucket beside each of its others; lone nodes go."""
    dealt = rows.select("sig", "node").repartition("sig").sortWithinPartitions("sig", "node")
    return dealt.mapInArrow(tidy(_runs), "sig long, head long, node long")


def parts_for(spark: SparkSession) -> int:
    """Parts that packed signatures are dealt to: some for each partition of a shuffle, so that these become even."""
    return 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(sigs: np.ndarray, nodes: np.ndarray, parts: int, spare: np.ndarray | None = None) -> pa.RecordBatch:
    """Signatures, nodes and, if given, how many signatures the node can spare (0 to 127) as arrays, a row to a part.

    Equal signatures go to one part.
    """
    columns = {"sig": sigs.view(np.int64), "node": nodes.view(np.int64)} | ({} if spare is None else {"spare": spare.astype(np.int8)})
    part = (H.mix(sigs) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")  # a node's signatures stay beside each other and compress well
    part = part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    offsets = pa.array(np.append(first, len(part)).astype(np.int32))
    lists = (pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(part[first]), *lists], ["part", *columns])


def shared_packed(rows: DataFrame) -> DataFrame:
    """As `shared_buckets`, from rows that `packed` made; `spare` tells what each node but the head can spare."""
    names = rows.columns[1:]
    dealt = rows.repartition("part").select(F.inline(F.arrays_zip(*names))).sortWithinPartitions("sig", "node")
    return dealt.mapInArrow(tidy(_runs), "sig long, head long, node long" + (", spare byte" if "spare" in names else ""))


def without_crowds(shared: DataFrame) -> DataFrame:
    """Buckets of at most `BLOCK` members whole; of larger ones the head and the rows whose node is in more of these than the row's `spare`.

    A node that can spare n signatures of a kind still meets each similar one that it would meet by that kind when it gives up any
    n of them. All give up the same buckets, so the one where two meet is whole. So a shingle or two that very many texts
    have in common make no cluster of them, while a group of near copies stays one.
    """
    large = shared.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK).select("sig", F.lit(True).alias("large"))
    marked = stored(shared.join(large, "sig", "left"), "marked")
    crowds = marked.where("large")
    heads = crowds.groupBy("sig").agg(F.first("head").alias("node")).select("node")
    counted = crowds.select("node").unionByName(heads).groupBy("node").agg(F.count("*").alias("n"))
    left = crowds.join(counted, "node").where("n > spare")
    names = ["sig", "head", "node"]
    return marked.where("large is null").select(names).unionByName(left.select(names))


def bitmap(nodes: DataFrame, column: str) -> np.ndarray:
    """A bit for each value's low bits, in an array of constant size: rows without their bit are surely not among the nodes."""
    filled = nodes.select((F.col(column).bitwiseAND(F.lit(BITMAP_BITS - 1))).alias("slot")).selectExpr(
        "shiftright(slot, 5) AS cell", "shiftleft(1L, CAST(slot & 31 AS INT)) AS bit")
    cells = filled.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # BITMAP_BITS / 32 rows at most
    out = np.zeros(BITMAP_BITS // 32, np.uint32)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().astype(np.uint32)
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values & (BITMAP_BITS - 1)
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) != 0


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of the edges (a, b).

    Alternates the large-star and small-star steps until the edges are stars. Each step needs a minimum by node, which
    is summed before the shuffle, and a join; a hub's neighbours are never gathered.
    """
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")))
    now = stored(edges.where("a <> b").select(F.inline(both)).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "edges")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.inline(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        now = stored(small.where("u <> v").distinct(), "edges")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _forest(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Enough of the pairs with 100 * intersection >= percent * union to connect all that such pairs connect.

    Pairs are compared where the sides differ, or all of them where there is one side only. A parity sketch (of
    few sets, their sizes) gives a lower bound of two sets' difference; only pairs that it leaves open are intersected.
    """
    sizes = np.array([len(x) for x in sets])
    few = len(sets) <= 4
    if not few:
        bits = np.zeros((len(sets), SKETCH_BITS), np.uint8)
        for row, x in enumerate(sets):
            bits[row] = np.bincount((x >> np.uint64(20)).astype(np.int64) & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
        sketch = np.packbits(bits, axis=1).view(np.uint64)
    one_side = (side == side[0]).all()
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found = []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets)) if one_side else i + 1 + np.flatnonzero(side[i + 1 :] != side[i])
        apart = np.abs(sizes[rest] - sizes[i]) if few else np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        near = rest[(apart * (100 + percent) <= (sizes[rest] + sizes[i]) * (100 - percent)) & (sizes[rest] > 0)]
        for j in near.tolist():
            a, b = top(i), top(j)
            if a != b:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common and 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    root[max(a, b)] = min(a, b)
                    found.append((i, j))
    return found


def sketch(h: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Parities of each set's hashes over a power of two of bits: two or more for each, 256 to SKETCH_BITS in all."""
    bits = 1 << np.ceil(np.log2(np.clip(2 * sizes, 256, SKETCH_BITS))).astype(np.int64)
    base = H.bounds(bits)
    spot = (h >> np.uint64(20)).astype(np.int64) & np.repeat(bits - 1, sizes)
    parity = np.bincount(np.repeat(base[:-1], sizes) + spot, minlength=base[-1]) & 1
    data = np.packbits(parity.astype(np.uint8)).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((base // 8).astype(np.int32).tobytes()), pa.py_buffer(data)])


def _open(sizes: np.ndarray, sketches: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Which members have another that they may be similar to, by sizes and sketches, folded to the shortest one's bits.

    Where bits differ, an odd number of hashes do, so the bits that differ are a lower bound of the sets' difference.
    """
    words = min(map(len, sketches))
    bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in sketches])
    one_side = (side == side[0]).all()
    out = np.zeros(len(sizes), bool)
    for i in range(len(sizes) - 1):
        rest = np.arange(i + 1, len(sizes)) if one_side else i + 1 + np.flatnonzero(side[i + 1 :] != side[i])
        apart = np.maximum(np.abs(sizes[rest] - sizes[i]), np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64))
        near = rest[apart * (100 + percent) <= (sizes[rest] + sizes[i]) * (100 - percent)]
        out[near] = True
        out[i] |= len(near) > 0
    return out


def _dealt(clusters: DataFrame) -> DataFrame:
    """(pack, cut, head, i, j, own, node): each cluster's members in every two of its blocks; small clusters share calls."""
    parts = clusters.groupBy("head").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    packs = 1 + clusters.count() // BLOCK
    dealt = clusters.join(parts, "head").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # clusters of one block share calls, of about a block in all
    pack = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("head", F.lit("pack")), F.lit(packs))).otherwise(F.col("head"))
    return dealt.select(
        pack.alias("pack"), (F.col("parts") > 1).alias("cut"), "head", F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"), "own", "node")


def _members(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and sides of each cluster of a call that has something to compare."""
    heads, side = block.column("head").to_numpy(), block.column("own").to_numpy()
    order = np.argsort(heads, kind="stable")
    one_block = block.column("i")[0].as_py() == block.column("j")[0].as_py()
    for members in np.split(order, np.flatnonzero(np.diff(heads[order])) + 1):
        s = side[members]
        if len(members) > 1 and bool((s == s[0]).all()) == one_block:
            yield members, s


def _open_clusters(clusters: DataFrame, texts: DataFrame, sets: Callable[[pa.Array], list[np.ndarray]], percent: int) -> DataFrame:
    """(head, node) of the members that sketches do not keep apart from all others of their cluster."""
    def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = sets(batch.column("text"))
        sizes = np.array([len(x) for x in found])
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes), sketch(np.concatenate(found), sizes)], ["node", "size", "sketch"])

    def compare(block: pa.Table) -> pa.Table:
        sizes, sketches = block.column("size").to_numpy(), block.column("sketch").to_pylist()
        chosen = [m[_open(sizes[m], [np.frombuffer(sketches[k], np.uint64) for k in m.tolist()], s, percent)] for m, s in _members(block)]
        rows = np.concatenate([np.zeros(0, np.int64), *chosen])
        return pa.table({"head": block.column("head").to_numpy()[rows], "node": block.column("node").to_numpy()[rows]})

    drawn = stored(texts.mapInArrow(each_batch(draw), "node long, size long, sketch binary"), "sketches")
    blocks = _dealt(clusters).join(drawn, "node").groupBy("pack", "cut", "i", "j")
    return stored(blocks.applyInArrow(compare, "head long, node long").distinct(), "open")


def linked(shared: DataFrame, fetch: Callable[[DataFrame], DataFrame], sets: Callable[[pa.Array], list[np.ndarray]], percent: int,
           sketched: bool = False) -> DataFrame:
    """(node, component) of all nodes with a link, from buckets as `shared_buckets` gives them.

    fetch: the (node, text) of given nodes. sets: the sorted distinct shingle hashes of each text of a column.

    The member of a bucket that has most neighbours heads it; a cluster is all that share a bucket with one head. So
    any two members of a bucket meet in a cluster, while a group of near copies makes about one cluster, headed by the
    text that the others come from. A cluster is dealt to blocks of about `BLOCK` members, and each two blocks are
    compared in one task, which gives no more links than it has members: pairs are compared but never made rows.
    shared with a column `spare`: see `without_crowds`, which comes first then.
    sketched: sketches go to the blocks first, and texts only for members that these leave open; worth it where a text
    is much longer than its sketch of two bits for a shingle.
    """
    shared = stored(shared, "buckets")
    if "spare" in shared.columns:
        shared = stored(without_crowds(shared), "buckets")
    members = shared.select("sig", "node").unionByName(shared.groupBy("sig").agg(F.first("head").alias("node")))
    sized = members.join(members.groupBy("sig").agg(F.count("*").alias("n")), "sig")
    known = sized.groupBy("node").agg(F.sum("n").alias("known"))
    heads = members.join(known, "node").groupBy("sig").agg(F.max_by("node", F.struct("known", "node")).alias("head"))
    clusters = stored(members.join(heads, "sig").select("head", "node").distinct(), "clusters")
    texts = stored(fetch(clusters.select("node").distinct()), "texts")
    if sketched:
        clusters = _open_clusters(clusters, texts, sets, percent)

    def compare(block: pa.Table) -> pa.Table:
        nodes, pairs = block.column("node").to_numpy(), []
        texts = sets(block.column("text").combine_chunks()) if len(nodes) > 1 else []
        for members, side in _members(block):
            pairs += [(members[x], members[y]) for x, y in _forest([texts[m] for m in members.tolist()], side, percent)]
        a, b = (nodes[np.array([p[k] for p in pairs], np.int64)] for k in (0, 1))
        return pa.table({"a": a, "b": b})

    blocks = _dealt(clusters).join(texts, "node").groupBy("pack", "cut", "i", "j")
    return components(stored(blocks.applyInArrow(compare, "a long, b long"), "links"))
