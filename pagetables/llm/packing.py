"""Packing documents into sequences by linear grouping.

Lengths are integers up to the capacity, so a histogram of constant size describes the whole problem; it is solved on
the driver, and its solution in runs of equal sequences is applied to any number of documents by their rank.

1. Lengths over a share of the capacity (`LARGE`) are large. In descending order they are cut to groups of equal cardinality,
   and each is rounded up to its group's largest.
2. For these few sizes a linear program over configurations (multisets of sizes that fit) is solved by column
   generation; each configuration is used a whole number of times, rounded down.
3. Actual documents, never longer than their group's size, take the places of the rounded ones.
4. What the rounding left over, and then the small ones, go by descending length to the fullest sequence that has room.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetables.llm import tokens
from pagetables.llm.rows import each_batch
from pagetables.session import stored

CAPACITY = 1024
GROUPS = 1024  # so many equal groups leave about one length to each
LARGE = (0.4, 0.5)  # the split that needs fewer sequences is taken
_KEY = 1 << 50


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) and whole numbers of uses that never exceed the demand."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    room = np.arange(capacity + 1)
    for _ in range(8 * k):
        price = inverse.sum(axis=0)
        # the most valuable configuration: a knapsack over all capacities
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for _ in range(capacity // int(sizes.min())):
            value = np.where(room >= sizes[:, None], price[:, None] + best[np.maximum(room - sizes[:, None], 0)], -1.0)
            top = value.argmax(axis=0)
            better = value[top, room] > best + 1e-12
            if not better.any():
                break
            best, last = np.where(better, value[top, room], best), np.where(better, top, last)
        value = float((price * demand).sum())
        if value - value / max(best[capacity], 1.0) < 0.5:  # the optimum is at least the latter
            break
        column, left = np.zeros(k), capacity
        while last[left] >= 0:
            column[last[left]] += 1
            left -= sizes[last[left]]
        amount, change = ((inverse * x).sum(axis=1) for x in (demand, column))
        rising = change > 1e-9
        ratio = np.where(rising, np.maximum(amount, 0) / np.where(rising, change, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        inverse[out] /= change[out]
        others = np.arange(k) != out
        inverse[others] -= change[others, None] * inverse[out]
    uses = np.floor(np.maximum((inverse * demand).sum(axis=1), 0) + 1e-9).astype(np.int64)
    found, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-uses):
        column = basis[:, j].astype(np.int64)
        n = min(int(uses[j]), *(int(left[g] // column[g]) for g in np.flatnonzero(column)))
        if n:
            found.append((column, n))
            left -= column * n
    return found


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """The plan (see `_packed`) with the fewest sequences over the values of LARGE."""
    return min((_packed(counts, capacity, groups, share) for share in LARGE), key=lambda plan: plan[1])


def _packed(counts: dict[int, int], capacity: int, groups: int, large_share: float) -> tuple[np.ndarray, int]:
    """Where documents go, and the number of sequences, for counts[length] documents of each length.

    A row (length, first, last, sequence, each, offset) says that the documents of this length with a rank r in
    first .. last - 1 go to sequence + (r - first) // each, at offset + (r - first) % each * length.
    """
    placed: list[tuple[int, int, int, int, int, int]] = []
    used = {length: 0 for length in counts}
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: first sequence, how many
    total = 0

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        placed.append((length, used[length], used[length] + n, sequence, each, offset))
        used[length] += n

    large = [(length, n) for length, n in sorted(counts.items(), reverse=True) if length > capacity * large_share and n]
    if large:
        ends = np.cumsum([n for _, n in large])
        cuts = np.unique((np.arange(1, groups + 1) * int(ends[-1])) // groups)
        members: list[list[list[int]]] = []  # of each group: [length, how many are left], descending
        at = 0
        for low, high in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            group: list[list[int]] = []
            while low < high:
                n = min(high, int(ends[at])) - low
                group.append([large[at][0], n])
                low += n
                at += low == ends[at]
            if group and members and members[-1][0][0] == group[0][0]:
                members[-1] += group
            elif group:
                members.append(group)
        sizes = np.array([g[0][0] for g in members])
        demand = np.array([sum(n for _, n in g) for g in members], float)
        for column, n in _configurations(sizes, demand, capacity):
            slots = [int(g) for g in np.flatnonzero(column) for _ in range(int(column[g]))]
            while n:  # runs of sequences whose documents have the same lengths
                # places alternate between a group's longest and shortest, so that sums are even
                ends_of = [(members[g], -1 if j % 2 else 0) for j, g in enumerate(slots)]
                need: dict[int, int] = {}
                for group, end in ends_of:
                    need[id(group[end])] = need.get(id(group[end]), 0) + 1
                run = min(n, *(group[end][1] // need[id(group[end])] for group, end in ends_of))
                if not run:  # one length is too few for its places: a single sequence, place by place
                    run, lengths = 1, []
                    for group, end in ends_of:
                        lengths.append(group[end][0])
                        group[end][1] -= 1
                        if not group[end][1]:
                            group.pop(end)
                else:
                    lengths = [group[end][0] for group, end in ends_of]
                    for group, end in ends_of:
                        group[end][1] -= run
                    for g in set(slots):
                        members[g][:] = [x for x in members[g] if x[1]]
                offset = 0
                for length in lengths:
                    put(length, run, total, 1, offset)
                    offset += length
                open_runs[capacity - offset].append((total, run))
                total += run
                n -= run
    for length in sorted(counts, reverse=True):
        left = counts[length] - used[length]
        for room in range(length, capacity + 1):
            if not left:
                break
            each, runs = room // length, open_runs[room]
            while runs and left:
                first, n = runs.pop()
                full = min(n, left // each)
                if full:
                    put(length, full * each, first, each, capacity - room)
                    open_runs[room - each * length].append((first, full))
                    left -= full * each
                elif left:
                    full = 1
                    put(length, left, first, left, capacity - room)
                    open_runs[room - left * length].append((first, 1))
                    left = 0
                if n > full:
                    runs.append((first + full, n - full))
        each = capacity // length
        for n, per in ((left // each, each), (1 if left % each else 0, left % each)):
            if n:
                put(length, n * per, total, per, 0)
                open_runs[capacity - per * length].append((total, n))
                total += n
    return np.array(sorted(placed), np.int64).reshape(-1, 6), total


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids; with_ids adds them.

    Only documents of more than `capacity` ids are cut; their first piece takes what is left over. A null text is
    empty: one piece, the end id.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        source, piece, start, length, crcs, parts = [], [], [], [], [], []
        for first, ids, at in tokens.encoder(tokenizer_path).blocks(batch.column("text")):
            for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                cut = [a, *range(a + ((b - a - 1) % capacity) + 1, b + 1, capacity)]
                for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    source.append(first + row)
                    piece.append(k)
                    start.append(x - a)
                    length.append(y - x)
                    crcs.append(tokens.crc(ids[x:y]))
                    if with_ids:
                        parts.append(ids[x:y].astype(np.int32))
        out = [batch.column("doc_id").take(pa.array(source)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crcs))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays(out + [pa.array(parts, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each_batch(run), kind)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to `capacity`; other columns stay.

    The rows are stored first, so that ranks and places belong to the same rows whatever is computed again.
    """
    cut = stored(cut, "pieces")
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    plan, _ = pack_histogram(counts, capacity)
    chunks = 1 + sum(counts.values()) // 1_000_000
    cut = cut.withColumn("__chunk", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(chunks)))
    before = cut.groupBy("length", "__chunk").count().select("length", "__chunk", F.coalesce(F.sum("count").over(
        Window.partitionBy("length").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__chunk").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = cut.withColumn("__within", within).join(before, ["length", "__chunk"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__within") - 1).select(*[c for c in cut.columns if c != "__chunk"], "__rank")
    keys = plan[:, 0] * _KEY + plan[:, 1]
    names = [c for c in ranked.columns if c != "__rank"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
        row = plan[np.searchsorted(keys, length * _KEY + rank, side="right") - 1]
        step, each = rank - row[:, 1], row[:, 4]
        out = [pa.array(row[:, 3] + step // each), pa.array(row[:, 5] + step % each * length)]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *out], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")
    return ranked.mapInArrow(each_batch(run), f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rows with one id, or with a null id, are packed like others, each as a document of its own. An empty table gives no
    rows. Columns other than doc_id and text are ignored.
    """
    return place(pieces(docs, tokenizer_path, capacity), capacity)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the doc_id and offset of each piece in order of place."""
    placed = place(pieces(docs, tokenizer_path, capacity, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # at most `capacity` ids in all
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
