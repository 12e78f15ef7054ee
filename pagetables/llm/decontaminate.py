"""Benchmark decontamination by edit distance over words.

A benchmark item of n words is found in a document where some stretch of its words lies within floor(n / 5) word edits.
Every window of n words of every document is a candidate:

1. A window within k edits of an item has at least n - k words that occur in the benchmark, and at least r - k of the
   r rare ones among them, where the items of its size have r or more; places and running sums tell both.
2. CGK walks read the words of the windows that are left: a pointer moves on or stays by a random bit of the word that it reads, so
   that two texts fall into step again soon after an edit, and edits become differing steps. A walk drifts over many
   edits, so walks begin anew at k + 1 places of an item, and anywhere in a window. A few sampled steps of a walk make
   its key (bit sampling); `REPEATS` walks with other bits and samples bring the recall. An item's walk that begins at most k words from where the window has its key
   makes a pair.
3. What all walks miss is found by pieces: the k + 1 places cut an item in pieces of two to five words (an item of one word is one
   piece), any k edits leave one of them as it is, and a piece found at most k words from its place makes a pair as well. So no
   match is lost at any size or kind of edit; tests measure the recall of the walks alone.
4. Pairs are checked by exact dynamic programming over words, once for all neighbouring windows of a document and an item.

Words are runs of bytes other than blanks, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm import hashing as H
from pagetables.llm.rows import tidy

REPEATS, SAMPLES = 8, 3  # walks from each place, and steps of each that make its key
EDIT_PART = 5
COMMON_SHARE = 0.03  # of the items: words in more of them are common
PAIRS = 500_000  # of windows and items that are put together at once
CELLS = 400_000  # of texts' words that are compared at once
_EDIT = 1 << 32  # an edit in sums that hold a place too
ITEMS_BYTES = 4 << 20  # of benchmark text in one pass over the documents
U = np.uint64
_PAD = H.salt("pad")


@dataclass
class Items:
    """Benchmark items, ordered by size, and their pieces."""

    ids: np.ndarray
    sizes: np.ndarray
    words: np.ndarray  # of all items
    begin: np.ndarray  # of each item in them
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: hashes, ascending; the item of each; where it has it
    walks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by number of steps: keys, ascending; the item of each; where it begins
    rare: dict[int, tuple[int, np.ndarray]]  # by size: the least count of rare words in an item; which words are rare there
    vocabulary: np.ndarray
    cells: np.ndarray  # which high bits occur in the vocabulary


def walk_keys(words: np.ndarray, at: np.ndarray, stop: np.ndarray, steps: int, repeat: int) -> np.ndarray:
    """The key of the walk of so many steps from each place, in one repetition; words behind `stop` do not count."""
    taken = np.random.default_rng([repeat, steps]).choice(steps, min(SAMPLES, steps), replace=False)
    keys, at = np.full(len(at), H.salt("walk", repeat, steps)), at.copy()
    for j in range(int(taken.max()) + 1):
        out = np.where(at < stop, words[np.minimum(at, len(words) - 1)], _PAD)
        if j in taken:
            keys = H.mix(keys ^ out) + U(j)
        bit = (out ^ H.salt("bit", repeat, j)) * U(0x9E3779B97F4A7C15)
        at += (bit >> U(63)).astype(np.int64)
    return H.mix(keys)


def least_edits(items: np.ndarray, texts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row, the smallest number of word edits between an item and a stretch of a text, that stretch's start, and its length.

    A stretch may begin where `starts`, as wide as the text, is true. Of equal edits the first start counts, then the shortest stretch.
    """
    rows, n = items.shape
    width = texts.shape[1]
    along = np.arange(width + 1) * _EDIT

    def with_insertions(x: np.ndarray) -> np.ndarray:
        return np.minimum.accumulate(x - along, axis=1) + along

    # sums of edits, in their low half where the stretch began
    before = np.full((rows, width + 1), 1 << 60)
    before[:, :-1] = np.where(starts, np.arange(width), 1 << 60)
    before = with_insertions(before)
    for i in range(n):
        row = before + _EDIT
        np.minimum(row[:, 1:], before[:, :-1] + (texts != items[:, i : i + 1]) * _EDIT, out=row[:, 1:])
        before = with_insertions(row)
    end, best = before.argmin(axis=1), before.min(axis=1)
    return best // _EDIT, best % _EDIT, end - best % _EDIT


def _runs(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the runs of m words from each place."""
    return H.mix(sum((h[at + j] * H._GRAM[j] for j in range(m)), np.full(len(at), m, U)))


def _by_key(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, owner, place = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(keys, kind="stable")
    return keys[order], owner[order], place[order]


def _tables(words: np.ndarray, begin: np.ndarray) -> tuple[dict, dict]:
    """Pieces by length and walks by steps, of the k + 1 places of every item."""
    pieces: dict[int, list[tuple[int, int, int]]] = {}
    walks: dict[int, list[tuple[int, int, int]]] = {}
    for k, n in enumerate(np.diff(begin).tolist()):
        parts = n // EDIT_PART + 1
        cuts = [j * n // parts for j in range(parts + 1)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            pieces.setdefault(b - a, []).append((int(begin[k]) + a, k, a))
            # two steps read about one word, and none reads behind the item
            walks.setdefault(min(2 * (b - a), n - a), []).append((int(begin[k]) + a, k, a))
    found, walked = {}, {}
    for m, rows in pieces.items():
        at, owner, place = np.array(rows).T
        found[m] = _by_key([(_runs(words, at, m), owner, place)])
    for steps, rows in walks.items():
        at, owner, place = np.array(rows).T
        walked[steps] = _by_key([(walk_keys(words, at, begin[owner + 1], steps, r), owner, place) for r in range(REPEATS)])
    return found, walked


def prepared(rows: list[tuple[int, str]]) -> Items | None:
    found: list[tuple[int, np.ndarray]] = []
    for row, data, offsets in H.blocks(pa.array([t for _, t in rows], pa.string())):
        h, place = H.word_hashes(data, offsets)
        found += [(rows[row + k][0], h[a:b]) for k, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True)) if b > a]
    if not found:
        return None
    found.sort(key=lambda x: (len(x[1]), x[0]))
    sizes = np.array([len(w) for _, w in found])
    words, begin = np.concatenate([w for _, w in found]), H.bounds(sizes)
    vocabulary, spread = np.unique(np.concatenate([np.unique(w) for _, w in found]), return_counts=True)
    common = spread > max(1, COMMON_SHARE * len(found))
    spots = np.searchsorted(vocabulary, words)
    few = ~common[spots]
    counts = np.add.reduceat(few.astype(np.int64), begin[:-1])
    rare: dict[int, tuple[int, np.ndarray]] = {}
    for n in np.unique(sizes).tolist():
        low, high = np.searchsorted(sizes, n, "left"), np.searchsorted(sizes, n, "right")
        own = slice(begin[low], begin[high])
        rare[n] = int(counts[low:high].min()), np.unique(spots[own][few[own]])
    cells = np.zeros(1 << 20, bool)
    cells[(vocabulary >> U(44)).astype(np.int64)] = True
    return Items(np.array([i for i, _ in found]), sizes, words, begin, *_tables(words, begin), rare, vocabulary, cells)


def _known(h: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that occur in the benchmark, and where each stands in the vocabulary."""
    maybe = np.flatnonzero(items.cells[(h >> U(44)).astype(np.int64)])
    spot = np.minimum(np.searchsorted(items.vocabulary, h[maybe]), len(items.vocabulary) - 1)
    same = items.vocabulary[spot] == h[maybe]
    return maybe[same], spot[same]


def _starts(places: np.ndarray, need: int, n: int, total: int) -> np.ndarray:
    """Starts of windows of n that hold at least `need` of the places."""
    low, high = np.maximum(places[need - 1 :] - n + 1, 0), places[: len(places) - need + 1]
    some = low <= high
    if not some.any():
        return places[:0]
    change = np.bincount(low[some], minlength=total + 1) - np.bincount(high[some] + 1, minlength=total + 1)
    return np.flatnonzero(np.cumsum(change)[:total])


def _stretch(h: np.ndarray, stop: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Up to `width` words from each place, padded behind the end of its row."""
    spots = at[:, None] + np.arange(width)
    return np.where(spots < stop[:, None], h[np.minimum(spots, len(h) - 1)], _PAD)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of every range from low to before high, and the range that it belongs to."""
    counts = high - low
    of = np.repeat(np.arange(len(low)), counts)
    return np.arange(len(of)) - (H.bounds(counts)[:-1] - low)[of], of


def _seeds(h: np.ndarray, stop: np.ndarray, sums: np.ndarray, read: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, item, place in the item) of every walk and piece of a block that begins at a place to be read, by place."""
    found = [(read[:0], read[:0], read[:0])]

    def look(at: np.ndarray, keys: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        spot, of = _spread(np.searchsorted(table[0], keys, "left"), np.searchsorted(table[0], keys, "right"))
        found.append((at[of], table[1][spot], table[2][spot]))

    for steps, table in items.walks.items():
        for repeat in range(REPEATS):
            look(read, walk_keys(h, read, stop[read], steps, repeat), table)
    for m, table in items.pieces.items():
        at = read[read + m <= stop[read]]
        at = at[sums[at + m] - sums[at] == m]
        look(at, _runs(h, at, m), table)
    places, owners, offsets = (np.concatenate(x) for x in zip(*found, strict=True))
    every = np.unique(np.stack([places, owners, offsets]), axis=1)
    return every[0], every[1], every[2]


def _windows(rare: np.ndarray, sums: np.ndarray, stop: np.ndarray, n: int, least: int) -> np.ndarray:
    """Starts of the windows of n that have words enough of the benchmark."""
    spare = n // EDIT_PART
    at = np.arange(len(stop))
    if least > spare:
        if len(rare) < least - spare:
            return at[:0]
        at = _starts(rare, least - spare, n, len(stop))
        inside = np.searchsorted(rare, np.minimum(at + n, stop[at])) - np.searchsorted(rare, at)
        at = at[inside >= least - spare]
    return at[sums[np.minimum(at + n, stop[at])] - sums[at] >= n - spare]


def _pairs(column: pa.Array, items: Items) -> Iterator[tuple]:
    """(first row, words, place of each row's first word, end of each word's row, size, window starts, items)."""
    for first, data, offsets in H.blocks(column):
        h, place = H.word_hashes(data, offsets)
        if not len(h):
            continue
        spots, word = _known(h, items)
        sums = np.zeros(len(h) + 1, np.int64)
        sums[spots + 1] = 1
        sums = np.cumsum(sums)
        begin, stop = (np.repeat(x, np.diff(place)) for x in (place[:-1], place[1:]))
        windows, read = {}, np.zeros(len(h) + 1, np.int64)
        member = np.zeros(len(items.vocabulary), bool)
        for n, (least, own) in items.rare.items():
            member[own] = True
            at = _windows(spots[member[word]], sums, stop, n, least)
            member[own] = False
            if len(at):
                windows[n] = at
                np.add.at(read, at, 1)
                np.add.at(read, np.minimum(at + n, len(h)), -1)
        if not windows:
            continue
        places, owners, offsets = _seeds(h, stop, sums, np.flatnonzero(np.cumsum(read)[:-1]), items)
        for n, at in windows.items():
            seeds = np.flatnonzero(items.sizes[owners] == n)
            p, item, spare = places[seeds], owners[seeds], n // EDIT_PART
            low = np.searchsorted(at, np.maximum(p - offsets[seeds] - spare, begin[p]), "left")
            high = np.maximum(np.searchsorted(at, np.minimum(p - offsets[seeds] + spare, p), "right"), low)
            few = np.cumsum(high - low) // PAIRS
            for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(few)) + 1):
                spot, of = _spread(low[part], high[part])
                both = np.unique(at[spot] * len(items.sizes) + item[part][of])
                if len(both):
                    yield first, h, place, stop, n, *np.divmod(both, len(items.sizes))


def _hits(column: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item id, edits, first word, words) of every checked window."""
    for first, h, place, stop, n, at, item in _pairs(column, items):
        spare = n // EDIT_PART
        row = np.searchsorted(place, at, side="right") - 1
        order = np.lexsort((at, row, item))
        at, item, row = at[order], item[order], row[order]
        # neighbouring windows of a row and an item are read together
        new = np.flatnonzero((np.diff(item) != 0) | (np.diff(row) != 0) | (np.diff(at) > n + spare)) + 1
        low, high = np.append(0, new), np.append(new, len(at))
        width = at[high - 1] - at[low] + n + spare
        by_width = np.argsort(width, kind="stable")
        for some in np.split(by_width, np.flatnonzero(np.diff(np.cumsum(width[by_width]) // CELLS)) + 1):
            wide, origin, kk = int(width[some].max()), at[low[some]], item[low[some]]
            starts = np.zeros((len(some), wide), bool)
            spot, of = _spread(low[some], high[some])
            starts[of, at[spot] - origin[of]] = True
            ww = items.words[items.begin[kk][:, None] + np.arange(n)]
            edits, begins, length = least_edits(ww, _stretch(h, stop[origin], origin, wide), starts)
            for j in np.flatnonzero(edits <= spare).tolist():
                r = int(row[low[some[j]]])
                yield int(first + r), int(items.ids[kk[j]]), int(edits[j]), int(origin[j] + begins[j] - place[r]), int(length[j])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, first_word, n_words): the best match of each item in each row of docs that has it.

    Fewest edits first, then the earliest. Items of fewer than five words are found by their exact words. Items without
    words, or with a null text or id, are left out; items that repeat count each. A null or empty text matches nothing. Rows with
    one id are searched each on its own. Columns other than doc_id, item_id and text are ignored.

    The benchmark is a query set: it goes to the tasks in blocks of `ITEMS_BYTES` of text, each with one pass over docs.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, edits int, first_word long, n_words long"
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    found, block, size = None, [], 0

    def search(block: list[tuple[int, str]]) -> DataFrame:
        if (known := prepared(block)) is None:
            return docs.sparkSession.createDataFrame([], schema)
        sent = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, best = batch.column("doc_id").to_pylist(), {}
                for row, item, edits, at, n in _hits(batch.column("text"), sent.value):
                    best[row, item] = min(best.get((row, item), (edits, at, n)), (edits, at, n))
                out = list(zip(*[(ids[row], item, *hit) for (row, item), hit in best.items()], strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(out)], ["doc_id", "item_id", "edits", "first_word", "n_words"])

        return docs.mapInArrow(tidy(run), schema)

    for row in items.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size > ITEMS_BYTES:
            found = search(block) if found is None else found.unionByName(search(block))
            block, size = [], 0
    if block or found is None:
        found = search(block) if found is None else found.unionByName(search(block))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose id has no match; all columns stay. Rows with a null id stay."""
    hit = contaminated(docs, benchmark).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, docs["doc_id"] == hit["__hit"], "left_anti")
