"""Words that are one edit apart, grouped under the commonest spelling.

Two different words are one inserted, deleted or replaced code point apart exactly if their common prefix and common
suffix together reach the longer length less one. That is read off dense tiles: the code points of a block of words,
padded left and right, against those of another block, for all pairs at once.

Which blocks meet: of prefix and suffix one is at least half of the longer length m, so near words share their first or
their last m // 2 code points within the class of lengths m - 1 and m. Words of one class and one such half form a
group. Small groups are packed into tiles; a group above a tile is cut into blocks, and each two blocks are one tile, so
that no group, however common its half, is gathered in one task. Pairs become rows only if they are near.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm import hashing as H
from pagetables.llm.rows import tidy
from pagetables.session import stored

LEAST_POINTS, LEAST_COUNT, RATIO = 6, 5, 5
DROP_ONE_IN = 199
TILE_ROWS, TILE_POINTS = 256, 1 << 17
FLUSH = 200_000
_CELLS = 1 << 22  # comparisons of code points in one numpy step
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _runs_of(least: int) -> re.Pattern:
    """Maximal runs of Latin letters, A-Z lower-cased before, that have at least so many code points."""
    return re.compile(f"[a-zÀ-ÿ]{{{least},}}")


def words_of(doc_id: str, text: str, runs: re.Pattern, least: int, drop: int = DROP_ONE_IN) -> Counter:
    """The words of one text with their counts; some runs, told by a checksum with the id, lose one code point."""
    start = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(runs.findall(text)).items():
        h = zlib.crc32(run.encode(), start)
        if h % drop == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, least: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least `least` code points that occur at least `least_count` times in all texts.

    A null text has none; a null id counts as the empty text. Other columns are ignored. Counts are summed in each task
    before the shuffle, so the commonest word costs as much as any other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = _runs_of(least), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=_COUNTS)
            total.clear()
            return batch

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, data, offsets in H.blocks(batch.column("text")):
                raw = data.tobytes().lower()  # of bytes, A-Z alone
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    total.update(words_of(ids[first + k], raw[a:b].decode(), runs, least))
                    if len(total) > FLUSH:
                        yield out()
        if total:
            yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = rows.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _points(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points at the left and, reversed, from the right, padded with 0; lengths."""
    ahead, back = np.zeros((len(words), width), np.uint32), np.zeros((len(words), width), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for k, w in enumerate(words):
        line = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        ahead[k, : len(w)], back[k, : len(w)] = line, line[::-1]
    if not len(words) or ahead.max() < 256:
        ahead, back = ahead.astype(np.uint8), back.astype(np.uint8)
    return ahead, back, sizes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of each row of a and each row of b, which differ somewhere or are one and the same."""
    differ = a[:, None, :] != b[None, :, :]
    at = differ.argmax(axis=2)
    return np.where(differ.any(axis=2), at, a.shape[1])


def near_pairs(words: list[str], side: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Pairs of distinct words whose longer one has `width` code points and that are one edit apart.

    Words of two sides are compared across, words of one side among themselves.
    """
    ahead, back, sizes = _points(words, width)
    full = sizes == width
    one = bool((side == side[0]).all())
    left, right = (np.arange(len(words)),) * 2 if one else (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max()))
    found = []
    step = max(1, _CELLS // max(1, len(right) * width))
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        reach = _common(ahead[rows], ahead[right]) + _common(back[rows], back[right])
        near = (reach >= width - 1) & (full[rows][:, None] | full[right][None, :])
        near &= rows[:, None] < right[None, :] if one else True
        x, y = np.nonzero(near)
        found += [(i, j) for i, j in zip(rows[x].tolist(), right[y].tolist(), strict=True) if words[i] != words[j]]
    return found


def neighbours(words: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(word, n, other, other_n): both directions of all pairs of distinct words that are one edit apart."""
    size = F.char_length("word")
    keyed = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("width"))
    half = F.floor(F.col("width") / 2).cast("int")
    keyed = keyed.withColumn("half", F.explode(F.array(
        F.xxhash64("width", F.lit("start"), F.left("word", half)), F.xxhash64("width", F.lit("end"), F.right("word", half)))))
    # a group without a word of the full width has no pair of that class
    groups = keyed.groupBy("width", "half").agg(
        F.count("*").alias("members"), F.max((F.char_length("word") == F.col("width"))).alias("full")).where("members > 1 AND full")
    rows = F.greatest(F.lit(1), F.least(F.lit(tile_rows), F.floor(F.lit(TILE_POINTS) / F.col("width")))).cast("long")
    groups = groups.withColumn("parts", F.ceil(F.col("members") / rows).cast("int"))
    small = groups.where("parts = 1").groupBy("width").agg(F.sum("members").alias("all"))
    packs = small.select("width", F.ceil(F.col("all") / rows).cast("int").alias("packs"))
    groups = groups.join(packs, "width", "left").select(
        "width", "half", "parts",
        # small groups share a tile, whose other pairs are then compared for nothing
        F.when(F.col("parts") == 1, F.pmod("half", F.col("packs"))).otherwise(F.col("half")).alias("tile"),
        (F.col("parts") > 1).alias("cut"))
    dealt = keyed.join(groups, ["width", "half"]).withColumn("own", F.pmod(F.xxhash64("word", F.lit("part")), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("width", "tile", "cut", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "word", "n")

    def compare(tile: pa.Table) -> pa.Table:
        i, j, width = (tile.column(c)[0].as_py() for c in ("i", "j", "width"))
        text, side, n = tile.column("word").to_pylist(), tile.column("own").to_numpy(), tile.column("n").to_numpy()
        pairs = near_pairs(text, side, width) if len(text) > 1 and bool((side == side[0]).all()) == (i == j) else []
        both = pairs + [(b, a) for a, b in pairs]
        a, b = [p[0] for p in both], [p[1] for p in both]
        return pa.table({
            "word": pa.array([text[k] for k in a], pa.string()), "n": pa.array(n[a].tolist() if a else [], pa.int64()),
            "other": pa.array([text[k] for k in b], pa.string()), "other_n": pa.array(n[b].tolist() if b else [], pa.int64())})

    tiles = dealt.distinct().groupBy("width", "tile", "cut", "i", "j")
    return tiles.applyInArrow(compare, "word string, n long, other string, other_n long").dropDuplicates(["word", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): the end of its chain of forms, by joining the table with itself.

    A form has at least `RATIO` times the count of its word, so chains are short and without circles; each round doubles
    the steps made.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = stored(now.join(after, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "forms")
        now = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each (word, n); the words must be distinct.

    The form of a word is its near word of largest n, the smallest by code points among equals, if that n is at least
    `ratio` times its own; else null. No words give no rows.
    """
    words = stored(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = neighbours(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    near = stored(near.select(
        "word", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "near")
    ends = roots(near.where("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
