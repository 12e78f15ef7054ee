"""Interpolated modified Kneser-Ney bigram model.

Spark counts words, then pairs of a word and the word before it; tasks write the counts as sorted hash arrays to the
shared folder, and the tasks that score map them into memory. Nothing of the model passes through the driver but file
names, totals and the counts of counts.

- Vocabulary shards by the high bits of a word's hash: the hashes in order, counts c, numbers of different words before
  it (a). A word's number is its place over all shards.
- Pair shards by the first word: sorted pair hashes, counts (one byte, larger ones apart), and for each first word its
  total and how many pairs it has of counts 1, 2 and more. Pairs of the few words that make up more than a two-hundredth
  of the text are dealt by both words, and the sums of such a word are added up from all shards.

    p(w | u) = max(c(u w) - D(c(u w)), 0) / c(u) + back(u) p(w)
    p(w) = max(a(w) - D'(a(w)), 0) / sum a + back / (V + 1)

An end follows each text, and a begin that is never predicted comes before it. A higher order is left out: nearly all
runs of three words occur once, and their arrays would be larger than the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm import hashing as H
from pagetables.llm.arrays import map_arrays, write_arrays
from pagetables.llm.rows import each_batch, held_out, signed, tidy
from pagetables.session import new_folder, stored

U = np.uint64
END = H.salt("end of text")
TASK_TOKENS = 1_500_000  # a task combines this many before it hands on
BLOCK_BYTES = 1 << 19
SHARD_TOKENS = 2_000_000  # a shard is sorted whole in one task
HOT_SHARE = 200


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words with an end after each row, bounds)."""
    for row, data, offsets in H.blocks(column, BLOCK_BYTES):
        h, place = H.word_hashes(data, offsets)
        yield row, np.insert(h, place[1:], END), place + np.arange(len(place))


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _word_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, h, _ in _tokens(batch.column(0)):
                held.append(np.unique(h, return_counts=True))
                if sum(len(k) for k, _ in held) > TASK_TOKENS:
                    held = [_totals(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > TASK_TOKENS // 2:
                        yield pa.RecordBatch.from_arrays([signed(held[0][0]), pa.array(held[0][1])], ["h", "c"])
                        held = []
        if held:
            keys, counts = _totals(*map(np.concatenate, zip(*held, strict=True)))
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([signed(keys[k : k + 100_000]), pa.array(counts[k : k + 100_000])], ["h", "c"])

    return docs.select("text").mapInArrow(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    bits: int
    files: list[str | None]
    offsets: np.ndarray
    counts: list[str | None] = field(default_factory=list)  # files of a, in the same order

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, c, a) of sorted hashes."""
        number, c, a = np.full(len(h), -1), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        cuts = np.searchsorted((h >> U(64 - self.bits)).astype(np.int64), np.arange((1 << self.bits) + 1))
        for k, file in enumerate(self.files):
            part = h[cuts[k] : cuts[k + 1]]
            if file is None or not len(part):
                continue
            arrays = map_arrays(file)
            spot = np.minimum(np.searchsorted(arrays["h"], part), len(arrays["h"]) - 1)
            hit = np.flatnonzero(arrays["h"][spot] == part)
            to = cuts[k] + hit
            number[to], c[to] = self.offsets[k] + spot[hit], arrays["c"][spot[hit]]
            if self.counts:
                a[to] = map_arrays(self.counts[k])["a"][spot[hit]]
        return number, c, a

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes' numbers, and the place of each h among them."""
        distinct, back = np.unique(h, return_inverse=True)
        return self.find(distinct)[0], back


def _write_vocabulary(words: DataFrame, folder: str, bits: int) -> Vocabulary:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (h, c) in _by_shard(batches, "h", "c"):
            path = write_arrays(folder, "words", {"h": h.view(np.uint64), "c": c})
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n": [len(h)]})

    shard = F.expr(f"shiftrightunsigned(h, {64 - bits})")
    dealt = words.withColumn("shard", shard).repartition(1 << bits, "shard").sortWithinPartitions("shard", "h").select("shard", "h", "c")
    found = {r["shard"]: r for r in stored(dealt.mapInArrow(tidy(run), "shard long, path string, n long"), "words").collect()}  # a row per file
    sizes = np.array([found[k]["n"] if k in found else 0 for k in range(1 << bits)])
    return Vocabulary(bits, [found[k]["path"] if k in found else None for k in range(1 << bits)], H.bounds(sizes))


def _by_shard(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each shard, from batches in order of shard."""
    now, held = None, []

    def joined() -> list[np.ndarray]:
        out = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()  # the parts are let go before the shard is worked on
        return out

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
            if held and shard[a] != now:
                yield int(now), joined()
            now = shard[a]
            held.append([batch.column(c).to_numpy(zero_copy_only=False)[a:b].copy() for c in columns])
    if held:
        yield int(now), joined()


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return H.mix(H.mix(first.astype(U) * H.salt("first")) + second.astype(U) * H.salt("second"))


def _first_shard(first: np.ndarray, shards: int) -> np.ndarray:
    return (H.mix(first.astype(U) + U(77)) % U(shards)).astype(np.int64)


def _pairs(numbers: np.ndarray, at: np.ndarray, begin: int) -> np.ndarray:
    """The word before each: `begin` at a row's first."""
    first = np.empty_like(numbers)
    first[1:] = numbers[:-1]
    first[at[:-1]] = begin
    return first


def _pair_counts(docs: DataFrame, vocabulary: Vocabulary, shards: int, hot: np.ndarray) -> DataFrame:
    """(shard, first, second, c), summed by task: a row holds the numbers of many pairs as bytes."""
    begin = vocabulary.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        number = _number_kind(begin)

        def combined() -> Iterator[pa.RecordBatch]:
            first, second = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            keys = pair_hash(first, second)
            order = np.argsort(keys)
            keys = keys[order]
            cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            c, spot = np.diff(np.append(cut, len(keys))), order[cut]
            first, second = first[spot], second[spot]
            shard = np.where(np.isin(first, hot), (keys[cut] % U(shards)).astype(np.int64), _first_shard(first, shards))
            groups = list(_groups(shard))
            packed = [pa.array([x[spots].astype(kind).tobytes() for _, spots in groups], pa.binary()) for x, kind in ((first, number), (second, number), (c, np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in groups]), *packed], ["shard", "first", "second", "c"])

        for batch in batches:
            for _, h, at in _tokens(batch.column(0)):
                found, back = vocabulary.numbers(h)
                second = found[back]
                held.append((_pairs(second, at, begin), second))
                size += len(h)
                if size > TASK_TOKENS:
                    yield from combined()
                    size = 0
        if held:
            yield from combined()

    return docs.select("text").mapInArrow(tidy(run), "shard long, first binary, second binary, c binary")


def _number_kind(most: int) -> type:
    return np.uint32 if most < 1 << 32 else np.uint64


_FOUND = "kind string, id long, n1 long, n2 long, n3 long, n4 long, path string"


def _write_pairs(pairs: DataFrame, folder: str, shards: int, hot: np.ndarray, most: int) -> DataFrame:
    """Writes the shards. Gives their files, the counts of counts, the sums of hot words, and numbers of words before."""
    def rows(kind: str, ids: np.ndarray, *n: np.ndarray, path: str | None = None) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(ids), 100_000):
            part = [x[k : k + 100_000] for x in (ids, *n)]
            part += [np.zeros(len(part[0]), np.int64)] * (5 - len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(part[0])), *(pa.array(x.astype(np.int64)) for x in part), pa.array([path] * len(part[0]), pa.string())],
                ["kind", "id", "n1", "n2", "n3", "n4", "path"])

    number = _number_kind(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, packed in _by_shard(batches, "first", "second", "c"):
            first, second, c = (np.frombuffer(b"".join(x), kind).astype(np.int64) for x, kind in zip(packed, (number, number, np.uint32), strict=True))
            packed.clear()
            order = np.lexsort((second, first))
            first, second, c = first[order], second[order], c[order]
            cut = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
            first, second, c = first[cut], second[cut], np.add.reduceat(c, cut)
            each = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            sums = [np.add.reduceat(x.astype(np.int64), each) for x in (c, c == 1, c == 2, c >= 3)]
            owner = first[each]
            is_hot = np.isin(owner, hot)
            keys = pair_hash(first, second)
            order = np.argsort(keys)
            counts = c[order]
            large = np.flatnonzero(counts >= 255)
            arrays = {"key": keys[order], "c": np.minimum(counts, 255).astype(np.uint8), "large": large, "large_c": counts[large], "first": owner[~is_hot]}
            arrays |= {f"s{k}": x[~is_hot] for k, x in enumerate(sums)}
            path = write_arrays(folder, "pairs", {k: _narrow(a) if k[0] == "s" else a for k, a in arrays.items()})
            yield from rows("file", np.array([shard]), path=path)
            yield from rows("counts", np.array([0]), *(np.array([int((c == k).sum())]) for k in (1, 2, 3, 4)))
            yield from rows("hot", owner[is_hot], *(x[is_hot] for x in sums))
            yield from rows("before", *np.unique(second, return_counts=True))

    dealt = pairs.repartition(shards, "shard").sortWithinPartitions("shard")
    return stored(dealt.mapInArrow(tidy(run), _FOUND), "pairs")


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32) if not len(a) or a.max() < 1 << 32 else a


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of things seen once to four times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0.0, *(min(max(d, 0.0), float(k + 1)) for k, d in enumerate(raw))])


@dataclass
class Model:
    vocabulary: Vocabulary
    files: dict[int, str]
    shards: int
    hot: dict[int, tuple[int, int, int, int]]
    tokens: int
    pair_discount: np.ndarray
    word_discount: np.ndarray
    before_total: int
    word_back: float

    def _pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = pair_hash(first, second)
        hot = np.fromiter(self.hot, np.int64, len(self.hot))
        shard = np.where(np.isin(first, hot), (keys % U(self.shards)).astype(np.int64), _first_shard(first, self.shards))
        out = np.zeros(len(keys), np.int64)
        for k, spots in _groups(shard):
            if k not in self.files:
                continue
            arrays = map_arrays(self.files[k])
            at = np.minimum(np.searchsorted(arrays["key"], keys[spots]), len(arrays["key"]) - 1)
            hit = arrays["key"][at] == keys[spots]
            c = np.where(hit, arrays["c"][at], 0).astype(np.int64)
            large = np.flatnonzero(c == 255)
            c[large] = arrays["large_c"][np.searchsorted(arrays["large"], at[large])]
            out[spots] = c
        return out

    def _first_sums(self, first: np.ndarray) -> np.ndarray:
        """(total, n1, n2, n3 and more) of each first word; zeros for an unknown one."""
        out = np.zeros((len(first), 4))
        for k, spots in _groups(_first_shard(first, self.shards)):
            if k not in self.files:
                continue
            arrays = map_arrays(self.files[k])
            if len(arrays["first"]):
                at = np.minimum(np.searchsorted(arrays["first"], first[spots]), len(arrays["first"]) - 1)
                hit = arrays["first"][at] == first[spots]
                for j in range(4):
                    out[spots, j] = np.where(hit, arrays[f"s{j}"][at], 0)
        for word, sums in self.hot.items():
            out[first == word] = sums
        return out

    def score(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, base, score) of each row of a block of tokens."""
        distinct, back = np.unique(h, return_inverse=True)
        number, c, a = self.vocabulary.find(distinct)
        size = self.vocabulary.size
        base = np.log10((c + 1) / (self.tokens + size + 1))
        word = np.maximum(a - self.word_discount[np.minimum(a, 3)], 0) / max(self.before_total, 1) + self.word_back / (size + 1)
        second = number[back]
        first = _pairs(second, at, size)
        keys, one, pair_back = np.unique(pair_hash(first, second), return_index=True, return_inverse=True)
        pc = self._pair_counts(first[one], second[one])
        firsts, first_back = np.unique(first[one], return_inverse=True)
        sums = self._first_sums(firsts)
        total = sums[:, 0]
        lower = np.where(total > 0, sums[:, 1:] @ self.pair_discount[1:] / np.maximum(total, 1), 1.0)
        p = np.maximum(pc - self.pair_discount[np.minimum(pc, 3)], 0) / np.maximum(total, 1)[first_back] + lower[first_back] * word[back[one]]
        by_row = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every row has its end
        return by_row((c > 0).astype(np.int64)[back]), by_row(base[back]), by_row(np.log10(p)[pair_back])


def _groups(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1])[: len(order)])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]


def train(docs: DataFrame) -> Model:
    """A model of all rows of docs; a null text is empty. No rows give a model that knows no word."""
    folder = new_folder(docs.sparkSession, "ngrams")
    words = stored(_word_counts(docs), "counts")
    size, tokens = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    vocabulary = _write_vocabulary(words, folder, max(1, (size // 4_000_000).bit_length()))
    hottest = np.array([r["h"] for r in words.where(F.col("c") * HOT_SHARE > tokens).collect()], np.int64).view(np.uint64)  # below HOT_SHARE rows
    hot = np.append(vocabulary.find(np.sort(hottest))[0], vocabulary.size)  # the begin may be as frequent
    shards = 4 + tokens // SHARD_TOKENS
    found = _write_pairs(_pair_counts(docs, vocabulary, shards, hot), folder, shards, hot, vocabulary.size)
    sums = {kind: found.where(F.col("kind") == kind).groupBy("id").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in (1, 2, 3, 4))) for kind in ("counts", "hot")}
    counts = sums["counts"].first()
    files = {r["id"]: r["path"] for r in found.where("kind = 'file'").collect()}
    before = found.where("kind = 'before'").groupBy("id").agg(F.sum("n1").alias("a"))
    offsets = vocabulary.offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (a,) in _by_shard(batches, "a"):
            path = write_arrays(folder, "before", {"a": _narrow(a)})
            yield pa.RecordBatch.from_pydict({
                "shard": [shard], "path": [path], "total": [int(a.sum())], "counts": [[int((a == k).sum()) for k in (1, 2, 3, 4)]], "more": [int((a >= 3).sum())]})

    cuts = F.array(*(F.lit(int(x)) for x in offsets[1:-1])) if len(offsets) > 2 else F.array().cast("array<int>")
    dealt = before.withColumn("shard", F.size(F.filter(cuts, lambda x: x <= F.col("id"))).cast("long"))
    dealt = dealt.repartition(len(offsets), "shard").sortWithinPartitions("shard", "id").select("shard", "a")
    written = {r["shard"]: r for r in stored(dealt.mapInArrow(tidy(run), "shard long, path string, total long, counts array<long>, more long"), "before").collect()}
    vocabulary.counts = [written[k]["path"] if k in written else None for k in range(len(vocabulary.files))]
    of_words = [sum(r["counts"][k] for r in written.values()) for k in range(4)]
    total, more = (sum(r[name] for r in written.values()) for name in ("total", "more"))
    d = discounts(of_words)
    back = float(d[1:] @ np.array([of_words[0], of_words[1], more])) / total if total else 1.0
    return Model(
        vocabulary, files, shards, {r["id"]: (r["n1"], r["n2"], r["n3"], r["n4"]) for r in sums["hot"].collect()},
        tokens, discounts([counts[f"n{k}"] for k in (1, 2, 3, 4)] if counts else [0] * 4), d, total, back)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs, logarithms to base 10.

    A null or empty text is its end alone. Perplexity is 10 ** (-score / n_tokens). Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # file names and totals

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [(np.diff(at), *sent.value.score(h, at)) for _, h, at in _tokens(batch.column("text"))]
        n, known, base, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        columns = [batch.column("doc_id"), pa.array(n), pa.array(known), pa.array(np.full(len(n), sent.value.tokens)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kinds = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each_batch(run), kinds)
    return found.select("doc_id", held_out("doc_id", 7).alias("held_out"), *[c for c in found.columns if c != "doc_id"])
