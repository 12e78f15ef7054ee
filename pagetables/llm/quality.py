"""A quality classifier as a sparse ensemble of rules.

1. Statistics of each text: shares of kinds of bytes, lengths of words and lines, repetition.
2. Small boosted trees over the statistics of labelled rows; every path from a root is a rule, a conjunction of limits.
3. Logistic weights with an L1 penalty over the rules leave few of them.
4. The rules are compiled to Spark column expressions over the statistics, and score any number of rows.

The fit uses a bounded sample of labelled rows (`FIT_ROWS`, by a hash of text and label): its statistics alone go to
the driver. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm import hashing as H
from pagetables.llm.rows import held_out, tidy

FIT_ROWS = 20_000
THRESHOLD = 0.7
STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "mark", "rare_mark", "blank", "wide", "top_byte",
    "word_bytes", "long_words", "marked_words", "lone_marks", "upper_words", "upper_starts", "distinct_words", "top_word",
    "log_lines", "line_bytes", "line_spread", "repeated_lines", "ended_lines")


def _classes() -> np.ndarray:
    kind = np.zeros((8, 256))
    kind[0, 65:91] = 1
    kind[1, 97:123] = 1
    kind[2, 48:58] = 1
    for c in range(33, 127):
        if not chr(c).isalnum():
            kind[3, c] = 1
            if chr(c) not in ".,":
                kind[4, c] = 1
    kind[5, H.BLANK] = 1
    kind[6, 128:] = 1
    return kind


_KINDS = _classes()
_MARK = _KINDS[3].astype(bool)
_UPPER = _KINDS[0].astype(bool)
_LOWER = _KINDS[1].astype(bool)


def _of_text(data: np.ndarray) -> list[float]:
    """The statistics of one text's bytes."""
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(data, minlength=256)
    share = (_KINDS[:7] @ counts) / n
    offsets = np.array([0, n])
    starts, ends, _ = H.words(data, offsets)
    words = len(starts)
    if words:
        size = ends - starts
        running = [np.append(0, np.cumsum(k[data])) for k in (_MARK, _UPPER, _LOWER)]
        marks, upper, lower = (r[ends] - r[starts] for r in running)
        h = H.Spans(H.LOWER[data]).hash(starts, ends)
        _, each = np.unique(h, return_counts=True)
        final = _MARK[data[ends - 1]] & ~np.isin(data[ends - 1], (44, 46))
        of_words = [
            size.mean(), (size > 14).mean(), final.mean(), (marks == size).mean(), ((upper > 1) & (lower == 0)).mean(),
            _UPPER[data[starts]].mean(), len(each) / words, each.max() / words]
    else:
        of_words = [0.0] * 8
    cuts = np.concatenate([[-1], np.flatnonzero(data == 10), [n]])
    lines = np.diff(cuts) - 1
    first, last = cuts[:-1] + 1, cuts[1:]
    filled = lines > 0
    names = H.Spans(data).hash(first[filled], last[filled])
    again = 1 - len(np.unique(names)) / max(len(names), 1)
    ended = np.isin(data[last[filled] - 1], (33, 46, 63)).mean() if filled.any() else 0.0
    return [
        np.log1p(n), np.log1p(words), *share, counts.max() / n, *of_words,
        np.log1p(len(lines)), lines.mean(), lines.std() / (lines.mean() + 1), again, ended]


def statistics(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and the statistics of each row's text; a null text is empty, and all of an empty text's are 0.

    A text that is kept as well goes to the workers once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                _of_text(data[a:b]) for _, data, offsets in H.blocks(batch.column(text if text in keep else "__text"))
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            if rows:
                columns = [pa.array(c) for c in np.array(rows, np.float64).T]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *STATISTICS])

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{s} double" for s in STATISTICS)])
    return docs.select(*keep, *([] if text in keep else [F.col(text).alias("__text")])).mapInArrow(tidy(run), kinds)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, limit) each


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> F.Column:
        """The probability of label 1 as a column expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            fits = F.lit(True)
            for k, above, limit in rule:
                fits = fits & (F.col(STATISTICS[k]) > limit if above else F.col(STATISTICS[k]) <= limit)
            total = total + F.when(fits, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, limits: list[np.ndarray], depth: int, least: int) -> list[tuple[Rule, np.ndarray, float]]:
    """Greedy regression tree on Newton steps: (path, rows, value) of every node below the root."""
    out = []

    def grow(rows: np.ndarray, path: Rule) -> None:
        best = (1e-6, 0, 0.0)
        g, h = slope[rows].sum(), curve[rows].sum()
        for k, cuts in enumerate(limits):
            if not len(cuts):
                continue
            cell = np.searchsorted(cuts, x[rows, k])  # cell c: x > cuts[c - 1], x <= cuts[c]
            gl = np.cumsum(np.bincount(cell, slope[rows], len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(cell, curve[rows], len(cuts) + 1))[:-1]
            nl = np.cumsum(np.bincount(cell, minlength=len(cuts) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (gain[c], k, float(cuts[c]))
        if best[0] <= 1e-6:
            return
        _, k, limit = best
        for above in (False, True):
            inside = rows[(x[rows, k] > limit) == above]
            step = (*path, (k, above, limit))
            out.append((step, inside, float(slope[inside].sum() / (curve[inside].sum() + 1))))
            if len(step) < depth:
                grow(inside, step)

    grow(np.arange(len(x)), ())
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 2e-4) -> Ensemble:
    """Rules and weights from statistics and labels 0 and 1. With one label alone, or no rows, a constant."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Ensemble(float(np.log(share / (1 - share))), [])
    limits = [np.unique(np.quantile(c, np.linspace(0, 1, 34)[1:-1])) for c in x.T]
    limits = [cuts[cuts < c.max()] for cuts, c in zip(limits, x.T, strict=True)]
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, paths = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        nodes = _tree(x, y - p, p * (1 - p), limits, depth, max(2, len(y) // 500))
        inner = {path[:-1] for path, _, _ in nodes}
        for path, rows, value in nodes:
            paths.setdefault(tuple(sorted(path)), rows)
            if path not in inner:
                total[rows] += rate * value
    rules = list(paths)
    fits = np.zeros((len(y), len(rules)))
    for j, rule in enumerate(rules):
        fits[paths[rule], j] = 1
    mean = fits.mean(axis=0)
    spread = np.sqrt(mean * (1 - mean)) + 1e-3
    z = (fits - mean) / spread
    # accelerated proximal gradient
    w, b = np.zeros(len(rules)), base
    ahead, ahead_b, t = w, b, 1.0
    probe = np.ones(len(rules))
    for _ in range(20):  # towards the largest singular value
        probe = np.einsum("ij,i->j", z, np.einsum("ij,j->i", z, probe / np.sqrt((probe**2).sum())))
    size = 4 * len(y) / (1.1 * np.sqrt((probe**2).sum()) + len(y))
    for _ in range(600):
        slope = 1 / (1 + np.exp(-(np.einsum("ij,j->i", z, ahead) + ahead_b))) - y
        new = ahead - size * np.einsum("ij,i->j", z, slope) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        new_b = ahead_b - size * slope.mean()
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / later * (new - w), new_b + (t - 1) / later * (new_b - b)
        w, b, t = new, new_b, later
    weights = w / spread
    return Ensemble(float(b - (weights * mean).sum()), [(r, float(v)) for r, v in zip(rules, weights, strict=True) if abs(v) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ensemble:
    """Fits on labelled rows of docs outside the held-out part.

    Labels other than 0 and 1 are left out; an id with two labels takes its rows with each. If more than `fit_rows`
    labels remain, those of the smallest hashes are taken, so that the side that is broadcast is bounded.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("__label"))
    known = known.where(~held_out("__id", 4)).distinct().orderBy(F.xxhash64("__id", "__label", F.lit("fit")), "__id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    fitted = statistics(rows.select("text", "__label"), "__label").limit(2 * fit_rows).toArrow()
    table = np.array([c.to_numpy() for c in fitted.columns], float).reshape(1 + len(STATISTICS), -1)
    return fit(table[1:].T, table[0])


def scores(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs; a null text counts as empty. Other columns are ignored."""
    found = statistics(docs.select("doc_id", "text"), "doc_id").withColumn("score", model.column())
    return found.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Ensemble) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns and nothing else."""
    names = [f"__{k}" for k in range(len(docs.columns))]
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    found = statistics(plain, *names, text=names[docs.columns.index("text")]).where(model.column() >= THRESHOLD)
    return found.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
