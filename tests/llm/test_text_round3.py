"""Spelling variants, whitening and toxicity against plain versions."""

import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from pagetables.llm import queries, spelling, toxicity, whitening

DOCS = "doc_id long, text string, word string, n long"


def plain_words(docs):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def rows_of(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_vocabulary_and_variants_of_a_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    words = plain_words(docs)
    assert len(words) > 300
    got = rows_of(queries.QUERIES["op11_spelling"](spark, sf_dir))
    assert got == plain_variants(words)
    assert any(r[1] for r in got)


@pytest.mark.parametrize("tile_rows", [4, 256])
def test_variants_of_crowded_words(spark, tile_rows):
    """Groups far above a tile, chains of forms, ties, long words, repeated letters."""
    rng = np.random.default_rng(3)
    words = {"abcabc" + "".join(rng.choice(list("abc"), int(rng.integers(0, 4)))): int(rng.choice([5, 6, 30, 200, 4000])) for _ in range(150)}
    words |= {"".join(rng.choice(list("ab"), 6)): 7 for _ in range(60)}
    words |= {"x" * 6: 5, "x" * 7: 25, "x" * 8: 125, "x" * 9: 625, "x" * 700: 9, "x" * 699: 60, "élève" * 2: 5, "élève" * 2 + "s": 50, "ÿ" * 6: 8}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {(r["word"], r["other"]) for r in spelling.neighbours(table, tile_rows).collect()}
    assert near == {(a, b) for a in words for b in words if one_edit(a, b)}
    assert rows_of(spelling.variants(table)) == plain_variants(words)


def test_spelling_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "Straße " * 5 + "×÷×÷×÷ " * 5), (None, "without " * 6), (4, "Little1little2little3little-little" + " little"), (4, "LITTLE"), (5, "z" * 100_000)]
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], DOCS)
    got = {r["word"]: r["n"] for r in spelling.vocabulary(table).collect()}
    assert got == plain_words(docs) and "straße" in got and "×÷×÷×÷" in got
    empty = table.where("false")
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0


VECTORS = "vec_id long, embedding array<float>, component int"


def plain_scatter(x):
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    return n, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def test_characteristic_polynomial_is_exact(spark):
    """Faddeev and LeVerrier's recurrence in fractions gives the same integers."""
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 7):
        b = rng.integers(-900, 900, (d, d))
        b[:, 0] *= 0 if d == 3 else 1
        m = (b.T @ b).astype(object)
        c, part = [Fraction(1)], np.zeros((d, d), object)
        for k in range(1, d + 1):
            part = m.dot(part) + c[-1] * np.eye(d, dtype=int).astype(object)
            c.append(Fraction(-1, k) * sum((m.dot(part))[i, i] for i in range(d)))
        assert whitening.characteristic(spark, m) == [int(x) for x in reversed(c)]


def test_roots_with_ties_zeros_and_near_ones():
    def from_roots(roots):
        c = [1]
        for r in roots:
            c = [a - r * b for a, b in zip([0, *c], [*c, 0], strict=True)]
        return c

    one = 1 << whitening.FRACTION
    for roots in ([5], [0, 0, 7], [3, 3, 3], [10**30, 10**30 - 1, 4, 4, 1, 0], list(range(1, 30)), [0, 0]):
        got = [r for root, k in whitening.largest_roots(from_roots(roots), 99) for r in [Fraction(root, one)] * k]
        want = sorted((r for r in roots if r), reverse=True)
        assert len(got) == len(want) and all(abs(a - b) <= Fraction(2, one) for a, b in zip(got, want, strict=True))


def test_gram_is_exact_for_large_entries():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**61), 2**61, (50, 3)).astype(np.float64)
    whole = [[int(v) for v in r] for r in x]
    assert whitening.gram(x).tolist() == [[sum(r[i] * r[j] for r in whole) for j in range(3)] for i in range(3)]


def test_whitening_of_a_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]] for r in rows]
    n, s, m = plain_scatter(x)
    got = queries.QUERIES["op12_whitening"](spark, sf_dir).toPandas()
    assert len(got) == 32 * n and (got["n"] == n).all() and set(got["component"]) == set(range(1, 33))
    deviation = {r["vec_id"]: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for r, v in zip(rows, x, strict=True)}
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == deviation
    v = np.array(m, float) / n**2
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1][:32], vectors[:, ::-1][:, :32]
    z = (np.array(x, float) - np.array(s, float) / n) @ vectors / np.sqrt(e)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in rows]].to_numpy()
    sign = np.sign((wide * z).sum(axis=0))
    assert np.abs(wide * sign - z).max() < 1e-6
    assert np.allclose(got.groupby("component")["explained"].first(), e / np.trace(v), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(32)).max() < 1e-9


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0, 2.0]), (2, [0.0, 1.0, 2.0]), (2, [0.0, 1.0, 2.0]), (None, [-1.0, -1.0, 2.0])]
    bad = [(5, None), (6, []), (7, [nan, 0.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [None, 0.0, 0.0]), (10, [1.0]), (11, [3e38, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 7) for i, v in good + bad], VECTORS)
    got = whitening.whitened(table).collect()
    assert sorted(((r["vec_id"] or 0), r["component"]) for r in got) == sorted((i or 0, k) for i, _ in good for k in (1, 2))
    assert abs(sum(r["explained"] for r in got if r["vec_id"] == 1) - 1) < 1e-12 and got[0]["identity_error"] < 1e-9
    # equal eigenvalues: any vectors at right angles
    square = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [-1.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, [0.0, -1.0], 0)], VECTORS)
    got = whitening.whitened(square).collect()
    assert len(got) == 8 and got[0]["identity_error"] < 1e-9 and all(abs(r["explained"] - 0.5) < 1e-12 for r in got)
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0], 0), (2, [1.0], 0)], [(1, None, 0)]):
        assert whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect() == []


def test_grammar_tells_kinds_of_clauses():
    m = toxicity.Matcher(["lowei"])
    kind = lambda t: [toxicity.KINDS[k] for _, _, k in m.clauses(t)]
    assert kind("you are an idiot. what a moron!") == ["aimed insult", "insult"]
    assert kind("this is not an idiot") == ["denied"] and kind("not that i would ever call this an idiot") == ["insult"]
    assert kind("the man said idiot, moron") == ["reported"] and kind("idiot, the man said") == ["insult"]
    assert kind("i will kill you\nkill time") == ["aimed threat", "threat"]
    assert kind("loweichen da; idiotic overkill, klowei") == ["insult"]
    assert kind("not stupid but a clown and scum") == ["insult"] and kind("") == []


def test_composed_machine_equals_its_parts_in_a_row():
    rng = np.random.default_rng(4)
    parts = [toxicity._negation(), toxicity._speech(), toxicity._clause()]
    for _ in range(500):
        line = rng.choice(toxicity.PLAIN, int(rng.integers(0, 9))).tolist()
        state = 0
        for s in line:
            state = toxicity.GRAMMAR.step[state, s][0]
        for part in parts:
            at, out = 0, []
            for s in line:
                at, s = part.step[at, s]
                out.append(s)
            line = out
        assert toxicity.GRAMMAR.final.get(state) == parts[-1].final.get(at)


def test_toxicity_learns_starts_and_scores_held_out_rows(spark):
    rng = np.random.default_rng(8)
    say = lambda: " ".join("".join(rng.choice(list("abdefgr"), 5)) for _ in range(30))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, say() + (f" snarv{say()[:3]} " if bad else " ") + say()))
        labels.append((i, int(bad)))
    rows += [(i, rows[5][1]) for i in range(1000, 1200)]  # copies teach one text's words once
    labels += [(i, 1) for i in range(1000, 1200)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert model.stems == ["snarv"]
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)


def test_toxicity_of_a_table_and_odd_rows(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_toxicity"](spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    right = [got[i]["predicted"] == y for i, y in labels.items() if i in got]
    assert sum(right) >= 0.9 * len(right)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame(
        [(1, None, 1.0), (2, "", 1.0), (3, "you idiot " * 20_000, 1.0), (None, "fine", 1.0), (3, "fine", 1.0)], "doc_id long, text string, score double")
    model = toxicity.train(odd, none)
    marks = sorted((r["doc_id"] or 0, r["predicted"]) for r in toxicity.scores(odd, model).collect())
    assert marks == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1)]
    assert toxicity.scores(odd.where("false"), model).count() == 0


def test_quality_rules_as_columns_equal_their_plain_reading(spark):
    """The compiled expression against each rule read in Python, and the statistics against a count by hand."""
    import math

    from pagetables.llm import quality

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.2) & (x[:, 5] <= 0.5) | (x[:, 9] > 1.2)).astype(float)
    model = quality.fit(x, y)
    assert model.rules
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *quality.STATISTICS])
    got = {r["i"]: r["p"] for r in rows.select("i", model.column().alias("p")).collect()}
    for i, r in enumerate(x):
        total = model.bias + sum(w for rule, w in model.rules if all((r[k] > limit) == above for k, above, limit in rule))
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-9
    assert np.mean([(got[i] >= 0.5) == y[i] for i in range(len(y))]) > 0.95
    text = "Two words.\nTWO Words.\n\nTwo words."
    found = quality.statistics(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    one = next(r for r in found if r["log_bytes"])
    letters = text.encode()
    assert abs(one["upper"] - sum(65 <= c <= 90 for c in letters) / len(letters)) < 1e-12
    assert abs(one["log_words"] - math.log1p(len(text.split()))) < 1e-12 and abs(one["log_lines"] - math.log1p(4)) < 1e-12
    assert abs(one["repeated_lines"] - 1 / 3) < 1e-12 and one["ended_lines"] == 1.0
    assert all(not any(r) for r in found if not r["log_bytes"])
