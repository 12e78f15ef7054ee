"""Line dedup, Jaccard join and decontamination against plain versions of their rules."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagetables.llm import decontaminate, jaccard_join, line_dedup, links, tokens
from pagetables.llm import hashing as H

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def top(root, x):
    while root[x] != x:
        x = root[x]
    return x


def merged(items, similar):
    root = {x: x for x in items}
    order = sorted(items)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if similar(a, b):
                x, y = sorted((top(root, a), top(root, b)))
                root[y] = x
    return {x: top(root, x) for x in items}


def word_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def near_copies(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 12, 30, 60, 150, 400]))] for _ in range(n // 8)]
    out = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, len(text) // 20])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        out.append((i, " ".join(text)))
    return out


def test_jaccard_components_match_all_pairs(spark):
    rows = near_copies(1, 240) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one TWO"), (1005, "one two three")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    sets = {i: word_set(t, 4) for i, t in rows}
    want = merged(sets, lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len({c for _, c in got.values()}) < 200


def test_jaccard_on_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    sets = {r["doc_id"]: word_set(r["text"], 4) for r in docs.collect()}
    assert got == merged(sets, lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))


def test_similar_sets_share_a_signature():
    rng, bands = np.random.default_rng(3), jaccard_join.Bands(85)
    for n in [*range(6, 130), 500, 2000]:
        for _ in range(4):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[int(n * rng.random() * 0.15) :], rng.integers(0, 2**64, int(n * 0.08), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                sig, row = jaccard_join.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
                assert len(np.intersect1d(sig[row == 0], sig[row == 1]))


def test_keep_one_keeps_columns_and_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, text, "x", 5), (2, text + " end", "y", 6), (None, text, "z", 7), (3, None, None, None), (4, "", "q", 1), (4, "", "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, sig int")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 4, 4]
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def line_set(line, k=line_dedup.SHINGLE):
    return {line[i : i + k] for i in range(max(len(line) - k + 1, 1))}


def test_lines_match_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij klmnopé") for _ in range(rng.choice([5, 30, 90, 300, 900]))).strip() or "x" for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append("".join(line))
        rows.append((i, "\n".join(lines + ["", "  "][: rng.randint(0, 2)])))
    rows += [(100, None), (101, "")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    seen = {(i, k): x for i, t in rows if t for k, x in enumerate(t.split("\n")) if x.strip(" ")}
    distinct = sorted(set(seen.values()))
    sets = [line_set(x) for x in distinct]
    group = merged(range(len(distinct)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    of = {x: group[k] for k, x in enumerate(distinct)}
    first, gone = {}, set()
    for spot, line in sorted(seen.items()):
        if first.setdefault(of[line], spot) != spot:
            gone.add(spot)
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert got[i]["text"] == want, i
        assert got[i]["n_removed"] == sum(d == i for d, _ in gone)
        assert got[i]["n_lines"] == (0 if t is None else t.count("\n") + 1)


def test_lines_of_odd_rows(spark):
    rows = [(1, "same line here\nown line", "a"), (1, "same line here\nown line", "a"), (None, "same line here", "b"), (2, "x" * 200_000 + "\nsame line here", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = sorted((r["doc_id"] or 9, r["text"][-14:], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(1, "here\nown line", 0)[:1] + ("e here\nown line"[-14:], 0)] * 2 + [(2, "x" * 14, 1), (9, "", 1)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [100, 115, 126, 128, 129, 140, 150, 160, 161, 170, 200])
def test_lines_of_neighbouring_sizes_share_a_band(size):
    rng = random.Random(size)
    hits = tries = 0
    for trial in range(60):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size + 7))
        if trial % 3 == 2:  # repeated shingles, which lengthen a line and not its set
            line += line[:50]
        other = line
        for _ in range(rng.choice([1, 2])):
            at, gap = rng.randrange(10, size), rng.choice([1, 3])
            other = other[:at] + "#" * gap + other[at:] if rng.random() < 0.5 else other[:at] + other[at + gap :]
        a, b = line_set(line), line_set(other)
        if 5 * len(a & b) >= 4 * len(a | b):
            h, first = line_dedup._shingles(*line_dedup._packed([line.encode(), other.encode()]))
            one, two = line_dedup.band_hashes(h, np.diff(first))
            tries += 1
            hits += bool(np.intersect1d(one, two).size)
    assert tries >= 20 and hits >= 0.95 * tries


@pytest.mark.parametrize("size", [5, 20, 100, 500])
def test_minima_agree_as_often_as_the_sets_do(size):
    rng = np.random.default_rng(size)
    sets, apart = 200_000 // size, max(1, size // 9)
    both = H.mix(rng.integers(0, 2**63, (sets, size + apart), dtype=np.uint64))
    one, two = (line_dedup._minima(x.ravel(), np.arange(sets + 1) * size) for x in (both[:, :size], both[:, apart:]))
    same, similar = one == two, (size - apart) / (size + apart)
    assert abs(same.mean() - similar) < 0.02
    assert same.mean(axis=1).std() < 1.1 * (similar * (1 - similar) / same.shape[1]) ** 0.5  # nearly independent
    bands = same.reshape(sets, line_dedup.BANDS, line_dedup.ROWS).all(axis=2).any(axis=1).mean()
    assert bands > 1 - (1 - similar**line_dedup.ROWS) ** line_dedup.BANDS - 0.02


def test_line_shingles_are_the_runs_of_characters():
    rng = random.Random(5)
    lines = ["".join(rng.choice("ab \u00e9\u4e2d\U0001f600") for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    lines += ["".join(rng.choice("ab") for _ in range(n)) for n in range(1, 20)]
    for part in (lines, lines[-19:], lines[:1]):  # with other characters, and without
        h, first = line_dedup._shingles(*line_dedup._packed([x.encode() for x in part]))
        plain = [line[i : i + 8] for line in part for i in range(max(len(line) - 7, 1))]
        assert first.tolist() == np.cumsum([0] + [max(len(line) - 7, 1) for line in part]).tolist()
        names = dict(zip(plain, h.tolist(), strict=True))
        assert [names[x] for x in plain] == h.tolist() and len(set(names.values())) == len(names)
    both = [line_dedup._shingles(*line_dedup._packed(x))[0] for x in ([b"abcdefgh"], [b"abcdefgh", "\u00e9".encode()])]
    assert both[0][0] == both[1][0]


def test_near_lines_around_128_shingles_go(spark):
    rng = random.Random(11)
    rows = []
    for i in range(40):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(135))
        rows += [(i, line), (100 + i, line[:60] + "#" + line[60:])]
    left = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).where("n_removed = 0").count()
    assert left == 40


def edits_plain(a, text):
    best = list(range(len(text) + 1))
    best = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(text, 1):
            row.append(min(best[j - 1] + (x != y), best[j] + 1, row[-1] + 1))
        best = row
    return min(best)


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(8)
    common = ["the", "of", "and", "a"]
    vocabulary = common * 20 + [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 20, 35, 60])))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "too short")]
    rows = []
    for i in range(160):
        text = [rng.choice(common + [f"v{k}" for k in range(400)]) for _ in range(rng.randint(0, 120))]
        if i % 2:
            item = items[rng.randrange(40)][1].split()
            for _ in range(rng.randint(0, len(item) // 6)):
                kind, at = rng.randrange(3), rng.randrange(len(item))
                item[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice(vocabulary)]
            at = rng.randint(0, len(text))
            text[at:at] = item
        rows.append((i, " ".join(text).upper() if i % 3 == 0 else " ".join(text)))
    rows += [(500, None), (501, "")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found}
    want = {}
    for d, t in rows:
        for k, item in items[:40]:
            a = item.split()
            if t and (e := edits_plain(a, t.lower().split())) <= len(a) // 5:
                want[d, k] = e
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and len(want) >= 75
    assert all(want[k] <= e for k, e in got.items())


def test_decontamination_drops_rows_only_by_match(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "k"), (2, "clean", None), (None, "one two three four five six", "n")], "doc_id long, text string, edits string")
    items = spark.createDataFrame([(7, "two three four five six"), (7, "two three four five six")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in decontaminate.drop_contaminated(docs, items).collect()) == [0, 2]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_finds_items_of_few_words_as_they_are(spark):
    items = [(1, "Alpha"), (2, "beta gamma"), (3, "one two three"), (4, "four words in all"), (5, " \t"), (6, "at the end")]
    docs = [(10, "x ALPHA y beta x gamma"), (11, "one two two three beta Gamma"), (12, "say one two three or four words in all at the"), (13, "end of it"), (14, "end"), (15, None)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == [(10, 1, 0, 1, 1), (11, 2, 0, 4, 2), (12, 3, 0, 1, 3), (12, 4, 0, 5, 4)]


@pytest.mark.parametrize("kind", ["delete", "insert", "substitute", "mixed"])
@pytest.mark.parametrize("n", [6, 15, 19, 60, 100, 200, 400])
def test_decontamination_loses_no_kind_of_edit(n, kind):
    rng = random.Random(f"{n} {kind}")
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {k: [rng.choice(vocabulary) for _ in range(n)] for k in range(8)}
    known = decontaminate.prepared([(k, " ".join(w)) for k, w in texts.items()])
    column = []
    for k, w in texts.items():
        w = list(w)
        for at in sorted(rng.sample(range(n), n // 5), reverse=True):
            do = kind if kind != "mixed" else rng.choice(["delete", "insert", "substitute"])
            w[at : at + (do != "insert")] = [] if do == "delete" else [rng.choice(vocabulary)]
        column.append(" ".join([f"v{i}" for i in range(k * 7)] + w + [f"v{i}" for i in range(30)]))
    got = {}
    for row, item, edits, first, length in decontaminate._hits(pa.array(column), known):
        got[row, item] = min(got.get((row, item), (n, 0, 0)), (edits, first, length))
    assert set(got) == {(k, k) for k in texts}
    for (row, item), (edits, first, length) in got.items():
        text = column[row].split()
        assert edits == edits_plain(texts[item], text) <= n // 5
        assert edits == edits_plain(texts[item], text[first : first + length])


@pytest.mark.parametrize("kind", ["delete", "insert", "substitute", "mixed"])
@pytest.mark.parametrize("n", [15, 30, 60, 150, 400])
def test_walk_recall(n, kind):
    """The walks alone, without the pieces, at the largest number of edits allowed."""
    rng = random.Random(f"walk {n} {kind}")
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {k: [rng.choice(vocabulary) for _ in range(n)] for k in range(40)}
    known = decontaminate.prepared([(k, " ".join(w)) for k, w in texts.items()])
    known.pieces = {}
    column = []
    for w in texts.values():
        w = list(w)
        for at in sorted(rng.sample(range(n), n // 5), reverse=True):
            do = kind if kind != "mixed" else rng.choice(["delete", "insert", "substitute"])
            w[at : at + (do != "insert")] = [] if do == "delete" else [rng.choice(vocabulary)]
        column.append(" ".join(["before"] * 9 + w + ["behind"] * 30))
    found = {(row, item) for row, item, *_ in decontaminate._hits(pa.array(column), known)}
    assert found <= {(k, k) for k in texts} and len(found) >= 0.9 * len(texts)


def test_decontamination_bears_long_items():
    """Items of all sizes lie side by side; a long one is checked once per stretch, not once per window."""
    import time

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(20000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(300)] + [(900, " ".join(rng.choices(vocabulary, k=3200)))]
    known = decontaminate.prepared(items)
    assert len(known.words) == 300 * 30 + 3200
    edited = items[-1][1].split()
    for at in range(0, 3000, 10):
        edited[at] = "other"
    start = time.perf_counter()
    hits = list(decontaminate._hits(pa.array(["x " * 50 + " ".join(edited) + " y" * 50, None, ""]), known))
    assert min(h[1:] for h in hits) == (900, 300, 50, 3200) and time.perf_counter() - start < 20


def test_char_shingles_follow_characters():
    texts = ["", "é", "abcdefgh", "aébcdéfghij", "xx" * 10]
    column = pa.array(texts)
    for _, data, offsets in H.blocks(column):
        h, first = H.char_shingles(data, offsets, 8)
        sizes = np.diff(first).tolist()
    assert sizes == [0, 1, 1, 4, 13]
    assert len(set(h.tolist())) == len({t[i : i + 8] for t in texts for i in range(max(len(t) - 7, 1 if t else 0))})


def test_line_filter_takes_time_in_proportion_to_the_lines(spark):
    """Every second line of a document repeats one before; clashing column names keep their values."""
    import time

    took = []
    for n in (1_000, 20_000, 40_000):
        lines = [f"line {k} {'x' * (k % 7)}" if k % 2 else "again" for k in range(n)]
        docs = spark.createDataFrame([(1, "\n".join(lines), 5, "a", 7)], "doc_id long, text string, __gone int, __row_key string, n_lines int")
        start = time.perf_counter()
        got = line_dedup.dedup_lines(docs).first()
        took.append(time.perf_counter() - start)
        assert got["n_lines"] == n and got["__gone"] == 5 and got["__row_key"] == "a"
        assert got["text"].count("again") == 1 and got["n_removed"] >= n // 2 - 1
    assert took[2] < 3 * took[1] + 3


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_keep_no_similar_sets_apart(percent):
    rng = np.random.default_rng(percent)
    for size in (1, 3, 30, 130, 260, 3000, 20_000):
        base = H.mix(rng.integers(0, 2**63, 2 * size, dtype=np.uint64))
        sets = [np.sort(base[a : a + size + b]) for a, b in ((0, 0), (size // 20, 0), (0, size // 9), (size // 11, size // 30), (size, 0))]
        sizes = np.array([len(x) for x in sets])
        drawn = [np.frombuffer(x, np.uint64) for x in links.sketch(np.concatenate(sets), sizes).to_pylist()]
        for side in (np.zeros(5, int), np.array([0, 1, 0, 1, 1])):
            near = [[100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) and i != j and (side.max() == 0 or side[i] != side[j])
                     for j, b in enumerate(sets)] for i, a in enumerate(sets)]
            found = links._open(sizes, drawn, side, percent)
            assert (found >= np.any(near, axis=1)).all()
            if 3 < size <= 3000:  # two bits or more for a hash, or nearly: one that shares nothing is told apart
                assert not found[4]


def test_packed_signatures_come_back(spark):
    rng = np.random.default_rng(4)
    sigs, nodes = (rng.integers(0, n, 5000).astype(np.uint64) for n in (700, 900))
    rows = spark.createDataFrame(pa.Table.from_batches([links.packed(sigs, nodes, 16)]))
    assert rows.groupBy("part").count().where("count > 1").count() == 0
    plain = spark.createDataFrame(list(zip(sigs.astype(int).tolist(), nodes.astype(int).tolist(), strict=True)), "sig long, node long")
    got, want = (sorted(map(tuple, x.collect())) for x in (links.shared_packed(rows), links.shared_buckets(plain)))
    assert got == want and len(got) > 1000
    assert links.packed(sigs[:0], nodes[:0], 16).num_rows == 0


def test_texts_that_share_a_passage_make_no_cluster(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 16)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(12)]
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] + passage for _ in range(800)]
    for i in range(0, 40, 2):  # pairs that are similar, and a group of near copies that stays one
        texts[i + 1] = ["x", *texts[i][1:]]
    texts += [[*texts[60][:k], "z", *texts[60][k:]] for k in range(3, 23)]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    shared = links.shared_packed(jaccard_join.signature_rows(docs, 4, 85)).cache()
    left = links.without_crowds(shared)
    largest = [x.groupBy("sig").count().agg({"count": "max"}).first()[0] for x in (shared, left)]
    assert largest[0] >= 24 > largest[1] >= 16
    sets = {i: word_set(t, 4) for i, t in rows}
    want = merged(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, 4, 85).collect()}
    assert got == want and len(set(want.values())) == 780


def test_distinct_pieces_without_a_stable_sort():
    values = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    keys, one, back = tokens._distinct(values)
    assert (keys == np.unique(values)).all() and (values[one] == keys).all() and (keys[back] == values).all()
    assert [len(x) for x in tokens._distinct(values[:0])] == [0, 0, 0]


@pytest.mark.parametrize("percent", [80, 85])
def test_sets_small_for_their_band_need_no_common_bucket(percent):
    rng, bands = np.random.default_rng(3), jaccard_join.Bands(percent)
    sizes = rng.integers(100, 1500, 200)
    h = np.concatenate([np.sort(rng.integers(0, 2**63, n).astype(np.uint64)) for n in sizes])
    sigs = jaccard_join.signatures(h, sizes, bands)[0]
    common = jaccard_join._salted(np.zeros(40, np.uint64), np.arange(40), 3)
    assert np.isin(sigs, common).sum() == 0
