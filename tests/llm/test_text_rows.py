"""Operators on single documents, the language model and packing, against plain versions and round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagetables.llm import fingerprint, ngram_lm, packing, pii, quality, secrets, token_store, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
ODD = [(5, None), (3, ""), (9, "a  b\n c\t\t"), (1, "Größe 日本 😀 <|endoftext|> x"), (1, "same id"), (1, "same id"), (None, "no id"), (20, "word " * 30_000)]


@pytest.fixture(scope="module")
def whole():
    plain = Tokenizer.from_file(PATH)
    return lambda text: [*plain.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_give_the_ids_of_whole_texts(whole):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "é", "1", "!", "'s", " x", "\x1c", "\x85", "　", " ", "<|endoftext|>", "日", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [None]
    got = [p.tolist() for _, ids, at in tokens.Encoder(PATH).blocks(pa.array(texts)) for p in np.split(ids, at[1:-1])]
    assert got == [whole(t) for t in texts]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (3, 3), (1000, 5), (5000, 10**7)):
        ends = np.sort(rng.integers(0, top + 1, n))
        l, low, high, samples = token_store.elias_fano(ends)
        read = token_store.EliasFano(n, l, low, high, samples)
        assert read.all().tolist() == ends.tolist()
        assert [read.select(i) for i in range(0, n, 7)] == ends[::7].tolist()


def test_token_store_round_trip(spark, whole):
    manifest = token_store.write_store(spark.createDataFrame(ODD, DOCS), PATH)
    got = token_store.read_store(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 1, 3, 5, 9, 20]
    assert got[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    crc = lambda t: zlib.crc32(np.array(whole(t), "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((i, crc(t)) for i, t in ODD)
    shard = token_store.Shard(manifest.first()["path"])
    assert shard.document(0).tolist() in [whole(t) for _, t in ODD]
    assert token_store.read_store(token_store.write_store(spark.createDataFrame([], DOCS), PATH)).count() == 0


def test_packing_plans_are_whole_and_tight():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 1025, 3000), rng.integers(300, 700, 2000), np.full(7, 513), np.array([1]), rng.integers(1, 30, 500)):
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan, n = packing.pack_histogram(counts)
        filled: dict[int, list] = {}
        for length, first, last, sequence, each, offset in plan.tolist():
            for r in range(first, last):
                filled.setdefault(sequence + (r - first) // each, []).append((offset + (r - first) % each * length, length))
        assert Counter(x for v in filled.values() for _, x in v) == counts and len(filled) == n
        for v in filled.values():
            v.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(v, v[1:], strict=False)) and v[0][0] == 0 and sum(v[-1]) <= 1024
        bins: list[int] = []  # best fit, by descending length
        for x in sorted(lengths.tolist(), reverse=True):
            spots = [k for k, room in enumerate(bins) if room >= x]
            if spots:
                bins[min(spots, key=bins.__getitem__)] -= x
            else:
                bins.append(1024 - x)
        assert n <= 1.01 * len(bins) + 1


def test_packed_rows(spark, whole):
    rows = packing.pack(spark.createDataFrame(ODD, DOCS), PATH).collect()
    total = [len(whole(t)) for _, t in ODD]
    assert sum(r["length"] for r in rows) == sum(total)
    assert len(rows) == sum(-(-n // 1024) for n in total)
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 20)
    assert long[0][2] == (total[-1] - 1) % 1024 + 1 and all(x[2] == 1024 for x in long[1:])
    packed = packing.sequences(spark.createDataFrame(ODD, DOCS), PATH).collect()
    assert sum(len(r["ids"]) for r in packed) == sum(total) and all(len(r["ids"]) <= 1024 for r in packed)
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(k, *m.span()) for k, m in out]


def test_pii_base_spans_match_patterns():
    rng = random.Random(6)
    parts = ["a", "b.c", "@", "@@", ".", "1", "23", "4111111111111111", "4111 1111 1111 1111", " ", "-", "+", "(", ")", "255", "256.1.2.3", "10.0.0.1", "x@y.z", "é", "\n", "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
        got = [s for s in pii.spans(text) if s[0] in pii.BASE]
        assert sorted(got) == sorted(base_pii(text)), text


def test_pii_anchors_and_odd_rows(spark):
    text = "See https://a.example.com/x?y=1, iban DE89 3704 0044 0532 0130 00; account no: 12345678. IBAN DE00 3704 0044 0532 0130 00"
    assert [(k, text[a:b]) for k, a, b in pii.spans(text) if k in ("url", "account")] == [
        ("url", "https://a.example.com/x?y=1"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]
    assert pii.spans("9" * 200_000) == [] and pii.spans("a" * 200_000 + "@") == []
    rows = pii.span_digests(spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x@y.zz"), (4, "nothing here")], DOCS)).collect()
    assert Counter((r["doc_id"], r["n_email"], r["spans"]) for r in rows) == Counter([(1, 0, ""), (2, 0, ""), (2, 0, ""), (None, 1, "email:0:6"), (4, 0, "")])


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    out = [("assign", 0, m) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", 1, m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", 2, m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, _, m in sorted(out, key=lambda s: (s[2].start(), s[1])))


def test_random_keys_without_a_digit_are_found(spark):
    rng = random.Random(21)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(3000)]
    words = ["internationalization", "NOTWITHSTANDINGTHAT", "uncharacteristically", "AAAAAAAAAAAAAAAAAAAA"]
    rows = [(i, f"some text {k} more") for i, k in enumerate(keys)] + [(10_000 + i, f"some {rng.choice(words)} more") for i in range(1000)]
    found = {r["doc_id"] for r in secrets.find_spans(spark.createDataFrame(rows, DOCS)).collect() if r["random"]}
    letters = [i for i, k in enumerate(keys) if k.isalpha()]
    assert len(letters) > 50 and len(found & set(letters)) > 0.8 * len(letters)
    assert len([i for i in found if i >= 10_000]) <= 0.05 * len(found)


def test_secret_base_spans_match_patterns(spark):
    rng = random.Random(7)
    parts = ["password", "Token", "SECRET", "api_key", "apikey", "=", ": ", '"', "'", " ", "abc123", "x", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é😀", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(600)] + ["token=abcdefg " * 3000, "", None]
    got = {r["doc_id"]: r for r in secrets.span_digests(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, text in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(base_secrets(text or "").encode()).hexdigest(), text
    assert secrets.span_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    syllables = ["tion", "ing", "the", "er", "an", "re", "heit", "sch", "ion1", "at2"]
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40)) for _ in range(200)]
    words = ["".join(rng.choice(syllables) for _ in range(12)) for _ in range(200)]
    rows = [(i, f"see {x} here") for i, x in enumerate(keys + words)]
    found = {r["doc_id"] for r in secrets.find_spans(spark.createDataFrame(rows, DOCS)).collect() if r["random"]}
    assert len(found & set(range(200))) >= 170 and len(found & set(range(200, 400))) <= 20


def test_fingerprints(spark):
    rows = [(9, "abcdef" * 20), (7, "xyz"), (7, "xyz"), (4, None), (2, "é" * 11), (None, "abcdef" * 20)]
    got = fingerprint.edited_neighbours(spark.createDataFrame(rows, DOCS)).collect()
    ordered = [(i, t or "") for i, t in rows]
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[9] == prints[None] and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    mine = fingerprint.codes(b"some text of a certain length")
    back = fingerprint.decode(fingerprint.encode(*mine))
    assert back[0] == mine[0] and back[1].tolist() == mine[1].tolist() and fingerprint.likeness(mine, back) == 1
    assert fingerprint.edited_neighbours(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprint.edited_neighbours(spark.createDataFrame([(1, "abcd")], DOCS)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_fingerprints_tell_edits_from_others(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 500")
    got = fingerprint.edited_neighbours(docs).select("near_edited", "near_next").collect()
    assert sum(r[0] > r[1] for r in got) >= 0.97 * len(got)


def test_quality_on_held_out_labels(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.scores(docs, model).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (2, "", 2.0), (None, "x", None)], "doc_id long, text string, upper double")
    assert all(0 <= r["score"] <= 1 for r in quality.scores(odd, model).collect()) and quality.scores(odd, model).count() == 4
    assert quality.keep_good(odd, model).columns == odd.columns
    empty = quality.train(docs, labels.limit(0))
    assert empty.rules == [] and quality.scores(docs.limit(3), empty).count() == 3


def plain_model(texts):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "</s>"]
    single, pairs = Counter(), Counter()
    for t in texts:
        w = split(t)
        single.update(w)
        pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
    before = Counter(w for _, w in pairs)
    d2, d1 = (ngram_lm.discounts([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]) for x in (pairs, before))
    total, back = Counter(), Counter()
    for (u, _), c in pairs.items():
        total[u] += c
        back[u] += d2[min(c, 3)]
    kinds, tokens_, pair_kinds = len(single), sum(single.values()), len(pairs)
    rest = sum(d1[min(c, 3)] for c in before.values()) / max(pair_kinds, 1) if pairs else 1.0

    def word(w):
        return max(before[w] - d1[min(before[w], 3)], 0) / max(pair_kinds, 1) + rest / (kinds + 1)

    def score(text):
        w, out = split(text), 0.0
        for u, x in zip(["<s>", *w[:-1]], w, strict=True):
            c = pairs[u, x]
            out += math.log10(max(c - d2[min(c, 3)], 0) / total[u] + back[u] / total[u] * word(x) if total[u] else word(x))
        return len(w), sum(single[x] > 0 for x in w), sum(math.log10((single[x] + 1) / (tokens_ + kinds + 1)) for x in w), out

    return score


def test_language_model_matches_plain_counts(spark):
    rng = random.Random(9)
    words = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, range(1, 61), k=rng.randint(0, 50)))) for i in range(300)] + [(900, None), (901, " "), (None, "w1 w2")]
    docs = spark.createDataFrame(rows, DOCS)
    held = {i for i, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2}
    model = ngram_lm.train(docs.where(~ngram_lm.held_out("doc_id", 7)))
    plain = plain_model([t for i, t in rows if i not in held])
    got = {r["doc_id"]: r for r in ngram_lm.scores(docs, model).collect()}
    for i, t in rows:
        n, known, base, score = plain(t)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["held_out"]) == (n, known, i in held)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_language_model_without_training_text(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    row = ngram_lm.scores(docs, ngram_lm.train(docs.limit(0))).first()
    assert row["n_known"] == 0 and row["train_tokens"] == 0 and row["score"] == 0


def test_address_parts_of_very_many_zeros(spark):
    rows = [(1, "0" * 5000 + ".1.1.1"), (2, "1.2.3." + "0" * 9000 + "255 x"), (3, "1.2.3." + "0" * 9000 + "256")]
    got = {r["doc_id"]: r["n_ip"] for r in pii.span_digests(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 0}
