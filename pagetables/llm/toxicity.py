"""Toxicity from clauses that a weighted finite-state grammar accepts.

1. A lexicon gives every word a class: insult, threat, target, negation, speech verb or other. Insults are a few fixed
   words and what labelled texts teach: word starts that toxic texts have and clean ones lack, by a binomial test over
   all word starts, taken greedily so that each explains texts that those before do not (copies of a text teach once).
2. Small transducers rewrite the classes of a clause: negation turns an insult or threat within its reach into a denied
   one, a speech verb turns those after it into reported ones, a target turns those in its clause into aimed ones. They
   are composed into one machine, whose last state says what kind of clause it is.
3. A text is scored by how many clauses of each kind it has. The weights of the kinds are those of a logistic model
   around the grammar's own weights, fitted on labelled rows.

The fit reads at most `FIT_ROWS` labelled rows; word counts and statistics of these go to the driver, texts do not.
Everything else covers all rows. Only clauses with an insult or threat are read word by word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.rows import crc_remainder, tidy

FIT_ROWS = 20_000
THRESHOLD = 0.7
LEXICON = 400  # learnt word starts at most
STEM = 4  # code points of the shortest learnt word start
DOUBT = 0.01  # expected number of word starts taken by chance

# fixed values: classes of words in the languages of the texts
INSULTS = "idiot idiots moron morons stupid scum trash loser losers clown pathetic worthless disgusting imbecile".split()
THREATS = "kill hurt destroy beat burn shoot stab umbringen töten matar tuer".split()
TARGETS = "you your yours yourself u he she they him her them du dich dir euch ihr tu te vous toi usted vosotros".split()
NEGATIONS = "not no never neither nor isn aren wasn don doesn didn nicht kein keine nie pas jamais nunca".split()
SPEECH = "said says say wrote writes called calls claimed quoted reported sagte schrieb nannte dit écrit dijo llamó".split()

OTHER, TARGET, NEGATION, SPEECH_VERB, INSULT, THREAT = range(6)
KINDS = ("aimed insult", "insult", "aimed threat", "threat", "denied", "reported")
# the grammar's own weights, of one clause and of each doubling of their number
OWN_WEIGHTS = np.array([3.5, 3.0, 3.5, 1.5, 0.5, 1.0, 0.5, 0.4, 0.5, 0.3, 0.1, 0.1])
OWN_BIAS = -2.0
REACH = 3  # words that a negation reaches

_WORD = re.compile(r"[^\W\d_]+")
_BORDER = re.compile(r"[.!?;:\n]")


# --- transducers ------------------------------------------------------------------------------------------------

@dataclass
class Transducer:
    """A letter-to-letter machine: step[state, symbol] = (next state, symbol written); start is state 0."""

    step: dict[tuple[int, str], tuple[int, str]]
    final: dict[int, str] = field(default_factory=dict)  # what the state says at the end of a clause

    def then(self, after: Transducer) -> Transducer:
        """The machine that feeds this one's output to the next one, over the state pairs that can be reached."""
        names, todo, step, final = {(0, 0): 0}, deque([(0, 0)]), {}, {}
        symbols = {s for _, s in self.step}
        while todo:
            a, b = pair = todo.popleft()
            if b in after.final:
                final[names[pair]] = after.final[b]
            for s in symbols:
                na, written = self.step[a, s]
                nb, written = after.step[b, written]
                if (na, nb) not in names:
                    names[na, nb] = len(names)
                    todo.append((na, nb))
                step[names[pair], s] = names[na, nb], written
        return Transducer(step, final)


PLAIN = ("other", "target", "negation", "speech", "insult", "threat")
HARM = ("insult", "threat")


def _negation() -> Transducer:
    """State k: words left that the last negation reaches."""
    step = {}
    for left in range(REACH + 1):
        for s in PLAIN:
            step[left, s] = (REACH, s) if s == "negation" else (max(0, left - 1), "denied" if left and s in HARM else s)
    return Transducer(step)


def _speech() -> Transducer:
    """State 1: after a speech verb."""
    step = {}
    for after in (0, 1):
        for s in (*PLAIN, "denied"):
            step[after, s] = (1, s) if s == "speech" else (after, "reported" if after and s in HARM else s)
    return Transducer(step)


def _clause() -> Transducer:
    """Remembers the gravest harm and whether there is a target; the last state names the kind of the clause."""
    ranks = ("", "denied", "reported", "threat", "insult")
    step, final = {}, {}
    for rank, harm in enumerate(ranks):
        for aimed in (0, 1):
            here = 2 * rank + aimed
            for s in (*PLAIN, "denied", "reported"):
                there = max(rank, ranks.index(s)) if s in ranks else rank
                step[here, s] = 2 * there + (1 if s == "target" else aimed), s
            if harm:
                final[here] = f"aimed {harm}" if aimed and harm in HARM else harm
    return Transducer(step, final)


GRAMMAR = _negation().then(_speech()).then(_clause())


def _tables() -> tuple[list[list[int]], list[int]]:
    """The grammar as lists: next state by state and class, kind by state (-1: none)."""
    count = 1 + max(s for s, _ in GRAMMAR.step)
    rows = [[GRAMMAR.step[s, name][0] for name in PLAIN] for s in range(count)]
    return rows, [KINDS.index(GRAMMAR.final[s]) if s in GRAMMAR.final else -1 for s in range(count)]


# --- matching ---------------------------------------------------------------------------------------------------

class Matcher:
    """Counts clauses by kind; whole words by class, and insults also by how a word starts."""

    def __init__(self, stems: list[str]):
        self.next, self.kind = _tables()
        self.classes: dict[str, int] = {}
        for words, name in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (SPEECH, SPEECH_VERB), (THREATS, THREAT), (INSULTS, INSULT)):
            self.classes |= dict.fromkeys(words, name)
        self.stems, self.sizes = set(stems), sorted({len(s) for s in stems})
        self.cues = ahocorasick.Automaton()
        for cue in {*INSULTS, *THREATS, *stems}:
            self.cues.add_word(cue, len(cue))
        self.cues.make_automaton()

    def of_word(self, word: str) -> int:
        found = self.classes.get(word, OTHER)
        if found == OTHER and any(word[:k] in self.stems for k in self.sizes):
            return INSULT
        return found

    def clauses(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the clauses that the grammar accepts, of a lower-cased text."""
        out, done = [], 0
        for last, size in self.cues.iter(text):
            at = last - size + 1
            if at < done or (at and text[at - 1].isalpha()):
                continue
            start = done
            # the clause starts after the last border before the cue
            for border in ".!?;:\n":
                start = max(start, text.rfind(border, done, at) + 1)
            found = _BORDER.search(text, at)
            end = found.start() if found else len(text)
            state = 0
            for m in _WORD.finditer(text, start, end):
                state = self.next[state][self.of_word(m[0])]
            if self.kind[state] >= 0:
                out.append((start, end, self.kind[state]))
            done = end
        return out

    def counts(self, text: str) -> list[int]:
        """How many clauses of each kind, and how many clauses in all."""
        out = [0] * len(KINDS)
        for _, _, kind in self.clauses(text.lower()):
            out[kind] += 1
        return out


def _features(counts: np.ndarray) -> np.ndarray:
    """Whether a kind occurs, and the doublings of its number."""
    return np.concatenate([counts > 0, np.log2(np.maximum(counts, 1))], axis=1)


@dataclass
class Model:
    stems: list[str]
    weights: np.ndarray
    bias: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        total = np.einsum("ij,j->i", _features(counts), self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


# --- learning ---------------------------------------------------------------------------------------------------

def _binomial_tail(k: int, n: int, p: float) -> float:
    """Log of the probability of k or more of n."""
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k, n + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def _labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, label) of labelled rows outside the held-out part; of more than fit_rows labels, those of smallest hashes."""
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("label"))
    known = known.where(crc_remainder("__id", 3) != 1).distinct().orderBy(F.xxhash64("__id", "label", F.lit("toxic")), "__id").limit(fit_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("text", "label")


def _starts(text: str) -> set[str]:
    return {w[:STEM] for w in set(_WORD.findall(text.lower())) if len(w) >= STEM}


def learn_stems(rows: DataFrame, most: int = LEXICON) -> list[str]:
    """Word starts that mark toxic texts of (text, label) rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen[label].update(_starts(text))
                seen[label][""] += 1
        keys = list({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)], ["start", "clean", "toxic"])

    counted = rows.mapInArrow(tidy(count), "start string, clean long, toxic long").groupBy("start").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = counted.persist()
    whole = counted.where("start = ''").first()
    if whole is None or not whole["clean"] or not whole["toxic"]:
        counted.unpersist()
        return []
    base, tests = whole["toxic"] / (whole["clean"] + whole["toxic"]), counted.count()
    # at least nine in ten texts with the start are toxic; the strongest of these are tested
    strong = counted.where("start <> '' AND toxic >= 2 AND toxic >= 9 * clean").orderBy(F.desc("toxic"), "start").limit(20 * most).collect()
    counted.unpersist()
    strong = [r["start"] for r in strong if _binomial_tail(r["toxic"], r["toxic"] + r["clean"], base) + math.log(tests) <= math.log(DOUBT)]
    if not strong:
        return []
    marked = set(strong)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted({w[: 8 * STEM] for w in _WORD.findall(t.lower()) if w[:STEM] in marked}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string()))], ["words"])

    texts = rows.where("label = 1").select("text").mapInArrow(tidy(found), "words array<string>").where("size(words) > 0")
    sets = [set(r["words"]) for r in texts.collect()]  # marked words of at most fit_rows texts
    return _cover(sets, most)


def _cover(texts: list[set[str]], most: int) -> list[str]:
    """Word starts taken one after another by how many texts they add; each is drawn out as far as its words agree."""
    open_texts, by_start = set(range(len(texts))), {}
    for k, words in enumerate(texts):
        for w in words:
            by_start.setdefault(w[:STEM], set()).add(k)
    out = []
    while open_texts and len(out) < most:
        start, held = max(by_start.items(), key=lambda x: (len(x[1] & open_texts), x[0]))
        new = held & open_texts
        if len(new) < 2:
            break
        open_texts -= new
        forms = [{w for w in texts[k] if w.startswith(start)} for k in held]
        size = STEM
        while True:
            longer = Counter(s for f in forms for s in {w[: size + 1] for w in f if len(w) > size})
            best = max(longer.items(), key=lambda x: (x[1], x[0]), default=("", 0))
            if best[1] < 0.95 * len(held):
                break
            start, size = best[0], size + 1
        out.append(start)
    return out


def fit_weights(counts: np.ndarray, labels: np.ndarray, pull: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton steps, pulled towards the grammar's own; with one label alone those are kept."""
    if not len(labels) or labels.min() == labels.max():
        return OWN_WEIGHTS, OWN_BIAS
    x = np.concatenate([_features(counts), np.ones((len(labels), 1))], axis=1)
    own = np.append(OWN_WEIGHTS, OWN_BIAS)
    w = own.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", x, w), -30, 30)))
        slope = np.einsum("ij,i->j", x, p - labels) + pull * (w - own)
        curve = np.einsum("ij,i,ik->jk", x, p * (1 - p), x, optimize=True) + pull * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _counts(docs: DataFrame, stems: list[str], keep: str, kind: str) -> DataFrame:
    names = [f"k{i}" for i in range(len(KINDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(stems)
        for batch in batches:
            rows = np.array([matcher.counts(t or "") for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(keep), *(pa.array(c) for c in rows.T)], [keep, *names])

    return docs.select(keep, "text").mapInArrow(tidy(run), f"{keep} {kind}, " + ", ".join(f"{n} long" for n in names))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Lexicon and weights from labelled rows of docs outside the held-out part.

    Labels other than 0 and 1 are left out; an id with two labels takes its rows with each; without labels, or with one
    kind alone, the fixed lexicon and the grammar's own weights remain.
    """
    rows = _labelled(docs, labels, fit_rows)
    stems = learn_stems(rows)
    found = _counts(rows, stems, "label", "int").limit(2 * fit_rows).toArrow()
    table = np.array([c.to_numpy() for c in found.columns], float).reshape(1 + len(KINDS), -1)
    return Model(stems, *fit_weights(table[1:].T, table[0]))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs; a null text counts as empty, repeated rows stay.

    Other columns are ignored. A text without a matched clause gets the model's bias.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.stems)
        for batch in batches:
            if batch.num_rows:
                counts = np.array([matcher.counts(t or "") for t in batch.column("text").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(counts))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")
    return found.select(
        "doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
