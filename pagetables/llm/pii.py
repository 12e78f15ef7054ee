"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, address schemes, and cues that an identifier
follows. From each anchor a small parser walks outward and checks what it finds:

- "@" widens to the local part on its left and the domain labels on its right (email);
- a scheme such as "https://" widens to a web address with a host (url);
- a cue such as "iban" or "account no" is followed by an account identifier with digits (account); an IBAN also has to
  pass its check digits.

Addresses of hosts, cards and phone numbers are runs of digits without an anchor other than a digit; they are found by
their patterns in texts that have digits. Offsets are code points, ends exclusive. Each kind's spans do not overlap.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.rows import tidy

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
# fixed values: anchors
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
CUES = ("iban", "account no", "account number", "account:", "acct", "passport no", "passport number", "ssn", "social security number", "customer id", "konto", "compte n")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
_AFTER_CUE = re.compile(r"(?:\s*(?:no|number|nr|id)\b)?\.?\s*[:#=]?\s*((?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)|[A-Z]{0,3}[0-9][0-9 -]{4,}[0-9])(?![A-Za-z0-9])")


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    for kind, words in (("url", SCHEMES), ("account", CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize(), word.title()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _account(value: str) -> bool:
    plain = re.sub(r"[ -]", "", value)
    return iban(value) if re.match(r"[A-Z]{2}[0-9]{2}", plain) and len(plain) >= 15 else 6 <= len(plain) <= 20


def _anchored(text: str) -> Iterator[tuple[str, int, int]]:
    done = {"email": 0, "url": 0, "account": 0}
    for last, (kind, size) in _automaton().iter(text):
        if kind == "email":
            start = last
            while start > done[kind] and text[start - 1] in _LOCAL:
                start -= 1
            span = _LABEL.match(text, last + 1)
            if start == last or not span:
                continue
            end = span.end()
        elif kind == "url":
            start = last + 1 - size
            span = _HOST.match(text, last + 1)
            if not span or start < done[kind] or (start and text[start - 1].isalpha()):
                continue
            end = span.end()
            while text[end - 1] in ".,;:!?)":
                end -= 1
        else:
            begin = last + 1 - size
            span = _AFTER_CUE.match(text, last + 1)
            if not span or span.start(1) < done[kind] or (begin and text[begin - 1].isalnum()) or not _account(span[1]):
                continue
            start, end = span.span(1)
        done[kind] = end
        yield kind, start, end


_DIGIT = re.compile("[0-9]")


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text, by start and then by kind."""
    found = list(_anchored(text))
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value) of all personal data in each row's text.

    A row without any, with a null or an empty text gives no row. Rows with one id give the spans of each. Columns
    other than doc_id and text are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"doc_id": d, "kind": k, "start": a, "end": b, "value": t[a:b]}
                for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for k, a, b in spans(t)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, kind string, start long, end long, value string")


def span_digests(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts of the base kinds, base_sha256 over their spans, and all spans joined.

    A null text is empty, and an empty text has no spans.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = spans(text) if text else []
                base = [s for s in found if s[0] in BASE]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            columns = [pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
