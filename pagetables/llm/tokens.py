"""Token ids of whole texts by a given public tokenizer.

A blank followed by a character that is no white space is always a border for a byte-level pre-tokenizer, so texts are
cut there. Each distinct piece is encoded by the tokenizers library once and then found by its 64-bit hash in a sorted
array of at most `REMEMBERED` pieces; the ids are those of encoding the text whole. A text that has one of the
tokenizer's special strings is encoded whole.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pagetables.llm import hashing as H

REMEMBERED = 1_500_000
END_ID = 2
_PLAIN = np.ones(256, bool)  # bytes that surely start no white space
_PLAIN[:33] = False
_PLAIN[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, the place of one of each, and where each value is among them; a stable sort would take longer."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], order[new], back


class Encoder:
    """Ids of Arrow columns; use `encoder(path)`, which keeps one per process."""

    def __init__(self, path: str):
        # a task has one core: the library's own threads would take others' and spend more on short pieces than they save
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self._whole(texts)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.uint32, int(count.sum()))
        first = len(self.pool) + H.bounds(count)[:-1]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.first, first), (self.count, count)))
        self.pool = np.concatenate([self.pool, flat])

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        border = np.zeros(len(data) + 1, bool)
        border[: len(data) - 1] = (data[:-1] == 32) & _PLAIN[data[1:]]
        border[offsets] = True
        border[-1] = False
        starts = np.flatnonzero(border)
        ends = np.append(starts[1:], len(data))
        keys, one, back = _distinct(H.Spans(data).hash(starts, ends))
        spot = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(spot, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(self.keys) + len(new) > REMEMBERED:
            self._forget()
            new = np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
        at = np.searchsorted(self.keys, keys)[back]
        count, first = self.count[at], self.first[at]
        before = H.bounds(count)
        ids = self.pool[np.arange(before[-1]) + np.repeat(first - before[:-1], count)]
        return ids, before[np.searchsorted(starts, offsets)]

    def blocks(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds) of runs of rows; each row's ids end with END_ID, a null is an empty text."""
        for row, data, offsets in H.blocks(column):
            ids, at = self._block(data, offsets)
            parts = np.split(ids, at[1:-1])
            if any(x in (raw := data.tobytes()) for x in self.special):
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    if any(x in raw[a:b] for x in self.special):
                        parts[k] = np.array(self._whole([raw[a:b].decode("utf-8", "replace")])[0], np.uint32)
                ids = np.concatenate(parts)
                at = H.bounds(np.fromiter(map(len, parts), np.int64, len(parts)))
            yield row, np.insert(ids, at[1:], END_ID), at + np.arange(len(at))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
