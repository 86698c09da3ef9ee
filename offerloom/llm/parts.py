"""Ids of texts by lookup: distinct parts between single spaces are encoded once, then gathered with numpy."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that a Python worker remembers; a table above that is emptied.
CACHED = 500_000

Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches ``starts .. starts + lengths - 1`` of the pool, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(ends[-1])
    return pool[at]


class Parts:
    """Encodes texts with an exact encoder of whole texts, calling it for parts not seen before.

    A splitting pattern of byte-level vocabularies starts a word at every single space, and keeps every
    single newline apart, where no other white space stands beside it. So texts are cut there, each
    distinct part is encoded once, and ids are gathered by position. New parts are encoded together as
    one text, whose ids are cut before each one that ``opens``, that is, begins with a space or newline.
    Texts with other white space beside a cut, and those that hold a ``special`` string, are encoded whole.
    """

    def __init__(self, encode: Encode, opens: np.ndarray, special: Sequence[str] = ()):
        self.encode_whole, self.opens = encode, opens
        blank = "[\\t\\r\\pZ\\x0b\\x0c\\x1c-\\x1f\\x{85}]"
        self._odd = "|".join(["^\n?$", f"^\n?{blank}", f"{blank}$", *map(re.escape, special)])
        self._clear()

    def _clear(self) -> None:
        self.heads: dict[str, int] = {}  # parts at the start of a text
        self.inner: dict[str, int] = {}  # parts after a space, or with their newline
        self.pool = np.empty(1 << 16, np.uint32)
        self.starts, self.lengths, self.odd = (np.zeros(1 << 14, kind) for kind in (np.int64, np.int64, bool))
        self.used = self.numbered = 0

    def _learn(self, known: dict[str, int], parts: list[str]) -> None:
        odd = pc.match_substring_regex(pa.array(parts, pa.large_string()), self._odd).to_numpy(zero_copy_only=False)
        plain, counts = [p for p, o in zip(parts, odd.tolist()) if not o], np.zeros(len(parts), np.int64)
        if known is self.heads:
            flat, counts[~odd] = self.encode_whole(plain)
        elif plain:
            flat, _ = self.encode_whole(["".join([p if p[0] == "\n" else " " + p for p in plain])])
            counts[~odd] = np.diff(np.r_[np.flatnonzero(self.opens[flat]), len(flat)])
        else:
            flat = self.pool[:0]
        n, first = len(parts), self.numbered
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while first + n > len(self.starts):
            self.starts, self.lengths, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.odd))
        self.pool[self.used:self.used + len(flat)] = flat
        self.starts[first:first + n] = self.used + np.cumsum(counts) - counts
        self.lengths[first:first + n], self.odd[first:first + n] = counts, odd
        known.update(zip(parts, range(first, first + n)))
        self.used, self.numbered = self.used + len(flat), first + n

    def _numbers(self, known: dict[str, int], parts: list[str]) -> np.ndarray:
        new = [p for p in dict.fromkeys(parts) if p not in known]
        for at in range(0, len(new), 50_000):
            self._learn(known, new[at:at + 50_000])
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if self.numbered > CACHED:
            self._clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        values = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        coded = values.dictionary_encode()
        first = np.zeros(len(values), bool)
        first[offsets[:-1]] = True
        which = coded.indices.to_numpy()
        inner = np.unique(which[~first])
        numbers = np.zeros(len(coded.dictionary), np.int64)
        numbers[inner] = self._numbers(self.inner, coded.dictionary.take(pa.array(inner)).to_pylist())
        found = numbers[which]
        found[offsets[:-1]] = self._numbers(self.heads, values.take(pa.array(offsets[:-1])).to_pylist())
        lengths = self.lengths[found]
        counts = np.add.reduceat(lengths, offsets[:-1]) if len(offsets) > 1 else np.empty(0, np.int64)
        odd = np.flatnonzero(np.logical_or.reduceat(self.odd[found], offsets[:-1])) if len(offsets) > 1 else []
        if not len(odd):
            return gather(self.pool, self.starts[found], lengths), counts
        lengths[np.repeat(np.isin(np.arange(len(counts)), odd), np.diff(offsets))] = 0
        flat = gather(self.pool, self.starts[found], lengths)
        whole, some = self.encode_whole(texts.take(pa.array(odd)).to_pylist())
        counts[odd] = 0
        starts = np.cumsum(counts) - counts
        starts[odd] = len(flat) + np.cumsum(some) - some
        counts[odd] = some
        return gather(np.concatenate([flat, whole.astype(np.uint32)]), starts, counts), counts
