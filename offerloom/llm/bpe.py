"""Byte-level BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import pick, rest, sliced
from offerloom.llm.parts import Parts, gather

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Words above this many bytes are merged rank by rank, so that their rounds never read them whole.
LONG = 64
_NEVER = np.iinfo(np.int64).max
#: The published splitting pattern, with Unicode's own white space, which Python's differs from by four control characters.
_SPLIT = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(
    r"\s+(?!\S)|\s+", r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"))


def printed_bytes() -> dict[str, int]:
    """Characters by which vocabularies write bytes: printable ones of Latin-1 as they are, the others from U+0100 on."""
    plain = {b for span in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(span[0], span[1] + 1)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE vocabulary of the tokenizers library, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not (plain and model["type"] == "BPE" and spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before["add_prefix_space"]):
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match literally")
        vocabulary, as_byte = model["vocab"], printed_bytes()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        spelled = [b""] * self.size
        for token, i in vocabulary.items():
            spelled[i] = bytes(as_byte[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.starts, self.spelled = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(spelled), np.uint8)
        self.of_byte = np.zeros(256, np.int64)
        for token, b in as_byte.items():
            self.of_byte[b] = vocabulary[token]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*[(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]))
        born = np.full(self.size, -1)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge stands before one that makes its parts")  # then all places of a pair could not be merged at once
        keys = left * self.size + right
        self.by_key = np.argsort(keys)  # the rank of each sorted key
        self.keys, self.left, self.right, self.made = keys[self.by_key], left, right, made
        self.parts = Parts(self.encode_texts, np.array([s[:1] in (b" ", b"\n") for s in spelled]), list(self.special))
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search over the sorted pair keys."""
        wanted = left * self.size + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.by_key[at], _NEVER)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in a row, and how many each word has."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), sizes)
        long = sizes[of] > LONG
        done = [self._rounds(symbols[~long], of[~long])] + ([self._by_rank(symbols[long], of[long])] if long.any() else [])
        of, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(of, kind="stable")
        return symbols[order], np.bincount(of, minlength=len(words))

    def _rounds(self, symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges, in every word, all places of its lowest-ranked pair, the leftmost first where they overlap."""
        done_of, done = [of[:0]], [symbols[:0]]
        rank = np.full(len(symbols), _NEVER)  # of the pair that begins at each place; the last of a word has none
        inside = np.flatnonzero(of[:-1] == of[1:])
        rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            sizes = np.diff(np.r_[starts, len(of)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            gone = lowest == _NEVER
            done_of.append(of[gone])
            done.append(symbols[gone])
            at = np.flatnonzero((rank == lowest) & ~gone)
            at = _leftmost(at, at + 1)
            symbols[at] = self.made[rank[at]]
            gone[at + 1] = True
            kept = np.flatnonzero(~gone)
            symbols, of, rank = symbols[kept], of[kept], rank[kept]
            at = np.searchsorted(kept, at)
            near = np.zeros(len(of) + 1, bool)
            near[at], near[at - 1] = True, True  # -1 is the place added at the end
            at = np.flatnonzero(near[:-1])
            rank[at] = _NEVER
            at = at[at + 1 < len(of)]
            at = at[of[at] == of[at + 1]]
            rank[at] = self.ranks(symbols[at], symbols[at + 1])
        return np.concatenate(done_of), np.concatenate(done)

    def _by_rank(self, symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One round for each rank that occurs, in ascending order: a merge makes pairs of higher ranks only.

        Places hold links to their neighbours and wait under the rank of their pair, so a round reads
        no more than the places it merges, however long the words are.
        """
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.flatnonzero(np.r_[of[1:] != of[:-1], True])
        after[ends] = n  # a place past the end, which holds no symbol
        before[np.r_[0, ends[:-1] + 1]] = n
        after, before, symbols = np.r_[after, n], np.r_[before, n], np.r_[symbols, -1]
        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        queue: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self.ranks(symbols[at], symbols[after[at]])
            at, rank = at[rank < _NEVER], rank[rank < _NEVER]
            order = np.argsort(rank, kind="stable")
            values, starts = np.unique(rank[order], return_index=True)
            for value, part in zip(values.tolist(), np.split(at[order], starts[1:])):
                if value not in waiting:
                    heapq.heappush(queue, value)
                waiting[value].append(part)

        wait(np.arange(n))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[(symbols[at] == self.left[rank]) & (symbols[after[at]] == self.right[rank])]
            at = _leftmost(at, after[at])
            gone = after[at]
            symbols[at], symbols[gone] = self.made[rank], -1
            after[at] = after[gone]
            before[after[at]] = at
            touched = np.unique(np.concatenate([at, before[at]]))
            wait(touched[touched < n])
        kept = symbols[:n] >= 0
        return of[kept], symbols[:n][kept]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts in a row, and how many each has; every distinct word is merged once."""
        number: dict[str, int] = {}
        words: list[int] = []  # of all texts; special tokens count down from -1
        sizes = []
        for text in texts:
            had = len(words)
            if self._cut is None or not any(s in text for s in self.special):
                words += [number.setdefault(w, len(number)) for w in _SPLIT.findall(text)]
            else:
                at = 0
                for found in self._cut.finditer(text):
                    words += [number.setdefault(w, len(number)) for w in _SPLIT.findall(text[at:found.start()])]
                    words.append(-1 - self.special[found.group()])
                    at = found.end()
                words += [number.setdefault(w, len(number)) for w in _SPLIT.findall(text[at:])]
            sizes.append(len(words) - had)
        flat, counts = self.merge_words([w.encode() for w in number]) if number else (np.empty(0, np.int64), np.empty(0, np.int64))
        pool = np.concatenate([flat, np.arange(self.size)])  # a special token stands for itself
        which = np.array(words, np.int64)
        special = which < 0
        starts, lengths = len(flat) - 1 - which, np.ones(len(which), np.int64)
        starts[~special] = (np.cumsum(counts) - counts)[which[~special]]
        lengths[~special] = counts[which[~special]]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(np.array(sizes, np.int64))
        return gather(pool, starts, lengths), total[ends] - total[ends - sizes]

    def spell(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, and how many each text has; ids outside the vocabulary have none."""
        known = (ids >= 0) & (ids < self.size)
        ids = np.where(known, ids, 0)
        lengths = np.where(known, self.lengths[ids], 0)
        total, ends = np.concatenate([[0], np.cumsum(lengths)]), np.cumsum(counts)
        return gather(self.spelled, self.starts[ids], lengths), total[ends] - total[ends - counts]


def _leftmost(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Places of a pair without those that begin where the one kept before ends; ``at`` is ascending."""
    if len(at) < 2:
        return at
    opens = np.r_[True, at[1:] != following[:-1]]
    number = np.arange(len(at))
    return at[(number - np.maximum.accumulate(np.where(opens, number, 0))) % 2 == 0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def _texts(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)])
    raw = data.tobytes()
    try:
        raw.decode()
        return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw)).cast(pa.string())
    except UnicodeDecodeError:  # ids that no text gives
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.string())


def encode_bpe(docs: DataFrame, path: str = VOCABULARY, with_text: bool = False) -> DataFrame:
    """``doc_id, ids`` of every document, and with ``with_text`` the ``text`` decoded from those ids.

    Ids are those of the tokenizers library without truncation, padding and template. Each distinct
    part of the texts of a worker is merged once, in rounds over one flat array of the symbols of all
    new words; words above LONG bytes are merged rank by rank. Map-only, so no group meets in a task.

    A null or empty text has no ids and decodes to an empty text. Strings of special tokens become
    their ids. Repeated rows are encoded as often as they occur; doc_id may be null; an empty table
    gives no rows. Very long texts and words cost time in proportion to their length.
    """

    def run(batches):
        coder = vocabulary(path)
        for part in sliced(batches, rows=20_000, chars="text", limit=6 << 20):
            ids, counts = coder.parts.encode(part.column("text"))
            out = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))]
            if with_text:
                out.append(_texts(*coder.spell(ids.astype(np.int64), counts)))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "text"][: len(out)])
        rest()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + (", text string" if with_text else ""))


def decode_bpe(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; special tokens are kept as their strings.

    Ids outside the vocabulary and null ids give nothing, bytes that are no UTF-8 give U+FFFD, null
    lists are empty. Map-only.
    """

    def run(batches):
        coder = vocabulary(path)
        for part in sliced(batches, rows=2_000):
            ids = part.column("ids")
            offsets = ids.offsets.to_numpy().astype(np.int64)
            flat = ids.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _texts(*coder.spell(flat, np.diff(offsets)))], ["doc_id", "text"])
        rest()

    rows = pick(encoded, "doc_id", "ids").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
