"""SentencePiece encoding and decoding; giant texts by a max-plus scan over chunks."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import pick, rest, sliced
from offerloom.session import cut_lineage

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Texts with more code points are cut into chunks of so many; so many chunk matrices are combined at once.
CHUNK, FAN = 32_768, 64
SPACE = "▁"
CACHED, LONGEST_CACHED = 250_000, 64
_NONE = float("-inf")
#: Stands for the beginning of a text where the piece before is asked for.
START = 1 << 19


class PieceModel:
    """Segmentation of normalised text as a path of pieces, every adjacent pair of which is compatible.

    Merging by score (ties leftmost) turns a text into pieces p1 .. pn exactly if merging each
    p(i) p(i+1) alone gives these two back. So the encoding is the one path through the lattice
    of pieces whose pair weights are 0 (compatible) and none is minus infinity: a max-plus problem
    whose state between two positions is the piece that ends or reaches there.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.scores = {self.names[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(self.names[i][1:-1], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids))
        #: No piece holds a space behind another character: then no piece crosses the start of a word.
        self.words = None if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        #: Pieces as a tree: character to (what may follow, id of the piece that ends here or None).
        self.tree: dict = {}
        for piece in sorted(self.ids):  # a piece comes behind its beginnings
            node = self.tree
            for at, char in enumerate(piece, 1):
                if char not in node:
                    node[char] = ({}, self.ids.get(piece[:at]))
                node = node[char][0]
        #: The two characters that stand side by side in a piece.
        self.beside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.empty_prefix = sp.normalize("a") == f"{SPACE}a"
        #: White space stays as it is and a space is put in front: then words can be normalised one by one.
        self.by_word = self.words is not None and sp.normalize("a\t b\n\r c  ") == f"{SPACE}a\t{SPACE}b\n\r{SPACE}c{SPACE}{SPACE}"
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the word caches: an idle Python worker must not hold them while other stages run."""
        for cache in (self.known, self.cache, self.parts):
            cache.clear()
        rest()

    def normalize(self, text: str) -> str:
        return self.processor.normalize(text)

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best adjacent pair again and again."""
        get, parts = self.scores.get, list(text)
        scores = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == _NONE:
                break
            at = scores.index(best)  # the leftmost of equals
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], _NONE)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], _NONE)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces may follow each other; ``START`` as the left one asks for the right one alone.

        Below zero stands a character without a piece, which never merges with anything.
        """
        if left < 0 or right < 0:
            return True
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHED:
                self.pairs.clear()
            names = [self.names[right]] if left == START else [self.names[left], self.names[right]]
            known = self.pairs[key] = self.merge("".join(names)) == names
        return known

    def piece(self, text: str, start: int, end: int) -> int | None:
        """Id of a piece, below zero for a lone character without one, None if it is neither."""
        return self.ids.get(text[start:end], -ord(text[start]) - 1 if end == start + 1 else None)

    def prefixes(self, text: str, before: int) -> tuple[list[int | None], list[int]]:
        """Of the path to every position: its last piece, and where that begins. ``before`` precedes the
        text. The path to a position is unique, so the first compatible piece found is the one."""
        tree, pairs, size = self.tree, self.pairs, len(text)
        last: list[int | None] = [before] + [None] * size
        came = [0] * (size + 1)
        for i in range(size):
            left = last[i]
            if left is None:
                continue
            node, e, head = tree, i, left << 20
            while e < size:
                found = node.get(text[e])
                e += 1
                if found is None:
                    if e == i + 1 and last[e] is None:
                        last[e], came[e] = -ord(text[i]) - 1, i
                    break
                node, piece = found
                if last[e] is None:
                    if piece is None:
                        if e > i + 1:
                            continue
                        piece = -ord(text[i]) - 1
                    fits = pairs.get(head | piece) if left >= 0 and piece >= 0 else True
                    if self.compatible(left, piece) if fits is None else fits:
                        last[e], came[e] = piece, i
        return last, came

    def between(self, text: str, before: int = START) -> list[int]:
        """Pieces of the whole text behind ``before``."""
        last, came = self.prefixes(text, before)
        out, end = [], len(text)
        while end > 0:
            out.append(last[end])
            end = came[end]
        return out[::-1]

    def packed(self, pieces: list[int]) -> bytes:
        """Little-endian 32-bit ids; a character without a piece becomes its bytes, or the unknown id."""
        if pieces and min(pieces) < 0:
            pieces = [i for p in pieces for i in ((p,) if p >= 0 else [self.bytes[b] for b in chr(-p - 1).encode()] if self.bytes else (self.unknown,))]
        return struct.pack(f"<{len(pieces)}i", *pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of whole texts.

        Where words stand one space apart, a text is cut at its spaces and each distinct word of the
        batch is looked up once; other texts are normalised as a whole.
        """
        out, cut = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if not self.by_word or SPACE in text or "  " in text or text[:1] == " " or text[-1:] == " ":
                out[i] = self.encode_normal(self.normalize(text))
            elif text:
                cut.append((i, text.split(" ")))
        known = self.known
        if len(known) > CACHED:
            known.clear()
        new = set().union(*(words for _, words in cut)).difference(known)
        for word in new:
            known[word] = self._unit(self.normalize(word))
        get = known.__getitem__
        for i, words in cut:
            out[i] = b"".join(map(get, words))
        for word in new:
            if len(word) > LONGEST_CACHED:
                del known[word]
        return out

    def encode_normal(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a normalised text that begins and ends at word boundaries."""
        if self.words is None:
            return self.packed(self.between(text))
        units = self.words.findall(text)
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        new = set(units).difference(cache)
        for unit in new:
            cache[unit] = self._unit(unit)
        out = b"".join(map(cache.__getitem__, units))
        for unit in new:
            if len(unit) > LONGEST_CACHED:
                del cache[unit]
        return out

    def _unit(self, unit: str) -> bytes:
        """Ids of a word. Characters that stand side by side in no piece part it: every path has a state between them."""
        beside, parts, out, start = self.beside, self.parts, [], 0
        if len(parts) > CACHED:
            parts.clear()
        for end in [i for i in range(1, len(unit)) if unit[i - 1:i + 1] not in beside] + [len(unit)]:
            part = unit[start:end]
            ids = parts.get(part)
            if ids is None:
                ids = self.packed(self.between(part))
                if len(part) <= LONGEST_CACHED:
                    parts[part] = ids
            out.append(ids)
            start = end
        return b"".join(out)

    # chunks: a text with the body text[lo:hi] and context on both sides

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """All (start, end) a piece over or up to position ``at`` may have; the beginning of a text has one, (0, 0)."""
        if at == 0:
            return [(0, 0)]
        return [(s, e) for s in range(max(0, at - self.longest), at) for e in range(at, min(len(text), s + self.longest) + 1)
                if e == s + 1 or text[s:e] in self.ids]

    def _cuts(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last start of a word inside (lo, hi), where every path has the same state."""
        if self.words is None:
            return None
        starts = [m.start() + lo + 1 for m in re.finditer(f"(?<!{SPACE}){SPACE}", text[lo + 1:hi]) if text[m.start() + lo] != SPACE]
        return (starts[0], starts[-1]) if starts else None

    def _reach(self, text: str, froms: list[tuple[int, int]], hi: int) -> dict[tuple[int, int], int]:
        """Of every piece that ends at or beyond ``hi``: a bit per start state that has a path to it."""
        ends: dict[int, dict[int, int]] = {}
        out: dict[tuple[int, int], int] = {}
        for bit, (s, e) in enumerate(froms):
            if e >= hi:
                out[(s, e)] = out.get((s, e), 0) | 1 << bit
            row = ends.setdefault(e, {})
            piece = START if s == e else self.piece(text, s, e)
            row[piece] = row.get(piece, 0) | 1 << bit
        for i in range(min(ends), hi):
            lefts = ends.pop(i, None)
            if not lefts:
                continue
            node = self.tree
            for e in range(i + 1, len(text) + 1):
                node, piece = node.get(text[e - 1], (None, None))
                if piece is None and e == i + 1:
                    piece = -ord(text[i]) - 1
                if piece is not None:
                    mask = 0
                    for left, bits in lefts.items():
                        if self.compatible(left, piece):
                            mask |= bits
                    if mask:
                        if e >= hi:
                            out[(i, e)] = out.get((i, e), 0) | mask
                        else:
                            row = ends.setdefault(e, {})
                            row[piece] = row.get(piece, 0) | mask
                if node is None:
                    break
        return out

    def transfer(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Max-plus matrix of a chunk: 0 where a path leads from a state at lo to one at hi."""
        froms, tos = self.states(text, lo), self.states(text, hi)
        cut = self._cuts(text, max(lo, max(e for _, e in froms)), hi)
        matrix = np.full((len(froms), len(tos)), _NONE, np.float32)
        if cut:  # all paths meet at a word start: what comes before and after is independent
            head = self._reach(text[:cut[0]], froms, cut[0])
            entered = 0
            for mask in head.values():
                entered |= mask
            tail = self._reach(text, [(cut[1], cut[1])], hi)
            for j, to in enumerate(tos):
                if to in tail:
                    matrix[[i for i in range(len(froms)) if entered >> i & 1], j] = 0
            return matrix
        reach = self._reach(text, froms, hi)
        for j, to in enumerate(tos):
            mask = reach.get(to, 0)
            for i in range(len(froms)):
                if mask >> i & 1:
                    matrix[i, j] = 0
        return matrix

    def backtrace(self, text: str, lo: int, hi: int, a: int, b: int) -> bytes:
        """Ids of the pieces that start in the chunk, on the path from state a at lo to state b at hi."""
        (s0, e0), (s1, e1) = self.states(text, lo)[a], self.states(text, hi)[b]
        if s1 < lo:  # one piece spans the whole chunk
            return b""
        before, piece = START if s0 == e0 else self.piece(text, s0, e0), self.piece(text, s1, e1)
        cut = self._cuts(text, max(lo, e0), s1 + 1)
        if cut is None:
            return self.packed([*self.between(text[e0:s1], before), piece])
        head, tail = self.between(text[e0:cut[0]], before), self.between(text[cut[1]:s1])
        return self.packed(head) + self.encode_normal(text[cut[0]:cut[1]]) + self.packed([*tail, piece])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: byte pieces in a row are read as UTF-8, spaces return, the prefix space goes."""
        if not len(ids):
            return ""
        if not hasattr(self, "_values"):
            self._values = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in self.names]
            for value, i in self.bytes.items():
                self._values[i] = bytes([value])
            for i in range(len(self.names)):
                if self.processor.is_control(i):
                    self._values[i] = b""
            self._values[self.unknown] = " ⁇ ".encode()
        raw = b"".join(map(self._values.__getitem__, ids.tolist()))
        return (raw[1:] if self.empty_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def combine(matrices: list[np.ndarray]) -> np.ndarray:
    """Max-plus product of transfer matrices, which is associative."""
    out = matrices[0]
    for m in matrices[1:]:
        out = np.max(out[:, :, None] + m[None, :, :], axis=1)
    return out


def path_states(matrices: list[np.ndarray], a: int, b: int) -> list[tuple[int, int]]:
    """(in, out) state of each matrix on the best path from state a to state b; the first of equals."""
    forward = [np.where(np.arange(matrices[0].shape[0]) == a, 0, _NONE)]
    for m in matrices:
        forward.append(np.max(forward[-1][:, None] + m, axis=0))
    backward = [np.where(np.arange(matrices[-1].shape[1]) == b, 0, _NONE)]
    for m in reversed(matrices):
        backward.append(np.max(m + backward[-1][None, :], axis=1))
    at = [int(np.argmax(f + g)) for f, g in zip(forward, reversed(backward))]
    return list(zip(at[:-1], at[1:]))


_MATRIX = "uid string, at long, ins int, outs int, matrix binary"


def _matrices(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(m, np.float32).reshape(i, o) for m, i, o in zip(frame["matrix"], frame["ins"], frame["outs"])]


def _scan(matrices: DataFrame, most_chunks: int, fan: int) -> DataFrame:
    """``uid, at, a, b``: the states in which the path of a text enters and leaves every chunk.

    Up: ``fan`` neighbouring matrices at a time become one, until a text has one. Down: the
    states of a combined matrix fix those between its parts. A group never has more than ``fan``
    matrices, however long the text.
    """
    levels = [matrices]
    while most_chunks > 1:
        def product(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("at")
            m = combine(_matrices(frame))
            return pd.DataFrame({"uid": frame["uid"].iloc[:1], "at": frame["at"].iloc[:1] // fan, "ins": m.shape[0], "outs": m.shape[1], "matrix": [m.tobytes()]})

        levels.append(cut_lineage(levels[-1].groupBy("uid", F.floor(F.col("at") / fan)).applyInPandas(product, _MATRIX)))
        most_chunks = -(-most_chunks // fan)

    def ends(batches):
        for frame in batches:
            m = _matrices(frame)
            yield pd.DataFrame({"uid": frame["uid"], "at": frame["at"], "a": 0, "b": [int(x[0].argmax()) for x in m]})

    states = levels[-1].mapInPandas(ends, "uid string, at long, a int, b int")
    for level in reversed(levels[:-1]):
        def between(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("at")
            found = path_states(_matrices(frame), int(frame["a"].iloc[0]), int(frame["b"].iloc[0]))
            return pd.DataFrame({"uid": frame["uid"], "at": frame["at"], "a": [x for x, _ in found], "b": [y for _, y in found]})

        above = states.select(F.col("uid").alias("of"), F.col("at").alias("up"), "a", "b")
        parts = level.join(above, (level.uid == above.of) & (F.floor(level.at / fan) == above.up))
        states = parts.groupBy("of", "up").applyInPandas(between, "uid string, at long, a int, b int")
    return states


def encode_pieces(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK, fan: int = FAN, with_text: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row: the ids that the model's own merging gives, as array<int>.

    Texts of up to ``chunk`` code points are encoded in one go, word by word (no piece crosses the
    start of a word), each distinct word once per worker. Longer ones are cut into chunks at fixed
    places, inside words too. Every chunk yields the max-plus transfer matrix from the states at its
    left edge (the pieces that may reach over it) to those at its right edge; the matrices are
    combined associatively in groups of ``fan``; the states on the best path then go back to the
    chunks, which are backtraced independently and joined in order.

    ``with_text`` adds ``text``, decoded from the ids, in the same pass over the texts of ordinary size.

    A null or empty text has no ids. Repeated rows give repeated rows and null ids stay null; an empty
    table gives no rows. Characters without a piece become bytes.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches):
        coder = model(path)
        for part in sliced(batches, chars="text", limit=4 << 20):
            raw = [np.frombuffer(r, "<i4") for r in coder.encode(part.column("text").to_pylist())]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(raw)))
            decoded = [pa.array([coder.decode(r) for r in raw], pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, *decoded], ["doc_id", "ids", "text"][: 2 + with_text])
        if with_text:  # the pipeline runs on; else the next task finds the words known
            coder.forget()

    result = "doc_id long, ids array<int>" + (", text string" if with_text else "")
    short = rows.where(F.char_length("text") <= chunk).mapInArrow(whole, result)
    long = rows.where(F.char_length("text") > chunk).select(
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))).alias("uid"), "doc_id", "text")

    def cut(batches):
        coder = model(path)
        for part in sliced(batches, rows=1):
            for row in part.to_pylist():
                text, near = coder.normalize(row["text"]), 2 * coder.longest
                size = max(chunk, 2 * near)
                for at, lo in enumerate(range(0, len(text), size)):
                    left, hi = max(0, lo - near), min(lo + size, len(text))
                    yield pa.RecordBatch.from_pydict({
                        "uid": [row["uid"]], "doc_id": pa.array([row["doc_id"]], pa.int64()), "at": [at], "lo": pa.array([lo - left], pa.int32()),
                        "hi": pa.array([hi - left], pa.int32()), "part": [text[left:hi + near]]})

    chunks = long.mapInArrow(cut, "uid string, doc_id long, at long, lo int, hi int, part string").repartition("uid", "at")

    def transfers(batches):
        coder = model(path)
        for batch in batches:
            for row in batch.to_pylist():
                m = coder.transfer(row["part"], row["lo"], row["hi"])
                yield pa.RecordBatch.from_pydict({
                    "uid": [row["uid"]], "at": [row["at"]], "ins": pa.array([m.shape[0]], pa.int32()), "outs": pa.array([m.shape[1]], pa.int32()),
                    "matrix": [m.tobytes()]})

    matrices = cut_lineage(chunks.mapInArrow(transfers, _MATRIX).dropDuplicates(["uid", "at"]))
    most_chunks = (matrices.agg(F.max("at")).first()[0] or 0) + 1
    states = _scan(matrices, most_chunks, fan).select(F.col("uid").alias("of"), F.col("at").alias("n"), "a", "b")

    def back(batches):
        coder = model(path)
        for batch in batches:
            for row in batch.to_pylist():
                raw = coder.backtrace(row["part"], row["lo"], row["hi"], row["a"], row["b"])
                yield pa.RecordBatch.from_pydict({
                    "uid": [row["uid"]], "doc_id": pa.array([row["doc_id"]], pa.int64()), "at": [row["at"]], "ids": [np.frombuffer(raw, "<i4")]})
        coder.forget()

    traced = chunks.join(states, (chunks.uid == states.of) & (chunks.at == states.n)).select("uid", "doc_id", "at", "lo", "hi", "part", "a", "b")
    traced = traced.mapInArrow(back, "uid string, doc_id long, at long, ids array<int>")
    single = traced.groupBy("uid", "at").agg(F.first("doc_id").alias("doc_id"), F.first("ids").alias("ids"), F.count("*").alias("copies"))
    joined = single.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"), F.max("copies").alias("copies"))
    giant = joined.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    giant = giant.select("doc_id", "ids")
    return short.unionByName(decode_pieces(giant, path) if with_text else giant)


def decode_pieces(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, ids, text`` of every row of ``doc_id, ids``; null ids are an empty text."""

    def run(batches):
        coder = model(path)
        for part in sliced(batches, rows=256):
            texts = [coder.decode(np.asarray(x.values)) if x.is_valid else "" for x in part.column("ids")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
