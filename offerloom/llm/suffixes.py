"""Removing passages that repeat across documents, by suffix arrays over sampled windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import pick

#: A repeated passage has at least this many bytes.
PASSAGE = 50
#: A window is sent to the task of its smallest gram; equal windows have equal smallest grams.
GRAM = 16
#: Text bytes of a batch, and of a piece of a long text whose windows are hashed at once.
BATCH_BYTES, PIECE = 6 << 20, 1 << 21
#: Stands for a null doc_id: larger than any other.
NO_ID = 2**63 - 1
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def _words(raw: bytes, n: int) -> np.ndarray:
    """The eight bytes from each of the first n positions of a buffer, as big-endian numbers are after a byte swap."""
    return np.ndarray((n,), np.uint64, raw, 0, (1,))


def window_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive 50-byte windows with the same smallest gram: gram hash, first window, windows.

    The hash depends on the window alone, so equal windows of any two texts fall into runs of equal
    hash. Long texts are hashed piece by piece; a run may be cut at a piece's end.
    """
    keys, starts, counts = [], [], []
    for at in range(0, len(raw) - PASSAGE + 1, PIECE):
        part = raw[at:at + PIECE + PASSAGE - 1]
        grams = len(part) - GRAM + 1
        words = _words(part + bytes(8), grams + 8)
        h = words[:grams] * _ODD[0] + words[8:8 + grams] * _ODD[1]
        h ^= h >> np.uint64(29)
        h *= _ODD[2]
        span, width = 1, PASSAGE - GRAM + 1
        while span * 2 <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if width > span:
            h = np.minimum(h[:span - width], h[width - span:])
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        keys.append(h[first] * _ODD[3])  # smallest of many hashes: spread over all numbers again
        starts.append(first + at)
        counts.append(np.diff(np.append(first, len(h))))
    if not keys:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts)


def suffix_array(text: np.ndarray, depth: int = PASSAGE) -> np.ndarray:
    """Suffixes of a byte array in order of at least their first ``depth`` bytes, in two stages.

    Stage one sorts only the suffixes that are smaller than their successors, by their bytes. Stage
    two scans the buckets of first bytes in ascending order: every suffix found, if the one before it
    in the text is larger than it, puts that one at the head of its own bucket. A bucket is scanned
    as a whole; only suffixes that put others into the same bucket take another scan of the new ones.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    change = np.flatnonzero(np.append(text[:-1] != text[1:], True))  # the end counts as a smaller byte
    turn = np.repeat(change, np.diff(np.concatenate([[-1], change])))
    after = np.append(text[1:], 0)[turn]
    small = (text[turn] < after) & (turn < n - 1)
    # stage one
    direct = np.flatnonzero(small)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)]).tobytes()
    words = _words(padded, n + depth + 8)
    order = np.argsort(words[direct].byteswap())
    direct = direct[order]
    for level in range(1, -(-depth // 8)):  # only groups that are equal so far are sorted on
        key = words[direct + 8 * (level - 1)]
        if level == 1:
            tied = np.append(False, key[1:] == key[:-1])
        else:
            tied[1:] &= key[1:] == key[:-1]
        among = tied | np.append(tied[1:], False)
        rows = np.flatnonzero(among)
        if not len(rows):
            break
        group = np.cumsum(~tied)[rows]
        rest = direct[rows]
        direct[rows] = rest[np.lexsort((words[rest + 8 * level].byteswap(), group))]
    # stage two
    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    head = ends - sizes
    small_sizes = np.bincount(text[direct], minlength=256)
    out = np.full(n, -1, np.int64)
    filled = 0
    for c in np.flatnonzero(small_sizes):
        out[ends[c] - small_sizes[c]:ends[c]] = direct[filled:filled + small_sizes[c]]
        filled += small_sizes[c]

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        chars = text[before]
        by_char = np.argsort(chars, kind="stable")
        before, chars = before[by_char], chars[by_char]
        new = np.bincount(chars, minlength=256)
        out[head[chars] + np.arange(len(chars)) - np.repeat(np.cumsum(new) - new, new)] = before
        head[:] += new

    out[head[text[n - 1]]] = n - 1  # the last suffix follows from the empty one
    head[text[n - 1]] += 1
    for c in np.flatnonzero(sizes):
        done = ends[c] - sizes[c]
        while done < head[c]:
            upto = head[c]
            induce(out[done:upto])
            done = upto
        if small_sizes[c]:
            induce(out[ends[c] - small_sizes[c]:ends[c]])
    return out


def smallest_holders(pieces: list[bytes], holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every piece, the smallest holder of a piece with an equal window.

    The windows of piece i are entries starts[i] .. starts[i+1] of the first array; the second is starts.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"\0".join(p.translate(_SHIFTED) for p in pieces) + b"\0", np.uint8)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    windows = np.maximum(lengths - PASSAGE + 1, 0)
    starts = np.concatenate([[0], np.cumsum(windows)])
    number = np.full(len(text), -1, np.int64)  # of the window that starts here
    at = np.repeat(begins - starts[:-1], windows) + np.arange(starts[-1])
    number[at] = np.arange(starts[-1])
    owner = np.repeat(holders, windows)
    ordered = suffix_array(text)
    ordered = ordered[number[ordered] >= 0]
    words = _words(text.tobytes() + bytes(8), len(text))
    # adjacent common prefixes: of at least 50 bytes where seven overlapping words agree
    alike = np.ones(max(len(ordered) - 1, 0), bool)
    for step in (0, 8, 16, 24, 32, 40, PASSAGE - 8):
        w = words[ordered + step]
        alike &= w[1:] == w[:-1]
    result = np.empty(starts[-1], np.int64)
    if len(ordered):
        first = np.flatnonzero(np.concatenate([[True], ~alike]))
        which = number[ordered]
        lowest = np.minimum.reduceat(owner[which], first)
        result[which] = np.repeat(lowest, np.diff(np.append(first, len(ordered))))
    return result, starts


#: UTF-8 never uses the byte 255, so every byte moves up by one and zero parts the pieces.
_SHIFTED = bytes([*range(1, 256), 255])


#: A gram's number: the bucket that judges it, and 40 bits of its hash. Grams that meet by chance only cost work.
_LOW = np.uint64((1 << 40) - 1)


class _Batch:
    """The texts of a batch in a fixed order, so that every pass numbers its runs and pieces alike."""

    def __init__(self, frame: pd.DataFrame, buckets: int):
        rows = sorted(zip(frame["doc_id"].tolist(), (t.encode("utf-8", "surrogatepass") for t in frame["text"])))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.raws = [r[1] for r in rows]
        runs = [window_runs(raw) for raw in self.raws]
        hashes = np.concatenate([r[0] for r in runs])
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        self.gram = bucket << np.uint64(40) | hashes & _LOW
        self.start, self.count = np.concatenate([r[1] for r in runs]), np.concatenate([r[2] for r in runs])
        self.text = np.repeat(np.arange(len(runs)), [len(r[0]) for r in runs])
        order = np.argsort(self.gram, kind="stable")  # ids ascend within equal grams
        grams, owners = self.gram[order], self.ids[self.text[order]]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
        last = np.append(first[1:], len(grams)) - 1 if len(grams) else first
        self.grams, self.several = grams[first], owners[first] < owners[last]

    def by_bucket(self, numbers: np.ndarray) -> list[tuple[int, slice]]:
        """Slices of an ascending array of gram numbers that belong to one bucket each."""
        bucket = (numbers >> np.uint64(40)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
        return [(int(bucket[a]), slice(int(a), int(b))) for a, b in zip(first, np.append(first[1:], len(bucket)))]

    def pieces(self, flags: pd.DataFrame):
        """Runs whose gram another document may hold, with the number of their piece; the distinct pieces
        in the order of their grams, and the smallest and largest holder of each."""
        masks = flags[flags["kind"] == 0].sort_values("bucket")
        sizes = [s.stop - s.start for _, s in self.by_bucket(self.grams)]
        elsewhere = [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(masks["payload"], sizes)]
        shared = self.grams[self.several | (np.concatenate(elsewhere) if elsewhere else np.empty(0, np.uint8)).astype(bool)]
        if not len(shared):
            none = np.empty(0, np.int64)
            return none, none, [], np.empty(0, np.uint64), none, none
        near = np.minimum(np.searchsorted(shared, self.gram), len(shared) - 1)
        held = np.flatnonzero(shared[near] == self.gram)
        held = held[np.argsort(self.gram[held], kind="stable")]
        numbers: dict[bytes, int] = {}
        raws = self.raws
        number = np.fromiter((numbers.setdefault(raws[t][s:e], len(numbers)) for t, s, e in zip(
            self.text[held].tolist(), self.start[held].tolist(), (self.start[held] + self.count[held] + PASSAGE - 1).tolist())), np.int64, len(held))
        owner = self.ids[self.text[held]]
        low, high = np.full(len(numbers), NO_ID), np.full(len(numbers), -(2**63))
        np.minimum.at(low, number, owner)
        np.maximum.at(high, number, owner)
        gram = np.zeros(len(numbers), np.uint64)
        gram[number] = self.gram[held]
        return held, number, list(numbers), gram, low, high


def _stretches(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of equal values that do not cross the starts of pieces: piece, offset in it, value."""
    begin = np.concatenate([[True], values[1:] != values[:-1]])
    begin[starts[:-1]] = True
    first = np.flatnonzero(begin)
    piece = np.searchsorted(starts, first, side="right") - 1
    return piece, first - starts[piece], values[first]


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: the index of each count c times, and 0 .. c - 1."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def drop_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans`` of every document; kept holds the bytes that remain.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id.

    Texts are dealt out once into batches of bounded size. Each batch sends the grams of its window
    runs, packed by bucket, to the tasks that find those of two or more batches, and gets back a bit
    for each; a gram is sent once per batch, however many of its documents hold it. Only runs of
    shared grams are sent on, as distinct pieces of text, to the task of their bucket. There a
    two-stage suffix array with adjacent common prefixes tells for every window its smallest holder,
    and each batch gets back the answers for its pieces. All documents of an id are in one batch.

    Null texts are empty; texts under 50 bytes stay whole. Rows with equal doc_id take nothing from
    each other. A null doc_id counts as the largest: it loses bytes to all others and takes none.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(-(-total // BATCH_BYTES), spark.sparkContext.defaultParallelism)
    spread = F.when(F.col("doc_id") == NO_ID, F.octet_length("text"))  # rows without an id may be many
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", spread), F.lit(batches)))
    buckets = min(2 * batches, (1 << 24) - 1)
    to_batch = "batch long, kind int, bucket long, payload binary"

    def grams(frame: pd.DataFrame) -> pd.DataFrame:
        batch = _Batch(frame, buckets)
        low = batch.grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        sent = [(b, low[s].tobytes()) for b, s in batch.by_bucket(batch.grams)]
        return pd.DataFrame({"bucket": [b for b, _ in sent], "batch": frame["batch"].iloc[0], "grams": [k for _, k in sent]})

    def several(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(k) // 5 for k in frame["grams"]]
        raw = np.frombuffer(b"".join(frame["grams"]), np.uint8).reshape(-1, 5)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :5] = raw
        _, which, counts = np.unique(key.view("<u8").reshape(-1), return_inverse=True, return_counts=True)
        masks = np.split(counts[which] > 1, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"batch": frame["batch"], "kind": 0, "bucket": frame["bucket"], "payload": [np.packbits(m).tobytes() for m in masks]})

    def send(texts: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        columns = ("bucket", "batch", "number", "low", "high", "size", "pieces")
        if not len(texts):
            return pd.DataFrame({c: [] for c in columns})
        batch = _Batch(texts, buckets)
        _, _, pieces, gram, low, high = batch.pieces(flags)
        small = zstandard.ZstdCompressor(3).compress
        numbers, sizes = np.arange(len(pieces)), np.array([len(p) for p in pieces], np.int32)
        return pd.DataFrame([
            (b, texts["batch"].iloc[0], *(small(x[s].tobytes()) for x in (numbers, low, high, sizes)), small(b"".join(pieces[s])))
            for b, s in batch.by_bucket(gram)], columns=columns)

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        large = zstandard.ZstdDecompressor().decompress
        number, low, high = (np.frombuffer(b"".join(map(large, frame[c])), np.int64) for c in ("number", "low", "high"))
        packed = [np.frombuffer(large(x), np.int32) for x in frame["size"]]
        batch = np.repeat(frame["batch"].to_numpy(), [len(x) for x in packed])
        unique: dict[bytes, int] = {}
        which, at, text = [], 0, b"".join(map(large, frame["pieces"]))
        for n in np.concatenate(packed).tolist():
            which.append(unique.setdefault(text[at:at + n], len(unique)))
            at += n
        del text
        which = np.array(which, np.int64)
        holder = np.full(len(unique), NO_ID)
        np.minimum.at(holder, which, low)
        lowest, starts = smallest_holders(list(unique), holder)
        piece, offset, value = _stretches(lowest, starts)
        begin = np.searchsorted(piece, np.arange(len(unique) + 1))
        asked = np.flatnonzero(np.minimum.reduceat(lowest, starts[:-1])[which] < high)  # some holder in the batch loses a window
        asked = asked[np.argsort(batch[asked], kind="stable")]
        row, nth = _expanded(np.diff(begin)[which[asked]])
        stretch = begin[which[asked]][row] + nth
        to, answers = batch[asked][row], np.stack([number[asked][row], offset[stretch], value[stretch]])
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, np.int64)
        small = zstandard.ZstdCompressor(3).compress
        return pd.DataFrame({
            "batch": to[first], "kind": 1, "bucket": 0,
            "payload": [small(np.ascontiguousarray(answers[:, a:b]).tobytes()) for a, b in zip(first, np.append(first[1:], len(to)))]})

    def finish(texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ("doc_id", "kept", "n_bytes", "n_removed", "n_spans")
        if not len(texts):
            return pd.DataFrame({c: [] for c in columns})
        batch = _Batch(texts, buckets)
        held, number, _, _, _, _ = batch.pieces(replies)
        large = zstandard.ZstdDecompressor().decompress
        parts = [np.frombuffer(large(p), np.int64).reshape(3, -1) for p, kind in zip(replies["payload"], replies["kind"]) if kind == 1]
        answers = np.concatenate(parts, axis=1) if parts else np.empty((3, 0), np.int64)
        answers = answers[:, np.lexsort((answers[1], answers[0]))]
        begin, end = np.searchsorted(answers[0], number), np.searchsorted(answers[0], number, side="right")
        run, nth = _expanded(end - begin)  # each run with each stretch of its piece
        stretch, final = begin[run] + nth, nth == (end - begin)[run] - 1
        run = held[run]
        upto = np.where(final, batch.count[run], answers[1][np.minimum(stretch + 1, max(answers.shape[1] - 1, 0))] if len(stretch) else 0)
        hit = answers[2][stretch] < batch.ids[batch.text[run]] if len(stretch) else np.empty(0, bool)
        base = np.concatenate([[0], np.cumsum([len(r) + 1 for r in batch.raws])])
        at = base[batch.text[run]] + batch.start[run]
        edges = np.zeros(base[-1], np.int32)
        np.add.at(edges, (at + answers[1][stretch])[hit] if len(stretch) else [], 1)
        np.add.at(edges, (at + upto + PASSAGE - 1)[hit] if len(stretch) else [], -1)
        gone = np.cumsum(edges) > 0
        out = []
        for doc_id, raw, a in zip(batch.ids.tolist(), batch.raws, base.tolist()):
            mine = gone[a:a + len(raw)]
            spans = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~mine].tobytes() if spans else raw
            out.append((None if doc_id == NO_ID else doc_id, kept, len(raw), len(raw) - len(kept), spans))
        frame = pd.DataFrame(out, columns=columns)
        return frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    flags = dealt.groupBy("batch").applyInPandas(grams, "bucket long, batch long, grams binary").groupBy("bucket").applyInPandas(several, to_batch)
    sent = dealt.groupBy("batch").cogroup(flags.groupBy("batch")).applyInPandas(
        send, "bucket long, batch long, number binary, low binary, high binary, size binary, pieces binary")
    replies = sent.groupBy("bucket").applyInPandas(judge, to_batch)
    return dealt.groupBy("batch").cogroup(flags.union(replies).groupBy("batch")).applyInPandas(
        finish, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def brute_force(texts: dict[int, str]) -> dict[int, tuple[int, int, str]]:
    """n_removed, n_spans and kept_sha256 by comparing all windows; for small tests."""
    lowest: dict[bytes, int] = {}
    raws = {d: (t or "").encode() for d, t in sorted(texts.items())}
    for d, raw in raws.items():
        for i in range(len(raw) - PASSAGE + 1):
            lowest.setdefault(raw[i:i + PASSAGE], d)
    out = {}
    for d, raw in raws.items():
        gone = bytearray(len(raw))
        for i in range(len(raw) - PASSAGE + 1):
            if lowest[raw[i:i + PASSAGE]] < d:
                gone[i:i + PASSAGE] = b"\1" * PASSAGE
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out
