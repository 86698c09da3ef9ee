"""Periodic runs of words by string synchronising sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import pick, rest, sliced

#: A run has this many words at least, and its period this many times.
LEAST, TIMES = 24, 3
#: Periods up to this are found by comparing each word with the one that many words on.
SMALL = 8
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values whose bits all depend on one another."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


def _extended(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """First and last place (exclusive) of the stretch around ``at`` whose words ``period`` apart are equal."""

    def equal(a: np.ndarray, b: np.ndarray) -> int:
        differ = np.flatnonzero(a != b)
        return int(differ[0]) if len(differ) else len(a)

    low, high, step = at, at, 64
    while True:  # codes end in a word of its own, so this ends
        n = equal(codes[high:high + step][: len(codes) - period - high], codes[high + period:high + period + step])
        high += n
        if n < step:
            break
        step *= 2
    step = 64
    while low:
        n = min(step, low)
        met = equal(codes[low - n:low][::-1], codes[low + period - n:low + period][::-1])
        low -= met
        if met < n:
            break
        step *= 2
    return low, high + period


def find_runs(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every maximal stretch with three periods at least.

    ``codes`` are the words of all documents, each document followed by a code that occurs nowhere
    else; ``sizes`` count the words of each, with that code. Periods up to SMALL come from direct
    comparison. A dyadic scale t supplies the periods above 2t and up to 4t. Its synchronising set holds
    the places i where the least hash of the words [j, j + t) with i <= j <= i + t is that of i or of
    i + t. Windows of a period of t / 3 or less do not take part; they lie in runs that smaller scales
    have found. Every stretch of one period q of a longer run holds such a place, and the place q words
    on has the same context of 2t words. Equal contexts lie more than t / 3 words apart, so a place
    meets a bounded number of others up to 4t, and all of them propose their distances. A proposal is
    extended word by word, so nothing rests on a hash but the choice of places.
    """
    seen: set[tuple[int, int]] = set()
    starts, lengths, periods = [], [], []

    def add(start: int, length: int, period: int) -> None:
        if (start, length) not in seen:  # else a divisor of the period has been found before
            seen.add((start, length))
            starts.append(start)
            lengths.append(length)
            periods.append(period)

    for q in range(1, min(SMALL, len(codes) - 1) + 1):
        edges = np.flatnonzero(np.diff(np.r_[False, codes[:-q] == codes[q:], False].view(np.int8)))
        first, last = edges[::2], edges[1::2]
        long = last - first >= (TIMES - 1) * q
        for a, b in zip(first[long].tolist(), last[long].tolist()):
            add(a, b - a + q, q)
    t = SMALL // 2
    hashes = _mixed(codes.astype(np.uint64))
    for step in (1 << k for k in range(t.bit_length() - 1)):
        hashes = _joined(hashes, np.roll(hashes, -step))
    where, ends = np.arange(len(codes)), np.cumsum(sizes)
    while True:  # hashes are of the t words from each place on
        kept = sizes >= TIMES * (2 * t + 1) + 1
        if not kept.any():
            break
        if not kept.all():
            inside = np.repeat(kept, sizes)
            where, hashes, sizes = where[inside], hashes[inside], sizes[kept]
            ends = np.cumsum(sizes)
        n = len(where)
        named = hashes.copy()
        for a, size, q in zip(starts, lengths, periods):
            if 3 * q <= t <= size:
                at = int(np.searchsorted(where, a))
                if at < n and where[at] == a:
                    named[at:at + size - t + 1] = _NONE
        least, width = named, 1
        while width < t:
            least = np.minimum(least, np.roll(least, -width))
            width *= 2
        least = np.minimum(least, np.roll(least, -1))
        chosen = ((least == named) | (least == np.roll(named, -t))) & (least != _NONE)
        at = np.flatnonzero(chosen)
        owner = np.searchsorted(ends, at, side="right")
        fits = at + 2 * t < ends[owner]
        at, owner = at[fits], owner[fits]
        contexts = _joined(hashes, np.roll(hashes, -t))
        order = np.argsort(contexts[at], kind="stable")
        at, owner, names = at[order], owner[order], contexts[at][order]
        found_at, found_d, j = [], [], 1
        while j < len(at):
            d = at[j:] - at[:-j]
            near = (names[j:] == names[:-j]) & (d <= 4 * t)
            if not near.any():
                break
            near &= (d > 2 * t) & (owner[j:] == owner[:-j])
            found_at.append(at[:-j][near])
            found_d.append(d[near])
            j += 1
        if found_at:
            at, d = np.concatenate(found_at), np.concatenate(found_d)
            far = 2 * t  # a whole period agrees to the right of the place or to its left
            right = contexts[np.minimum(at + d - far, n - 1)] == contexts[np.minimum(at + 2 * d - far, n - 1)]
            left = (at >= far) & (contexts[at - far] == contexts[at - far + d])
            at, d = at[right | left], d[right | left]
            order = np.lexsort((at, d))
            period = high = -1
            for place, q in zip(where[at[order]].tolist(), d[order].tolist()):
                if q == period and place < high - q:
                    continue
                low, high = _extended(codes, place, q)
                period = q
                if high - low >= TIMES * q:
                    add(low, high - low, q)
        hashes, t = contexts, 2 * t
    found = np.array([starts, lengths, periods], np.int64).reshape(3, -1)
    return tuple(found[:, np.lexsort((found[2], found[0]))])


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, int], np.ndarray | None] | None = None, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document.

    Words lie between the blanks \\x20 and \\x09-\\x0D. A run is a stretch of words with smallest period q,
    ``least`` words and three periods at least, that no neighbouring word extends; runs are ordered by
    start, then period. collapsed has the words, joined by spaces, without those that lie in a run after its first q
    words. ``edit`` may say, for a doc_id and its number of words, which word stands at each place.

    A null, empty or blank text has no words and no runs. Overlapping runs are all reported, ties do not
    arise, repeated rows and null doc_ids are kept, an empty table gives no rows. Map-only: many
    documents make one array, and memory follows the longest text.
    """

    def run(batches):
        for part in sliced(batches, rows=20_000, chars="text", limit=4 << 20):
            doc_ids = part.column("doc_id")
            split = pc.ascii_split_whitespace(pc.fill_null(part.column("text"), "").cast(pa.large_string()))
            bounds = split.offsets.to_numpy().astype(np.int64)
            values = split.values.slice(bounds[0], bounds[-1] - bounds[0])
            real = pc.binary_length(values).to_numpy() > 0
            counts = np.diff(np.r_[0, np.cumsum(real)][bounds - bounds[0]])
            which, first = np.flatnonzero(real), np.cumsum(counts) - counts
            if edit is not None:
                for row, (doc_id, n) in enumerate(zip(doc_ids.to_pylist(), counts.tolist())):
                    moved = edit(doc_id, n)
                    if moved is not None:
                        which[first[row]:first[row] + n] = which[first[row] + moved]
            coded = values.dictionary_encode()
            ends = np.cumsum(counts + 1)
            codes = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
            own = np.ones(len(codes), bool)
            own[ends - 1] = False
            codes[own] = coded.indices.to_numpy()[which]
            codes[~own] = len(coded.dictionary) + np.arange(len(counts))
            starts, lengths, periods = find_runs(codes, counts + 1)
            row = np.searchsorted(ends, starts, side="right")
            covered = np.zeros(len(codes) + 1, np.int64)
            long = lengths >= least
            starts, lengths, periods, row = starts[long], lengths[long], periods[long], row[long]
            np.add.at(covered, starts + periods, 1)
            np.add.at(covered, starts + lengths, -1)
            kept = (np.cumsum(covered[:-1]) == 0)[own]
            left = np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(counts)]]
            words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), values.take(pa.array(which[kept])))
            runs = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (starts - (ends - counts - 1)[row], lengths, periods)], ["start", "length", "period"])
            of = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))])
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(counts), pa.ListArray.from_arrays(pa.array(of, pa.int32()), runs), pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])
        rest()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def greatest(runs):
    """The run of the greatest exponent, compared exactly; ties: smallest start, then period. Null without runs."""

    def order(a, b):
        mine, other = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(mine != other, F.when(mine > other, -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(
            F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    return F.get(F.array_sort(runs, order), F.lit(0))
