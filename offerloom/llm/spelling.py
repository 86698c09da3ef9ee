"""Spelling variants: words one edit apart, by Gram matrices of letter-count blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import ascii_lower, fits_broadcast, pick
from offerloom.session import cut_lineage, spread

#: Words have this many characters and occurrences at least; a form occurs this many times as often as its word.
LETTERS, SEEN, FACTOR = 7, 2, 10
#: Words of a block that stand on one side of a product, and words on the other side for each of them.
TILE, GUESTS = 4096, 8
#: Letters as they are dealt to classes, the frequent ones of European languages first.
FREQUENT = "etaoinshrdlucmfwygpbvkxqjz"
#: Letter counts of a word: a to z, and six for all other characters, which may share one; that only lowers distances.
DIMENSIONS, OTHERS = 32, 6
_LETTER = np.array([c - 97 if 97 <= c <= 122 else 26 + c % OTHERS for c in range(0x110000)], np.uint8)


def word_table(docs: DataFrame, edit: Callable[[Column, Column], Column] | None = None, letters: int = LETTERS, seen: int = SEEN) -> DataFrame:
    """``word, n``: maximal runs of letters (A-Z, a-z, U+00C0-U+00FF) with A-Z lower-cased, at least ``letters`` long and ``seen`` often.

    ``edit`` may change a run, given the doc_id and the lower-cased run; it never makes it longer. Runs
    are counted map-side first, so a hot word costs a task one row. Null texts have no runs.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{letters},}}"), F.lit(0))
    rows = pick(docs, "doc_id", "text").select("doc_id", F.explode(runs).alias("run")).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    word = F.col("run") if edit is None else edit(F.col("doc_id"), F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def _classes(k: int) -> list[str]:
    """The letters dealt to ``k`` classes there and back; all other characters belong to the last class."""
    dealt = [[] for _ in range(k)]
    for i, letter in enumerate(FREQUENT):
        dealt[i % k if i // k % 2 == 0 else k - 1 - i % k].append(letter)
    return ["".join(d) for d in dealt]


def _places(k: int) -> Column:
    """Where a word is compared, by its counts c0, c1, ... of letters of each class: ``place, home`` structs.

    An edit leaves the counts alone, takes one from a class (the longer word is a guest in the block of
    the shorter one), or moves one to another class (the word of the later block is a guest in the
    earlier one). So each pair of near words meets in exactly one block, and a word has 1 + k + k (k - 1) / 2 places.
    """

    def block(**moved: int) -> Column:
        return F.concat_ws(",", *[(F.col(f"c{i}") + moved.get(f"c{i}", 0)).cast("string") for i in range(k)])

    places = [F.struct(block().alias("place"), F.lit(True).alias("home"))]
    for j in range(k):
        targets = [block(**{f"c{j}": -1}), *[block(**{f"c{j}": -1, f"c{i}": 1}) for i in range(j + 1, k)]]
        places += [F.when(F.col(f"c{j}") > 0, F.struct(t.alias("place"), F.lit(False).alias("home"))) for t in targets]
    return F.array_compact(F.array(*places))


def _met(words: DataFrame, k: int) -> DataFrame:
    """``place, tile, chunk, home, word, n``: groups of at most about TILE words at home and GUESTS times as many guests.

    A crowded block is cut into tiles by a hash, its guests into chunks; each tile meets each chunk, and
    words of one tile are guests of the tiles before it.
    """
    counted, left = [], F.length("word")
    for i, letters in enumerate(_classes(k)[:-1]):
        counted.append((F.length("word") - F.length(F.translate("word", letters, ""))).alias(f"c{i}"))
        left = left - (F.length("word") - F.length(F.translate("word", letters, "")))
    blocked = words.select("word", "n", *counted, left.alias(f"c{k - 1}"))
    sizes = blocked.groupBy(*[f"c{i}" for i in range(k)]).agg(F.count("*").alias("size")).select("size", F.inline(_places(k)))
    sizes = sizes.groupBy("place").agg(F.sum(F.when(F.col("home"), F.col("size"))).alias("homes"), F.sum(F.when(~F.col("home"), F.col("size"))).alias("guests"))
    crowded = sizes.where((F.col("homes") > TILE) | (F.col("guests") > GUESTS * TILE)).where("homes > 0").select(
        "place", F.ceil(F.col("homes") / TILE).alias("tiles"), F.ceil((F.coalesce("guests", F.lit(0)) + F.col("homes")) / (GUESTS * TILE)).alias("chunks"))
    crowded = fits_broadcast(cut_lineage(crowded))  # at most a row for TILE words
    rows = blocked.select("word", "n", F.inline(_places(k))).join(crowded, "place", "left")
    tile, chunk = F.pmod(F.xxhash64("word", F.lit("tile")), "tiles"), F.pmod(F.xxhash64("word", F.lit("chunk")), "chunks")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    group = lambda t, c, home: F.struct(t.alias("tile"), c.alias("chunk"), F.lit(home).alias("home"))
    at_home = F.concat(
        F.transform(upto(F.col("chunks")), lambda c: group(tile, c, True)),
        F.when(tile > 0, F.transform(upto(tile), lambda t: group(t, chunk, False))).otherwise(F.array().cast("array<struct<tile:bigint,chunk:bigint,home:boolean>>")))
    one = lambda home: F.array(group(F.lit(0).cast("long"), F.lit(0).cast("long"), home))
    groups = F.when(F.col("home"), F.when(F.col("tiles").isNull(), one(True)).otherwise(at_home)).otherwise(
        F.when(F.col("tiles").isNull(), one(False)).otherwise(F.transform(upto(F.col("tiles")), lambda t: group(t, chunk, False))))
    return rows.select("word", "n", "place", F.inline(groups))


def _near(short: np.ndarray, other: np.ndarray, longer: bool) -> np.ndarray:
    """Which rows of characters differ by one replaced character, or by one inserted if ``other`` is ``longer``."""
    width = short.shape[1]
    if not longer:
        return (short != other).sum(axis=1) == 1
    ahead = np.argmin(np.c_[short == other[:, :width], np.zeros(len(short), bool)], axis=1)
    behind = np.argmin(np.c_[(short == other[:, 1:])[:, ::-1], np.zeros(len(short), bool)], axis=1)
    return ahead + behind >= width


def _pairs(table: pa.Table) -> pa.Table:
    """``word, near, near_n`` in both directions of the near pairs of one group."""
    words, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
    home = table.column("home").to_numpy()
    first_chunk = table.num_rows > 0 and table.column("chunk")[0].as_py() == 0
    texts = words.to_pylist()
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), sizes)
    wide = int(sizes.max(initial=0))
    real = np.float64 if wide > 1000 else np.float32  # squares of counts are exact
    counts = np.bincount(owner * DIMENSIONS + _LETTER[codes], minlength=len(texts) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(real)
    squares = (counts * counts).sum(axis=1)
    chars = np.zeros((len(texts), wide), np.uint8 if codes.max(initial=0) < 256 else np.uint32)
    chars[np.arange(wide) < sizes[:, None]] = codes
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(left: np.ndarray, right: np.ndarray, same: bool = False) -> None:
        """Pairs of the two sets of rows at a squared distance of two at most whose edits are verified."""
        longer = len(right) > 0 and sizes[right[0]] > sizes[left[0]]
        augmented = np.c_[-2 * counts[left], squares[left], np.ones(len(left), real)]
        met = np.c_[counts[right], np.ones(len(right), real), squares[right]].T
        step = max(1, (4 << 20) // max(1, len(right)))
        for at in range(0, len(left), step):
            close = np.flatnonzero(augmented[at:at + step] @ met < 2.5)
            a, b = close // len(right) + at, close % len(right)
            if same:
                a, b = a[a < b], b[a < b]
            width = int(sizes[left[0]])
            some = max(1, (8 << 20) // (wide + 1))
            for lo in range(0, len(a), some):
                i, j = left[a[lo:lo + some]], right[b[lo:lo + some]]
                near = _near(chars[i, :width], chars[j, :width + longer], longer)
                found.append((i[near], j[near]))

    mine, guests = np.flatnonzero(home), np.flatnonzero(~home)
    if len(mine):
        if first_chunk:
            compare(mine, mine, same=True)
        for size in np.unique(sizes[guests]):
            of_size = guests[sizes[guests] == size]
            for at in range(0, len(of_size), TILE):
                compare(mine, of_size[at:at + TILE])
    a = np.concatenate([x for x, _ in found] + [np.empty(0, np.int64)])
    b = np.concatenate([x for _, x in found] + [np.empty(0, np.int64)])
    here, there = np.concatenate([a, b]), np.concatenate([b, a])
    return pa.table({"word": words.take(pa.array(here)), "near": words.take(pa.array(there)), "near_n": pa.array(n[there], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: every word of ``word, n`` with every word one inserted, deleted or replaced character away.

    Blocks are words of equal counts of a few letter classes, so words of neighbouring lengths and counts
    meet; the number of classes follows the logarithm of the vocabulary, which keeps blocks about
    as large as it grows. Within a group products of letter counts give the squared distances.
    """
    n = words.count()
    k = min(12, max(2, round(math.log2(max(n, 1))) - 15))
    keys = ["place", "tile", "chunk"]
    return spread(_met(words, k), *keys).groupBy(*keys).applyInArrow(_pairs, "word string, near string, near_n long")


def spelling_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``word, n``, a word occurring once.

    n_near counts the words one edit away. form is the one of them with the largest n (ties: the
    smallest in code-point order) if that is at least ``factor`` times the word's own n, else null.
    root is where the forms end. Along forms n grows by the factor, so the doubling of pointers needs
    as many rounds as the logarithm of the logarithm of the largest n.

    A null word is left out; empty words and words of one character are compared like any other; words
    may be very long. An empty table gives no rows.
    """
    words = cut_lineage(pick(words, "word", "n").where("word IS NOT NULL"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).withColumnRenamed("word", "of")
    joined = words.join(found, words.word == found.of, "left")
    strong = -F.col("best.minus") >= F.col("n") * factor
    formed = cut_lineage(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n")))
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    hops = max(1, math.ceil(math.log(most, factor))) if factor > 1 else 1
    for _ in range(math.ceil(math.log2(hops))):
        following = links.toDF("through", "next")
        links = cut_lineage(links.join(following, links.root == following.through, "left").select("word", F.coalesce("next", "root").alias("root")))
    ends = links.toDF("from", "root")
    return formed.join(ends, formed.word == F.col("from"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
