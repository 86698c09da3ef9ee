"""Similarity and containment joins as equi-joins on grams.

All thresholds in use are positive, so a qualifying pair shares a gram. Terms are indexed by their
rarest grams only (prefix filtering, exact for the given minimum share), each candidate is emitted
on its first shared prefix gram, and hot grams that still meet go to AQE's skew join. Rows of grams are
never broadcast (``by_shuffle``). Nothing is capped: whatever the blocking lets through is verified by the
caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import c, evaluated, similarity_of, trigrams
from ..session import by_shuffle, spread


def char_windows(text, sizes=(1, 2, 3)) -> Column:
    """Distinct character windows of the given sizes, no padding."""
    def of_size(n: int) -> Column:
        count = F.length(c(text)) - n + 1
        made = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(c(text), i, n))
        return F.when(count >= 1, made).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of_size(n) for n in sizes])))


def key_windows(text) -> Column:
    """The windows a containment key is chosen from: size 3, or the whole text when shorter."""
    return F.when(F.length(c(text)) < 3, F.array(c(text))).otherwise(char_windows(text, (3,)))


def gram_counts(grams: DataFrame) -> DataFrame:
    """Document frequency per gram; normalized text has 37 symbols, so at most 37+37^2+37^3 rows."""
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def rarest_first(texts: DataFrame, column: str, grams: Column) -> DataFrame:
    """``column`` plus ``ordered``: its grams sorted by (document frequency, gram)."""
    long = texts.select(column, F.explode(grams).alias("gram"))
    return (
        long.join(by_shuffle(gram_counts(long)), "gram")
        .groupBy(column)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda s: s["gram"]).alias("ordered"))
    )


def numbered(grams: Column) -> Column:
    """Grams as numbers, since arrays of numbers meet several times faster than arrays of texts: the bytes of the gram
    (normalized text has three), or a hash of more than seven, which only text that is not normalized may have."""
    return F.transform(grams, lambda g: F.when(F.octet_length(g) <= 7, F.conv(F.hex(g), 16, 10).cast("bigint")).otherwise(F.xxhash64(g)))


def overlap_candidates(queries: DataFrame, terms: DataFrame, share: float, grams=trigrams, similar: bool = False) -> DataFrame:
    """(nq, nt) pairs where the query holds at least ``share`` of the term's grams.

    Covers similarity >= share and word similarity >= share: both need that overlap. ``similar`` adds
    ``similarity``, the set similarity of the grams at hand, so that nobody builds them again for each pair.
    """
    def need(size: Column) -> Column:
        return F.ceil(size * share - 1e-6)

    term_grams = evaluated(rarest_first(terms, "nt", grams("nt")).withColumnRenamed("ordered", "texts"), ordered=numbered(F.col("texts"))).drop("texts")
    size = F.size("ordered")
    prefix = F.slice("ordered", 1, (size - need(size) + 1).cast("int"))
    postings = evaluated(term_grams, prefix=prefix).select("nt", "ordered", "prefix", F.explode("prefix").alias("gram"))
    sides = evaluated(spread(queries.select("nq")), qg=numbered(grams("nq"))).select("nq", "qg", F.explode("qg").alias("gram"))
    shared_first = F.element_at(F.array_intersect("prefix", "qg"), 1)
    met = evaluated(sides.join(by_shuffle(postings), "gram").filter(F.col("gram") == shared_first), common=F.size(F.array_intersect("ordered", "qg")))
    similarity = similarity_of(F.col("common"), F.size("ordered"), F.size("qg")).alias("similarity")
    return met.filter(F.col("common") >= need(F.size("ordered"))).select("nq", "nt", *([similarity] if similar else []))


def contained_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(nq, nt) pairs where the query text contains the term text (character containment)."""
    keys = rarest_first(terms, "nt", key_windows("nt")).select("nt", F.element_at("ordered", 1).alias("gram"))
    sides = spread(queries.select("nq")).select("nq", F.explode(char_windows("nq")).alias("gram"))
    return sides.join(by_shuffle(keys), "gram").filter(F.contains("nq", "nt")).select("nq", "nt")


def containing_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(nq, nt) pairs where the term text contains the query text."""
    postings = terms.select("nt", F.explode(char_windows("nt")).alias("gram"))
    windows = queries.select("nq", key_windows("nq").alias("w"))
    # a query window no term has rules the query out, so every window must be found
    keys = (
        windows.select("nq", F.size("w").alias("n"), F.explode("w").alias("gram"))
        .join(by_shuffle(gram_counts(postings)), "gram")
        .groupBy("nq", "n")
        .agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("df", "gram"))["gram"].alias("gram"))
        .filter("found = n")
    )
    return keys.join(by_shuffle(postings), "gram").filter(F.contains("nt", "nq")).select("nq", "nt")


def candidate_pairs(queries: DataFrame, terms: DataFrame, share: float, *, contained=True, containing=True) -> DataFrame:
    """Distinct (nq, nt) candidates from the requested passes; inputs hold distinct non-empty texts."""
    pairs = overlap_candidates(queries, terms, share)
    if contained:
        pairs = pairs.unionByName(contained_terms(queries, terms))
    if containing:
        pairs = pairs.unionByName(containing_terms(queries, terms))
    return pairs.distinct()
