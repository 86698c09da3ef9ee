"""Bottom-k sketches of shingle hashes, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import fits_broadcast, once, pick
from offerloom.session import cut_lineage

#: 96 hashes give a standard error of at most 0.051 for a likeness; smaller sets are exact.
SHINGLE, KEPT, HASH_BITS = 5, 96, 48


def shingle_set(text: Column, shingle: int = SHINGLE) -> Column:
    """Distinct 48-bit hashes of the word shingles; a shorter text is one shingle, a blank one none."""

    def hashes(words: Column) -> Column:
        long_enough = F.transform(
            F.sequence(F.lit(1), F.size(words) - (shingle - 1)),
            lambda i: F.shiftrightunsigned(F.xxhash64(*[F.element_at(words, i + j) for j in range(shingle)]), 64 - HASH_BITS))
        whole = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(words, " ")), 64 - HASH_BITS))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(words) >= shingle, long_enough).when(F.size(words) > 0, whole).otherwise(none)

    return F.array_distinct(once(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), hashes))


def sketch(text: Column, kept: int = KEPT) -> Column:
    """The ``kept`` smallest hashes, ascending."""
    return F.slice(F.sort_array(shingle_set(text)), 1, kept)


def merged(a: Column, b: Column, kept: int = KEPT) -> Column:
    """The sketch of two parts together, equal to the sketch of the union of their shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, kept)


def distinct_shingles(a: Column, kept: int = KEPT) -> Column:
    """Estimated number of distinct shingles; exact while fewer than ``kept``."""
    return F.when(F.size(a) < kept, F.size(a).cast("double")).otherwise(
        (kept - 1) * F.lit(float(2 ** HASH_BITS)) / F.greatest(F.array_max(a), F.lit(1)))


def resemblance(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Estimated Jaccard likeness of the shingle sets: shared hashes among the smallest of the union.

    Two empty sketches are alike (1), an empty one and another are not (0).
    """
    def share(smallest: Column) -> Column:
        both = F.array_intersect(F.array_intersect(smallest, a), b)
        return F.when(F.size(smallest) == 0, 1.0).otherwise(F.size(both) / F.size(smallest))

    return once(merged(a, b, kept), share)


def containment(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Estimated share of a's shingles that b holds too."""
    likeness = resemblance(a, b, kept)
    union = distinct_shingles(merged(a, b, kept), kept)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), likeness * union / distinct_shingles(a, kept)))


def printed(a: Column) -> Column:
    """Twelve hex digits a hash, in ascending order; an empty sketch prints as an empty string."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0")), "")


def fingerprints(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """``doc_id, sketch, n_shingles`` of every document; null texts are empty. Map-only."""
    rows = pick(docs, "doc_id", "text").select("doc_id", sketch(F.coalesce("text", F.lit("")), kept).alias("sketch"))
    return rows.select("doc_id", "sketch", distinct_shingles(F.col("sketch"), kept).alias("n_shingles"))


def _followed(rows: DataFrame) -> DataFrame:
    """``doc_id, same, n_chars, before``: every id with the one before it in ascending order, the first with the last.

    Only ids and lengths are sorted. They are dealt out by ranges (fixed by a checkpoint), numbered
    within each range, and the first of a range comes after the last of the range before it that has
    rows; the table of last rows has one row per range.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = cut_lineage(rows.repartitionByRange(ranges, "doc_id", "same").withColumn("part", F.spark_partition_id()))
    order, here = Window.partitionBy("part").orderBy("doc_id", "same"), F.struct("doc_id", "same", "n_chars")
    inner = dealt.withColumn("before", F.lag(here).over(order))
    parts, ring = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = dealt.groupBy("part").agg(F.max(here).alias("end"))
    ends = ends.select(F.col("part").alias("of"), F.coalesce(F.lag("end").over(parts), F.last("end").over(ring)).alias("ahead"))
    ends = fits_broadcast(cut_lineage(ends))
    return inner.join(ends, inner.part == ends.of).select("doc_id", "same", "n_chars", F.coalesce("before", "ahead").alias("before"))


def edited_pairs(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """``doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next`` of every document.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all)
    of the next document in ascending doc_id; the last one is followed by the first. Texts are
    sketched once and each document receives only the head it needs and a sketch from the next.

    Null texts are empty and have an empty sketch. Rows of one doc_id follow each other by the hash
    of their texts; exact repeats of a row collapse to one. A null doc_id comes first. A single
    document is followed by itself. An empty table gives no rows.
    """
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("same", F.xxhash64("text"))
    order = _followed(rows.select("doc_id", "same", F.char_length("text").alias("n_chars")).distinct())
    order = cut_lineage(order.select(
        F.coalesce("doc_id", F.lit(-1)).alias("key"), F.col("doc_id").isNull().alias("none"), F.col("same").alias("key_same"),
        "n_chars", F.col("before.doc_id").alias("to_id"), F.col("before.same").alias("to_same"),
        F.floor(F.col("before.n_chars") / 2).cast("int").alias("need")))
    texts = rows.dropDuplicates(["doc_id", "same"]) if rows.select("doc_id").count() != order.count() else rows
    keyed = texts.select(
        F.coalesce("doc_id", F.lit(-1)).alias("key"), F.col("doc_id").isNull().alias("none"), F.col("same").alias("key_same"), "text")
    keyed = keyed.select("*", F.inline(F.array(F.struct(sketch(F.col("text"), kept).alias("sketch")))))  # one exchange, read by both branches
    known = keyed.join(order, ["key", "none", "key_same"])
    sent = known.select(
        F.coalesce("to_id", F.lit(-1)).alias("key"), F.col("to_id").isNull().alias("none"), F.col("to_same").alias("key_same"),
        F.expr("substring(text, 1, need)").alias("head"), F.col("sketch").alias("next_sketch"))
    met = known.select("key", "none", "key_same", "text", "n_chars", "sketch").join(sent, ["key", "none", "key_same"])
    met = met.withColumn("doc_id", F.when(~F.col("none"), F.col("key")))
    edited = met.select(
        "doc_id", "n_chars", "sketch", "next_sketch",
        F.inline(F.array(F.struct(F.concat(F.expr("substring(text, 1, n_chars - int(floor(n_chars / 2)))"), F.col("head")).alias("edited")))))
    done = edited.select("*", F.inline(F.array(F.struct(sketch(F.col("edited"), kept).alias("edited_sketch")))))
    return done.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), kept).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), kept).alias("near_next"))

