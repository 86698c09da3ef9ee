"""Mixing sources to target weights with hash-threshold histograms, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import fits_broadcast, pick
from offerloom.session import cut_lineage

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: A 60-bit hash is read 15 bits at a time, so a histogram has at most 32,768 buckets a source.
LEVEL_BITS, LEVELS = 15, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: the share dealt out by weight, no source above ``most`` times its size.

    Water filling in one pass: sources are ordered by how soon they are full (cap over weight); a
    prefix of them is full, the rest divide what is left by weight. One row per source is all that
    these windows see. Sources are ordered by code point, null last.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(everything) - 1) % len(weights) + 1))
    whole = Window.partitionBy()
    capped = named.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("total", F.sum("source_size").over(whole) * share)
    by_full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = capped.withColumn("full_before", F.coalesce(F.sum("cap").over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    filled = filled.withColumn("weight_left", F.sum("weight").over(by_full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    filled = filled.withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    filled = filled.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)  # of the first one that is not full; later ones see less
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("hash", LEVEL_BITS * (LEVELS - 1 - level)).bitwiseAND((1 << LEVEL_BITS) - 1)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, passed: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies, taken`` of every document, and its ``passed`` columns.

    A source at r times its size takes every document floor(r) times and once more each document
    whose 60-bit hash lies below the source's threshold. The threshold comes from histograms: sizes
    are summed by source and leading 15 bits (map-side, so a hot source is 32,768 sums), the bucket
    where the running sum passes the budget is found, and only that boundary bucket is refined by the
    next 15 bits. Nothing is sorted, and a larger budget always takes a superset. Documents of the
    last boundary (equal hashes) are taken if that comes nearer to the budget.

    Null texts have size 0; null sources form a source of their own, last. Repeated rows of one
    doc_id and text share a hash and are taken together. A total of zero gives targets and copies of
    zero; an empty table gives no rows. Very long texts are only counted.
    """
    others = [f"passed_{i}" for i in range(len(passed))]
    full = pick(docs, "doc_id", "text", "source", *passed).toDF("doc_id", "text", "source", *others).select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))), 1, 15), 16, 10).cast("long").alias("hash"), *others)
    rows = cut_lineage(full.drop(*others))
    full = full if others else rows  # passed columns are read again rather than checkpointed
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = goal.withColumn("base", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int"))
    goal = cut_lineage(goal.withColumn("budget", F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0))).withColumn("edge", F.lit(0).cast("long")))
    inside = rows.where("size > 0").select("source", "size", "hash")
    for level in range(LEVELS):
        last = level == LEVELS - 1
        histogram = inside.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("source").orderBy("b")
        histogram = histogram.withColumn("upto", F.sum("n").over(running)).withColumnRenamed("source", "of")
        crossing = histogram.join(fits_broadcast(goal), F.col("of").eqNullSafe(F.col("source"))).where(
            (F.col("upto") - F.col("n") <= F.col("budget")) & (F.col("budget") < F.col("upto"))).select("of", "b", "n", "upto")
        found = goal.join(crossing, F.col("source").eqNullSafe(F.col("of")), "left")
        past = F.col("upto") - F.col("n")
        nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - past)
        step = F.when(nearer, F.col("b") + 1).otherwise(F.col("b")) if last else F.col("b")
        edge = F.shiftleft("edge", LEVEL_BITS) + F.coalesce(step, F.lit(0))  # only sources without words have no crossing
        goal = cut_lineage(found.select(
            "source", "source_size", "target", "base", (F.col("budget") - F.coalesce(past, F.lit(0))).alias("budget"), edge.alias("edge")))
        if not last:
            shown = F.shiftright("hash", LEVEL_BITS * (LEVELS - 1 - level))
            marks = fits_broadcast(goal.select(F.col("source").alias("of"), F.col("edge").alias("at")))
            inside = inside.join(marks, F.col("source").eqNullSafe(F.col("of")) & (shown == F.col("at"))).select("source", "size", "hash")
    goal = fits_broadcast(goal.withColumnRenamed("source", "of"))
    copies = F.when(F.col("source_size") > 0, F.col("base") + F.when((F.col("hash") < F.col("edge")) & (F.col("base") < most), 1).otherwise(0)).otherwise(0)
    return full.join(goal, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"), *[F.col(o).alias(p) for o, p in zip(others, passed)])
