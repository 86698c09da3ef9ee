"""Dropping lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import BLANKS, ascii_lower, pick
from offerloom.session import cut_lineage


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _hash(key: Column) -> Column:
    """128 bits of a key, so that unequal lines never meet in practice."""
    return F.unhex(F.md5(key))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, passed: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, kept, n_lines, n_dropped`` of every document, and its ``passed`` columns.

    Lines are normalised, exploded and hashed; distinct documents are counted per hash in two
    partial aggregations, so a line of a third of all documents is pre-aggregated before it meets
    in one task. Lines of ``min_chars`` code points found in ``min_docs`` documents stay only in the
    largest doc_id; each document gets the set of hashes it loses and is put together by position.

    A null or empty text is one empty line. Rows with equal doc_id count as one document; a null
    doc_id counts as one more document, is smaller than any other, and keeps a line only where no
    other document holds it. Repeated rows stay repeated. Very long texts are split within their
    row. An empty table gives no rows.
    """
    others = [f"passed_{i}" for i in range(len(passed))]
    rows = pick(docs, "doc_id", "text", *passed).toDF("doc_id", "text", *others).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("same", F.xxhash64("text"))  # rows of one doc_id may differ in text
    lines = F.split("text", "\n", -1)
    keyed = rows.select("doc_id", "same", F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "line"))
    keyed = keyed.select("doc_id", "same", "pos", _key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    held = cut_lineage(keyed.select("doc_id", "same", "pos", _hash(F.col("key")).alias("h")))
    per_doc = held.select("h", "doc_id").distinct()
    shared = per_doc.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs).select("h", "last")
    shared = cut_lineage(shared)  # a plain join then, whose hot lines adaptive execution splits
    lost = held.join(shared, "h").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    lost = lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("same").alias("lost_same")).agg(F.collect_set("pos").alias("lost"))
    joined = rows.join(lost, rows.doc_id.eqNullSafe(lost.lost_id) & (rows.same == lost.lost_same), "left")
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost")), lambda p: F.col("lines")[p])
    split = joined.select("doc_id", *others, "lost", F.inline(F.array(F.struct(lines.alias("lines")))))
    kept = split.select("doc_id", *others, F.size("lines").alias("n_lines"), F.when(F.col("lost").isNull(), F.col("lines")).otherwise(stays).alias("stays"))
    return kept.select(
        "doc_id", F.array_join("stays", "\n").alias("kept"), F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - F.size("stays")).cast("long").alias("n_dropped"), *[F.col(o).alias(p) for o, p in zip(others, passed)])
