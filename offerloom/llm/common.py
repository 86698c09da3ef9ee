"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters \x20 and \x09-\x0D, which separate words and pad lines.
BLANKS = " \t\n\x0b\f\r"
#: More rows than this are never broadcast.
BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns; other columns, even those that differ only in case, never clash."""
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{df.columns.index(name)}").alias(name) for name in names])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else untouched; one byte per character means plain ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once per row, also when ``use`` needs it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint after counting a materialized table; larger tables are joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the checkpoint folder that the cluster names."""
    cut_lineage(spark.range(0))  # sets a private folder where none is named and the master is local
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this job wrote and nothing reads any more, in whatever store it lies."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512, chars: str | None = None, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that Python objects of few rows (and about ``limit`` bytes of ``chars``) exist at once."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, rows)
            if chars is not None and part.num_rows > 1:
                total, keep = 0, 0
                for value in part.column(part.schema.get_field_index(chars)):
                    total += len(value.as_buffer()) if value.is_valid else 0
                    if keep and total > limit:
                        break
                    keep += 1
                part = part.slice(0, keep)
            yield part
            start += part.num_rows


def rest() -> None:
    """At the end of a task: give freed memory of Arrow and numpy back, so that an idle Python worker holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim is not None:
        trim(0)
