"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = "*", memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("offerloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Full parallelism for steps that cost far more CPU than bytes.

    Adaptive execution sizes partitions by bytes and would put small rows with expensive work into
    very few tasks; an explicit partition count is left alone.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def by_shuffle(df: DataFrame) -> DataFrame:
    """One side of a join that must be sorted and merged whatever its size is estimated at.

    Spark sizes exploded rows, built strings and arrays by what they were made from, so rows of many times the
    broadcast threshold would be collected in the driver.
    """
    return df.hint("merge")


def _shared(df: DataFrame) -> str:
    """The checkpoint folder: ``spark.checkpoint.dir`` wins; a private one is set only where nothing is configured and the master is local (tests)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="offerloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names, so a lost executor costs a re-read."""
    _shared(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, by a Parquet table. For long loops: a checkpoint keeps the size estimate of its plan,
    a product over its joins whose digits double with every round."""
    path = f"{_shared(df)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
