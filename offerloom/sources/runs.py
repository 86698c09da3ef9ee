"""Run artifacts: append-only sink, manifest, and ledger publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def run_manifest(gated: DataFrame, run_status: DataFrame) -> DataFrame:
    """One row per run: counts and status, written after the data it describes."""
    counts = gated.groupBy("source_key", "run_id").agg(
        F.count(F.lit(1)).alias("records_received"), F.count_if(F.col("parse_status") == "parsed").alias("records_valid"),
        F.count_if(F.col("parse_status") == "invalid").alias("records_rejected"))
    return counts.join(run_status.select("run_id", "status", "deviation_percentage"), "run_id")


def write_run(gated: DataFrame, observations: DataFrame, manifest: DataFrame, folder: str) -> None:
    """Append raw rows and observations partitioned by (source_key, run_id); the manifest goes last.

    Readers take a run as complete only when its manifest row exists.
    """
    for name, rows in (("raw_records", gated), ("observations", observations)):
        rows.write.mode("append").partitionBy("source_key", "run_id").parquet(f"{folder}/{name}")
    manifest.write.mode("append").partitionBy("source_key").parquet(f"{folder}/manifests")


def publish_run(runs: DataFrame, records: DataFrame, ledger_runs: DataFrame, ledger_records: DataFrame) -> dict[str, DataFrame]:
    """New rows for the ledger: runs by id, raw rows by (run, hash); a replay adds nothing."""
    fresh_runs = runs.dropDuplicates(["run_id"]).join(ledger_runs.select("run_id"), "run_id", "left_anti").withColumn(
        "records_published", F.when(F.col("status") == "succeeded", F.col("records_valid")).otherwise(F.lit(0)))
    fresh_records = records.dropDuplicates(["run_id", "record_hash"]).join(
        ledger_records.select("run_id", "record_hash"), ["run_id", "record_hash"], "left_anti")
    return {"runs": fresh_runs, "records": fresh_records}
