"""Incremental jobs as Structured Streaming queries; each mirrors a batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import norm_text
from ..operators.analytics import valid_clicks
from ..operators.quality import record_gate
from ..sources.runs import publish_run


def stream_usage_totals(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Requests per (day, action); update mode. Batch twin: ``usage_totals``."""
    return (
        events.withWatermark("occurred_at", lateness)
        .groupBy(F.window("occurred_at", "1 day"), "action").agg(F.count(F.lit(1)).alias("requests"))
        .select(F.to_date("window.start").alias("day"), "action", "requests"))


def stream_click_metrics(clicks: DataFrame, offers: DataFrame, locations: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Valid clicks per (day, link type), appended when the day can no longer change."""
    valid, _ = valid_clicks(clicks.withWatermark("occurred_at", lateness), offers, locations)
    return (
        valid.groupBy(F.window("occurred_at", "1 day"), "link_type").agg(F.count(F.lit(1)).alias("clicks"))
        .select(F.to_date("window.start").alias("day"), "link_type", "clicks"))


def stream_daily_visitors(clicks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """First click of each visitor per (day, visitor): counting these rows gives exact daily visitors."""
    dated = clicks.withColumn("day", F.to_date("occurred_at")).withWatermark("occurred_at", lateness)
    return dated.dropDuplicatesWithinWatermark(["day", "anonymous_id"]).select("day", "anonymous_id")


def stream_capture_reviews(captures: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Unresolved searches once per (scope, query, engine, fingerprint) within the watermark."""
    keyed = captures.withColumn("normalized_query", norm_text("query_text")).withWatermark("occurred_at", lateness)
    return keyed.dropDuplicatesWithinWatermark(["scope", "normalized_query", "engine", "fingerprint"])


def ingest_batch(folder: str, max_bytes: int = 512 * 1024):
    """``foreachBatch`` function: gate the micro-batch and append what the ledger does not hold yet.

    The ledger is partitioned by run, and a batch reads the partitions of its own runs only (their
    names are listed from the batch, and prune the scan). The anti-join on (run, hash) makes a replayed
    batch add nothing; a hash that the ledger holds already is a reject row of its own. The rejects of a
    batch overwrite its own partition, so a replay leaves them as they are.
    """
    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        gated = record_gate(batch, max_bytes=max_bytes).persist()
        try:
            good = gated.filter("parse_status = 'parsed'").select("source_key", "run_id", "record_hash", "seq", "payload")
            runs = [r.run_id for r in gated.select("run_id").distinct().collect()]
            known = _existing(spark, f"{folder}/ledger", "record_hash string, batch_id bigint, run_id string").filter(F.col("run_id").isin(runs))
            earlier = known.filter(F.col("batch_id") != batch_id).select("run_id", "record_hash").distinct()
            repeated = good.join(earlier, ["run_id", "record_hash"], "left_semi").select("source_key", "run_id", "record_hash", "seq", "payload")
            fresh = publish_run(
                good.select("run_id", F.lit("succeeded").alias("status"), F.lit(0).alias("records_valid")), good,
                known.select("run_id"), known.select("run_id", "record_hash"))
            fresh["records"].withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").partitionBy("run_id").parquet(f"{folder}/ledger")
            invalid = gated.filter("parse_status = 'invalid'").select("source_key", "run_id", "record_hash", "seq", "payload", "error_detail")
            rejects = invalid.unionByName(repeated.withColumn("error_detail", F.lit("record of an earlier batch")))
            rejects.write.mode("overwrite").parquet(f"{folder}/rejects/batch_id={batch_id}")
        finally:
            gated.unpersist()
    return publish


def _existing(spark, path: str, schema: str) -> DataFrame:
    """A table with a given schema, without rows as long as nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class PriceVersions(StatefulProcessor):
    """Open, extend and close price versions per series.

    State is the open version: amount, first and last sighting. Every row that is not late refreshes it,
    so a series observed at one price never expires; one that stays silent for the retention does.
    """

    def __init__(self, retention_days: int = 400):
        self.retention_ms = retention_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "amount bigint, valid_from timestamp, last_seen_at timestamp", ttlDurationMs=self.retention_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        amount, since, seen = self.last.get() if self.last.exists() else (None, None, None)
        out, every = [], pd.concat(list(rows))
        for at, now in every.groupby("observed_at")["amount_minor"].min().items():
            at, now = at.to_pydatetime(), int(now)
            if seen is not None and at <= seen:
                if at < seen or now != amount:
                    out.append((*key, "late", now, None, at, None, None))
                continue
            if now != amount:
                if amount is not None:
                    out.append((*key, "closed", amount, None, since, at, seen))
                out.append((*key, "opened", now, amount, at, None, at))
                amount, since = now, at
            seen = at
        if seen is not None:
            self.last.update((amount, since, seen))
        names = ["series", "event", "amount_minor", "previous_amount", "valid_from", "valid_to", "last_seen_at"]
        yield pd.DataFrame(out, columns=names).astype({"previous_amount": "Int64", "valid_to": "datetime64[us]", "last_seen_at": "datetime64[us]"})

    def close(self) -> None:
        pass


def stream_price_versions(observations: DataFrame, retention_days: int = 400) -> DataFrame:
    """Version events per series of (series, amount_minor, observed_at).

    ``opened`` starts a version, ``closed`` ends the one before it (with its last sighting), ``late`` is a
    row older than what its series has already seen: it changes nothing and is kept for a reject table.
    Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    return observations.groupBy("series").transformWithStateInPandas(
        PriceVersions(retention_days),
        "series string, event string, amount_minor bigint, previous_amount bigint, valid_from timestamp, valid_to timestamp, last_seen_at timestamp",
        "append", "processingTime")
