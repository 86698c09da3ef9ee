"""Streams against their batch twins: several files, a replay, and out-of-order rows."""

import datetime as dt

from pyspark.sql import functions as F

from offerloom.operators import analytics as A, offers as O, quality as V
from offerloom.streaming import jobs


def feed(spark, folder, frames):
    """One parquet file per frame, read back one file per micro-batch."""
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")


def run(df, folder, mode, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return df.sparkSession.table(name)


def test_usage_totals_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("occurred_at"), F.col("event_type").alias("action"))
    halves = [events.filter(F.dayofmonth("occurred_at") <= 15), events.filter(F.dayofmonth("occurred_at") > 15)]
    seen = run(jobs.stream_usage_totals(feed(spark, str(tmp_path), halves)), str(tmp_path), "update", "usage_stream")
    final = seen.groupBy("day", "action").agg(F.max("requests").alias("requests"))
    assert {tuple(r) for r in final.collect()} == {tuple(r) for r in A.usage_totals(events).collect()}


def test_captures_deduplicate_across_batches(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    ddl = "scope string, query_text string, engine string, fingerprint string, occurred_at timestamp"
    frames = [spark.createDataFrame([("s", "Glucosa", "v6", "f", t(1)), ("s", "glucosa ", "v6", "f", t(2))], ddl), spark.createDataFrame([("s", "GLUCOSA", "v6", "f", t(1)), ("s", "glucosa", "v6", "g", t(3))], ddl)]
    seen = run(jobs.stream_capture_reviews(feed(spark, str(tmp_path), frames)), str(tmp_path), "append", "capture_stream")
    assert sorted(r.fingerprint for r in seen.collect()) == ["f", "g"]


def test_ingest_replay_is_idempotent(spark, tmp_path):
    ddl = "source_key string, run_id string, seq bigint, payload string, n_observations int"
    first = spark.createDataFrame([("s", "r", i, '{"n":%d}' % (i % 4), 1) for i in range(6)], ddl)
    publish = jobs.ingest_batch(str(tmp_path / "out"))
    publish(first, 0)
    publish(first, 0)
    assert spark.read.parquet(str(tmp_path / "out/ledger")).count() == 4
    stream = feed(spark, str(tmp_path / "in"), [first, spark.createDataFrame([("s", "r2", 0, '{"n":0}', 1)], ddl)])
    query = stream.writeStream.foreachBatch(publish).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "out/ledger")).count() == 5
    assert V.record_gate(first).filter("parse_status = 'parsed'").count() == 4


def test_click_metrics_append_closed_days(spark, tmp_path):
    ddl = "anonymous_id string, offer_id string, item_id string, provider_id string, location_id string, link_type string, surface string, occurred_at timestamp"
    click = lambda d, h, link: ("u", "o", "i", "p", None, link, "web", dt.datetime(2024, 1, d, h))
    frames = [spark.createDataFrame([click(1, 1, "booking"), click(1, 2, "booking"), click(1, 3, "odd")], ddl), spark.createDataFrame([click(1, 23, "booking"), click(5, 1, "study")], ddl), spark.createDataFrame([click(9, 1, "study")], ddl)]
    offers = spark.createDataFrame([("o", "i", "p", "active")], "offer_id string, item_id string, provider_id string, status string")
    locations = spark.createDataFrame([], "location_id string, provider_id string, status string")
    seen = run(jobs.stream_click_metrics(feed(spark, str(tmp_path), frames), offers, locations), str(tmp_path), "append", "click_stream")
    got = {(r.day.day, r.link_type): r.clicks for r in seen.collect()}
    assert got[(1, "booking")] == 3 and (1, "odd") not in got


def test_price_stream_equals_history(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", 5, 1), ("b", 2, 1), ("a", 5, 2), ("a", 7, 3), ("b", 2, 4), ("a", 5, 5)]
    ddl = "series string, amount_minor bigint, observed_at timestamp"
    frames = [spark.createDataFrame([(s, a, dt.datetime(2024, 1, d)) for s, a, d in part], ddl) for part in (rows[:3], rows[3:])]
    seen = run(jobs.stream_price_versions(feed(spark, str(tmp_path), frames)), str(tmp_path), "append", "price_stream")
    batch = O.price_versions(frames[0].unionByName(frames[1]), ["series"])
    assert {(r.series, r.amount_minor, r.valid_from) for r in seen.filter("event = 'opened'").collect()} == {(r.series, r.amount_minor, r.valid_from) for r in batch.collect()}


def test_price_stream_closes_versions_and_sets_late_rows_apart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ddl, day = "series string, amount_minor bigint, observed_at timestamp", lambda d: dt.datetime(2024, 1, d)
    parts = [[("a", 5, day(1)), ("a", 5, day(4))], [("a", 6, day(3)), ("a", 5, day(6))], [("a", 7, day(8))]]
    seen = run(jobs.stream_price_versions(feed(spark, str(tmp_path), [spark.createDataFrame(p, ddl) for p in parts])), str(tmp_path), "append", "late_stream")
    got = sorted((r.event, r.amount_minor, r.valid_from.day, r.valid_to and r.valid_to.day, r.last_seen_at and r.last_seen_at.day) for r in seen.collect())
    assert got == [("closed", 5, 1, 8, 6), ("late", 6, 3, None, None), ("opened", 5, 1, None, 1), ("opened", 7, 8, None, 8)]


def test_ingest_keeps_rejects_of_a_replayed_batch_once(spark, tmp_path):
    ddl = "source_key string, run_id string, seq bigint, payload string, n_observations int"
    publish = jobs.ingest_batch(str(tmp_path / "out"))
    first = spark.createDataFrame([("s", "r", 0, '{"n":0}', 1), ("s", "r", 1, "no json", 1)], ddl)
    later = spark.createDataFrame([("s", "r", 2, '{"n":0}', 1), ("s", "r", 3, '{"n":9}', 1)], ddl)
    for batch, number in ((first, 0), (first, 0), (later, 1), (later, 1)):
        publish(batch, number)
    rejects = spark.read.parquet(str(tmp_path / "out/rejects"))
    assert sorted((r.batch_id, r.seq) for r in rejects.collect()) == [(0, 1), (1, 2)]
    assert spark.read.parquet(str(tmp_path / "out/ledger")).count() == 2
