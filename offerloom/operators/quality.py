"""Gates, freshness, integrity rules and cycle detection."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hygiene import content_hash
from ..session import written

log = logging.getLogger(__name__)

MAX_PAYLOAD_BYTES, MAX_OBSERVATIONS = 512 * 1024, 100


def _checked(records: DataFrame, max_bytes: int, max_observations: int) -> DataFrame:
    size_ok = F.octet_length("payload") <= max_bytes
    checked = records.withColumns({
        "record_hash": content_hash("payload"),
        "error_detail": F.when(F.col("n_observations") > max_observations, "record contains too many observations").when(
            ~size_ok, "record payload exceeds the safety limit"),
    }).withColumn("error_detail", F.coalesce("error_detail", F.when(F.col("record_hash").isNull(), "record payload is not JSON")))
    return checked


def record_gate(records: DataFrame, *, max_bytes: int = MAX_PAYLOAD_BYTES, max_observations: int = MAX_OBSERVATIONS) -> DataFrame:
    """Every record with ``parse_status`` and ``error_detail``; invalid rows are kept.

    ``records``: source_key, run_id, seq (unique in the run), payload, n_observations. The first row
    of a content wins inside its run: firsts come from a map-side combined minimum and are joined on
    the unique (run, seq), so many copies of one record never meet in one task.
    """
    checked = _checked(records, max_bytes, max_observations)
    first = checked.filter("error_detail IS NULL").groupBy("run_id", "record_hash").agg(F.min("seq").alias("seq")).select(
        "run_id", "seq", F.lit(True).alias("first"))
    marked = checked.join(first, ["run_id", "seq"], "left")
    error = F.coalesce("error_detail", F.when(F.col("first").isNull(), "duplicate record hash in run"))
    return marked.withColumn("error_detail", error).withColumn(
        "parse_status", F.when(F.col("error_detail").isNull(), "parsed").otherwise("invalid")).drop("first")


def run_counts(records: DataFrame, *, max_bytes: int = MAX_PAYLOAD_BYTES, max_observations: int = MAX_OBSERVATIONS) -> DataFrame:
    """(run_id, received, valid) as ``record_gate`` would find them, where nobody reads its rows: the first row of a content
    is one row per (run, hash), so contents are counted map-side and no record meets another."""
    hashed = _checked(records, max_bytes, max_observations).select("run_id", F.when(F.col("error_detail").isNull(), F.col("record_hash")).alias("hash"))
    return hashed.groupBy("run_id", "hash").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(
        F.sum("n").alias("received"), F.count("hash").alias("valid"))


def run_gate(gated: DataFrame, runs: DataFrame, limits: DataFrame) -> DataFrame:
    """Status per run of gated records (``judge_runs``)."""
    counts = gated.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("parse_status") == "parsed").alias("valid"))
    return judge_runs(counts, runs, limits)


def judge_runs(counts: DataFrame, runs: DataFrame, limits: DataFrame) -> DataFrame:
    """Status per run from its counts, its limits and the last *succeeded* run of its source.

    ``runs``: run_id, source_key, finished_at, failed. ``limits``: source_key, expected_min,
    expected_max, max_negative_pct. Which run counts as previous depends on earlier verdicts, so the
    runs (one small row each, never their records) are sorted by source and time within their partition
    and read in order; only the last succeeded count is carried, however long a source's history is.
    """
    rows = runs.join(counts, "run_id", "left").fillna({"received": 0, "valid": 0}).join(limits, "source_key", "left")
    ordered = rows.select(
        "source_key", "run_id", "finished_at", "received", "valid", "failed", "expected_min", "expected_max", "max_negative_pct",
    ).repartition("source_key").sortWithinPartitions("source_key", "finished_at", "run_id")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, previous = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.source_key != source:
                    source, previous = r.source_key, None
                deviation = None
                if previous:
                    deviation = float(Decimal(repr((r.received - previous) / previous * 100)).quantize(Decimal("0.0001"), ROUND_HALF_UP))
                low = deviation is not None and pd.notna(r.max_negative_pct) and deviation < -r.max_negative_pct
                outside = (pd.notna(r.expected_max) and r.received > r.expected_max) or (pd.notna(r.expected_min) and r.received < r.expected_min)
                if low or outside:
                    status = "quarantined"
                elif r.failed:
                    status = "quarantined" if r.valid else "failed"
                else:
                    status = "succeeded"
                out.append((r.source_key, r.run_id, r.received, r.valid, previous, deviation, status))
                previous = r.received if status == "succeeded" else previous
            names = ["source_key", "run_id", "records_received", "records_valid", "previous_success_count", "deviation_percentage", "status"]
            yield pd.DataFrame(out, columns=names).astype({"previous_success_count": "Int64", "deviation_percentage": "Float64"})

    kinds = {n: ordered.schema[n].dataType.simpleString() for n in ("source_key", "run_id")}
    return ordered.mapInPandas(
        judge, f"source_key {kinds['source_key']}, run_id {kinds['run_id']}, records_received bigint, records_valid bigint, "
               "previous_success_count bigint, deviation_percentage double, status string")


def quarantine_observations(observations: DataFrame, run_status: DataFrame) -> DataFrame:
    """Observations of a quarantined run become quarantined themselves."""
    bad = run_status.filter("status = 'quarantined'").select("run_id", F.lit(True).alias("bad"))
    return observations.join(bad, "run_id", "left").withColumn(
        "status", F.when(F.col("bad"), "quarantined").otherwise(F.col("status"))).drop("bad")


def last_success(manifests: DataFrame) -> DataFrame:
    """Record count of the latest succeeded run of each source, by finish time."""
    return manifests.filter("status = 'succeeded'").groupBy("source_key").agg(
        F.max_by("records_received", F.struct("finished_at", "run_id")).alias("previous_success_count"), F.max("finished_at").alias("last_success_at"))


def artifact_check(manifests: DataFrame, records: DataFrame, observations: DataFrame) -> DataFrame:
    """(run_id, problem): counts that differ from the manifest, hashes that do not recompute, orphan observations."""
    counts = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parse_status") == "parsed").alias("ok"))
    joined = manifests.join(counts, "run_id", "full_outer")
    wrong = joined.filter(
        (F.coalesce("records_received", F.lit(-1)) != F.coalesce("n", F.lit(0))) | (F.coalesce("records_valid", F.lit(-1)) != F.coalesce("ok", F.lit(0))))
    bad_hash = records.filter((F.col("parse_status") == "parsed") & ~content_hash("payload").eqNullSafe(F.col("record_hash")))
    orphans = observations.join(records.select("run_id", "record_hash").distinct(), ["run_id", "record_hash"], "left_anti")
    def tagged(df, problem):
        return df.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select("run_id", F.lit(problem).alias("problem"), "n")
    return tagged(wrong, "count_mismatch").unionByName(tagged(bad_hash, "hash_mismatch")).unionByName(tagged(orphans, "orphan_observation"))


def endpoint_freshness(runs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Last success per endpoint; with ``known`` values it never moves back."""
    seen = runs.filter("status = 'succeeded'").groupBy("endpoint_id").agg(F.max("finished_at").alias("last_success_at"))
    if known is None:
        return seen
    return known.withColumnRenamed("last_success_at", "before").join(seen, "endpoint_id", "full_outer").select(
        "endpoint_id", F.greatest("before", "last_success_at").alias("last_success_at"))


def stale_facts(freshness: DataFrame, limits: DataFrame, prices: DataFrame, as_of, price_days: int = 30) -> DataFrame:
    """Endpoints past their allowed staleness and current prices not seen for ``price_days``."""
    at = F.lit(as_of).cast("timestamp_ntz")
    late = limits.join(freshness, "endpoint_id", "left").filter(
        F.col("last_success_at").isNull() | (F.timestamp_diff("MINUTE", F.col("last_success_at"), at) > F.col("max_staleness_minutes")))
    old = prices.filter(F.col("is_current") & (F.col("last_seen_at") < at - F.make_dt_interval(days=F.lit(price_days))))
    return late.select(F.lit("endpoint").alias("kind"), F.col("endpoint_id").alias("key")).unionByName(
        old.select(F.lit("price").alias("kind"), F.col("price_id").alias("key")))


# --- integrity ----------------------------------------------------------------------------------

def missing_parent(rule: str, child: DataFrame, key: str, foreign: str, parent: DataFrame, primary: str) -> DataFrame:
    """Child rows whose reference has no parent."""
    lost = child.filter(F.col(foreign).isNotNull()).join(parent.select(F.col(primary).alias(foreign)), foreign, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col(foreign).cast("string").alias("detail"))


def not_unique(rule: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return many.select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"), F.col("n").cast("string").alias("detail"))


def differs(rule: str, child: DataFrame, key: str, foreign: str, own: str, parent: DataFrame, primary: str, expected: str) -> DataFrame:
    """Child rows whose own value is not the value of the row they reference."""
    looked_up = parent.select(F.col(primary).alias(foreign), F.col(expected).alias("_expected"))
    rows = child.select(key, foreign, own).join(looked_up, foreign)
    return rows.filter(~F.col(own).eqNullSafe(F.col("_expected"))).select(
        F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.concat_ws("!=", own, "_expected").alias("detail"))


def integrity_report(*findings: DataFrame) -> DataFrame:
    """(rule, key, detail) of all violated rules."""
    return reduce(DataFrame.unionByName, findings)


def _contracted(edges: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """Edges after one round without ends and without some of the nodes on plain paths; and those nodes as (v, p, c).

    A node with one edge in and one out is replaced by an edge past it, if the hash of the round is larger
    there than at neighbours of the same kind, so no two neighbours go at once and a constant part goes.
    """
    ways_in = edges.groupBy(F.col("c").alias("v")).agg(F.count(F.lit(1)).alias("n_in"), F.min("p").alias("before"))
    ways_out = edges.groupBy(F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("n_out"), F.min("c").alias("after"))
    plain = ways_in.join(ways_out, "v").filter("n_in = 1 AND n_out = 1").select("v", F.col("before").alias("p"), F.col("after").alias("c"), F.struct(F.xxhash64("v", F.lit(salt)), F.col("v")).alias("h"))
    plain = written(plain)
    beside = plain.select("v", "h")
    chosen = plain.join(beside.toDF("p", "hp"), "p", "left").join(beside.toDF("c", "hc"), "c", "left").filter(
        (F.col("hp").isNull() | (F.col("hp") < F.col("h"))) & (F.col("hc").isNull() | (F.col("hc") < F.col("h")))).select("v", "p", "c")
    chosen = written(chosen)
    gone = chosen.select("v")
    left = edges.join(gone.toDF("p"), "p", "left_anti").join(gone.toDF("c"), "c", "left_anti").select("p", "c").unionByName(chosen.select("p", "c"))
    return left.distinct(), chosen


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose start has an edge in and whose end has an edge out."""
    return edges.join(edges.select(F.col("c").alias("p")).distinct(), "p", "left_semi").join(
        edges.select(F.col("p").alias("c")).distinct(), "c", "left_semi").select("p", "c")


def _spread_colour(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, colour): the largest node from which each node is reached, itself included."""
    colours, moved = written(nodes.select("v", F.col("v").alias("colour"))), 1
    while moved:
        offered = edges.join(colours.toDF("p", "offered"), "p").groupBy(F.col("c").alias("v")).agg(F.max("offered").alias("offered"))
        after = written(colours.join(offered, "v", "left").select("v", F.greatest("colour", "offered").alias("colour"), (F.col("offered") > F.col("colour")).alias("moved")))
        moved, colours = after.filter("moved").count(), after.select("v", "colour")
    return colours


def _strong_components(edges: DataFrame) -> DataFrame | None:
    """(v, scc) of the nodes of strongly connected components of two nodes or more; None without any.

    Each turn colours nodes by the largest one that reaches them; of one colour, the nodes that also reach
    its root are a component. Tables have a row a node; rounds follow the paths of what contraction left.
    """
    found: DataFrame | None = None
    while edges.take(1):
        nodes = edges.select(F.explode(F.array("p", "c")).alias("v")).distinct()
        colours = _spread_colour(edges, nodes)
        within = written(edges.join(colours.toDF("p", "kp"), "p").join(colours.toDF("c", "kc"), "c").filter("kp = kc").select("p", "c"))
        marked = written(colours.filter("v = colour"))
        fresh = marked
        while fresh.take(1):
            back = within.join(fresh.select(F.col("v").alias("c"), "colour"), "c").select(F.col("p").alias("v"), "colour").distinct()
            fresh = written(back.join(marked.select("v"), "v", "left_anti"))
            marked = written(marked.unionByName(fresh))
        several = marked.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("colour")
        now = written(marked.join(several, "colour").select("v", F.col("colour").alias("scc")))
        found = now if found is None else found.unionByName(now)
        gone = marked.select("v")
        edges = written(_trimmed(edges.join(gone.toDF("p"), "p", "left_anti").join(gone.toDF("c"), "c", "left_anti").select("p", "c")))
    return found


def component_cycles(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Edges that lie on a cycle of a component graph: those within one strongly connected component.

    Rounds of trimming and of contracting plain paths come first: long chains and long cycles shrink by a
    constant part a round, a graph without cycles vanishes, and a cycle ends as a loop. What remains is
    divided by colours (``_strong_components``), then contracted nodes get the component of the edge that
    stood for them, last round first. No table has more rows than nodes or edges; every round is written.
    Null ends are no edges; an edge from a node to itself is a cycle; repeated edges give one row.
    """
    every = written(edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).dropna().distinct())
    core, rounds, loops, left = every, [], None, every.count()
    while left:
        looped = written(core.filter("p = c").select(F.col("p").alias("v")))
        loops = looped if loops is None else loops.unionByName(looped)
        core, chosen = _contracted(written(_trimmed(core.filter("p <> c"))), len(rounds))
        core, now = written(core), 0
        rounds.append(chosen)
        now = core.count()
        log.info("cycles: round %d leaves %d of %d edges", len(rounds), now, left)
        if now == left:
            break
        left = now
    if loops is None:
        return every.select(F.col("p").alias(parent), F.col("c").alias(child))
    own = loops.distinct().select("v", F.col("v").alias("scc"))
    strong = _strong_components(core) if left else None
    later = reduce(DataFrame.unionByName, [r.select("v") for r in rounds])
    alone = own.join(later, "v", "left_anti")
    labels = written(alone if strong is None else strong.unionByName(alone.join(strong.select("v"), "v", "left_anti")))
    for chosen in reversed(rounds):
        held = chosen.join(labels.toDF("p", "sp"), "p").join(labels.toDF("c", "sc"), "c").filter("sp = sc").select("v", F.col("sp").alias("scc"))
        single = own.join(chosen.select("v"), "v", "left_semi").join(held.select("v"), "v", "left_anti")
        labels = written(labels.unionByName(held).unionByName(single))
    return every.join(labels.toDF("p", "sp"), "p").join(labels.toDF("c", "sc"), "c").filter("sp = sc").select(F.col("p").alias(parent), F.col("c").alias(child))
