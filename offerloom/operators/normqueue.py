"""The normalization queue: exact matches, application, groups, captures, reviews and reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hygiene import content_hash
from ..functions.text import evaluated, norm_text
from ..session import by_shuffle
from .offers import best_by

OPEN = ["pending", "ambiguous", "no_match"]


def open_queue(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Runs that still wait: open status, a label, and no decision."""
    waiting = runs.filter(F.col("status").isin(*OPEN) & (F.coalesce("normalized_input", F.lit("")) != ""))
    return waiting.join(decisions.select("run_id"), "run_id", "left_anti")


def queue_page(queue: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """Keyset page in (created_at, run_id) descending order."""
    rows = queue
    if after is not None:
        at, run_id = after
        rows = rows.filter((F.col("created_at") < F.lit(at)) | ((F.col("created_at") == F.lit(at)) & (F.col("run_id") < F.lit(run_id))))
    return rows.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def exact_matches(queue: DataFrame, items: DataFrame, names: DataFrame, aliases: DataFrame, disambiguation: DataFrame) -> DataFrame:
    """Open runs whose label equals the terms of exactly one active item; ambiguous phrases never qualify.

    Labels are judged once per (label, provider) and the verdict is joined back, so one label with
    very many runs costs one comparison.
    """
    labels = queue.select("normalized_input", "provider_id").distinct()
    active = items.filter("status = 'active'").select("item_id")
    by_name = names.select(norm_text("name").alias("normalized_input"), "item_id", F.col("name").alias("matched_term"), F.lit("exact").alias("match_method"), F.lit(1).alias("o"))
    approved = aliases.filter("status = 'approved'").select(
        norm_text("alias").alias("normalized_input"), "item_id", F.col("alias").alias("matched_term"), F.col("provider_id").alias("alias_provider"))
    shared = approved.filter("alias_provider IS NULL").drop("alias_provider").withColumns({"match_method": F.lit("alias"), "o": F.lit(3)})
    own = approved.filter("alias_provider IS NOT NULL").withColumns({"provider_id": F.col("alias_provider"), "match_method": F.lit("provider_alias"), "o": F.lit(2)}).drop("alias_provider")
    general = by_name.unionByName(shared).join(active, "item_id", "left_semi")
    options = labels.join(general, "normalized_input").unionByName(
        labels.join(own.join(active, "item_id", "left_semi"), ["normalized_input", "provider_id"]).select("normalized_input", "provider_id", "item_id", "matched_term", "match_method", "o"))
    blocked = disambiguation.filter("status = 'approved'").select(norm_text("term").alias("normalized_input")).distinct()
    per = options.groupBy("normalized_input", "provider_id").agg(
        F.count_distinct("item_id").alias("n"), F.min(F.struct("o", "matched_term", "item_id", "match_method")).alias("b")).filter("n = 1")
    chosen = per.join(blocked, "normalized_input", "left_anti").select(
        "normalized_input", F.coalesce("provider_id", F.lit("")).alias("pk"), "b.item_id", "b.match_method", "b.matched_term")
    return queue.withColumn("pk", F.coalesce("provider_id", F.lit(""))).join(chosen, ["normalized_input", "pk"]).drop("pk")


def exact_matches_approved(matches: DataFrame, runs_source: DataFrame, approved: DataFrame) -> DataFrame:
    """Only matches whose run came from an approved source (run_id, source_id) x (source_id)."""
    allowed = runs_source.join(approved.select("source_id").distinct(), "source_id", "left_semi").select("run_id")
    return matches.join(allowed, "run_id", "left_semi")


def materialize_queue(records: DataFrame, labels: DataFrame, queued: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new queue rows, records with conflicting labels).

    ``records``: record_key, source_key, payload_label, provider_id; ``labels``: record_key, label
    (label observations). A record needs exactly one label, equal to its payload label.
    """
    per = labels.groupBy("record_key").agg(F.count_distinct(norm_text("label")).alias("n"), F.min("label").alias("label"))
    rows = evaluated(records.join(per, "record_key"), normalized_input=norm_text("label"), wanted=norm_text("payload_label"))
    same = F.col("normalized_input") == F.col("wanted")
    good = rows.filter((F.col("n") == 1) & same).join(queued.select("record_key"), "record_key", "left_anti")
    return (good.select("record_key", "source_key", "provider_id", F.col("label").alias("raw_text"), "normalized_input", F.lit("pending").alias("status")),
            rows.filter((F.col("n") > 1) | ~same).select("record_key", F.col("n").alias("labels")))


def apply_exact(matches: DataFrame, decisions: DataFrame, batch_size: int, request_id: str) -> tuple[DataFrame, DataFrame]:
    """(new decisions, counts) for the first ``batch_size`` matches in queue order.

    Rows decided meanwhile are skipped; a replay of the same request adds nothing.
    """
    replay = decisions.filter(F.col("request_id") == request_id)
    batch = matches.orderBy("created_at", "run_id").limit(batch_size)
    fresh = batch.join(decisions.select("run_id").distinct(), "run_id", "left_anti")
    if not replay.isEmpty():
        fresh = fresh.limit(0)
    out = fresh.select("run_id", F.col("item_id").alias("selected_item_id"), F.lit("automatic").alias("decision_type"), F.lit(request_id).alias("request_id"))
    parts = batch.select(F.lit(1).alias("s"), F.lit(0).alias("p"), F.lit(0).alias("a")).unionByName(
        out.select(F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("a"))).unionByName(
        matches.select(F.lit(0).alias("s"), F.lit(0).alias("p"), F.lit(1).alias("a")))
    counts = parts.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("s", "p", "a")])
    return out, counts.select(
        F.col("s").alias("selected"), F.col("p").alias("processed"), (F.col("s") - F.col("p")).alias("skipped"), (F.col("a") - F.col("s")).alias("remaining"))


def queue_groups(queue: DataFrame) -> DataFrame:
    """Groups of open rows per (provider, label) with a representative row; all map-side combined."""
    status = F.when(F.bool_or(F.col("status") == "ambiguous"), "ambiguous").when(F.bool_or(F.col("status") == "pending"), "pending").otherwise("no_match")
    return queue.groupBy("provider_id", "normalized_input").agg(
        status.alias("status"), F.count(F.lit(1)).alias("occurrence_count"), F.count_distinct("provider_sku").alias("distinct_sku_count"),
        F.count_if("has_candidates").alias("rows_with_candidates"), F.min("created_at").alias("first_queued_at"), F.max("created_at").alias("last_queued_at"),
        F.max(F.struct("has_candidates", "created_at", "run_id"))["run_id"].alias("representative_run_id"))


def latest_decision(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("run_id").agg(
        F.max_by("selected_item_id", F.struct("decided_at", "decision_id")).alias("selected_item_id"), F.max("decided_at").alias("decided_at"), F.count(F.lit(1)).alias("decisions"))


def review_fingerprint(queries: DataFrame, results: DataFrame, engine: str, max_candidates: int | None = None) -> DataFrame:
    """Unresolved searches once per (scope, query, candidate fingerprint), with how often they came.

    ``queries``: query_id, scope, query_text. The fingerprint covers the ranked candidates shown, all of them unless ``max_candidates`` says otherwise.
    """
    if max_candidates is not None:
        results = results.filter(F.col("result_rank") <= max_candidates)
    shown = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("result_rank", "item_id", "resolution_status"))).alias("c"), F.count_if(F.col("resolution_status") == "resolved").alias("resolved"))
    rows = queries.join(by_shuffle(shown), "query_id", "left").filter("coalesce(resolved, 0) = 0 OR size(c) > 1")
    print_ = F.md5(F.array_join(F.transform(F.coalesce("c", F.array().cast("array<struct<result_rank:int,item_id:string,resolution_status:string>>")), lambda x: F.concat_ws(":", x["item_id"], x["resolution_status"])), ","))
    return rows.select("scope", norm_text("query_text").alias("normalized_query"), F.lit(engine).alias("engine"), print_.alias("fingerprint"), "query_id").groupBy(
        "scope", "normalized_query", "engine", "fingerprint").agg(F.count(F.lit(1)).alias("occurrences"), F.min("query_id").alias("first_query_id"))


def review_report(offers: DataFrame, mapped: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roll-up per source and label, errors): offers without mapping need a decision, decisions must fit.

    ``offers``: source_key, label, external_record_id; ``mapped``: source_key, external_record_id;
    ``decisions``: source_key, label_key, expected_record_count, action.
    """
    rest = offers.join(mapped.select("source_key", "external_record_id"), ["source_key", "external_record_id"], "left_anti").withColumn("label_key", norm_text("label"))
    per = rest.groupBy("source_key", "label_key").agg(F.count(F.lit(1)).alias("records"), F.min("label").alias("label"))
    joined = per.join(decisions, ["source_key", "label_key"], "full_outer")
    problem = F.when(F.col("action").isNull(), "missing_decision").when(F.col("records").isNull(), "stale_decision").when(
        F.col("records") != F.col("expected_record_count"), "count_mismatch")
    judged = joined.withColumn("problem", problem)
    return (judged.filter("problem IS NULL").groupBy("source_key", "action").agg(F.count(F.lit(1)).alias("labels"), F.sum("records").alias("records")),
            judged.filter("problem IS NOT NULL").select("source_key", "label_key", "problem"))


def context_signature(raw_text, context) -> Column:
    """Signature of a label with its kept clinical context (JSON text)."""
    return F.sha2(F.concat_ws("\u001f", F.coalesce(raw_text, F.lit("")), F.coalesce(content_hash(context), F.lit(""))), 256)


def label_memory(reviewed: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, scope errors): context signatures per reviewed (provider, label, item).

    ``reviewed``: provider_id, label, item_id, raw_text, context; ``expected``: provider_id, label,
    item_id, expected_rows. Signatures stay in long form.
    """
    keyed = reviewed.withColumn("signature", context_signature("raw_text", "context"))
    counts = keyed.groupBy("provider_id", "label", "item_id").agg(F.count(F.lit(1)).alias("rows"))
    checked = expected.join(counts, ["provider_id", "label", "item_id"], "left").fillna({"rows": 0})
    fine = checked.filter("rows = expected_rows").select("provider_id", "label", "item_id")
    rules = keyed.groupBy("provider_id", "label", "item_id", "signature").agg(F.count(F.lit(1)).alias("historical_rows")).join(
        fine, ["provider_id", "label", "item_id"], "left_semi")
    return rules, checked.filter("rows <> expected_rows").select("provider_id", "label", "item_id", "expected_rows", "rows")


def plan_reuse(rows: DataFrame, rules: DataFrame, aliases: DataFrame) -> DataFrame:
    """One of eleven outcomes per queue row, by context equality and candidate uniqueness.

    ``rows``: run_id, input_type, provider_id, raw_text, normalized_input, context, has_patient_data,
    has_unknown_fields. ``aliases``: label, item_id, alias_scope, provider_id (approved).
    """
    r = rows.withColumns({
        "label": norm_text(F.coalesce(F.nullif("raw_text", F.lit("")), "normalized_input")), "signature": context_signature("raw_text", "context")})
    everywhere = aliases.filter("alias_scope = 'global'").select("label", "item_id").distinct()
    own = aliases.filter("alias_scope <> 'global'").select("label", "provider_id", "item_id").distinct()
    asked = r.select("label", "provider_id").distinct()
    candidates = asked.join(everywhere, "label").unionByName(asked.join(own, ["label", "provider_id"])).distinct().groupBy("label", "provider_id").agg(
        F.count(F.lit(1)).alias("candidates"))
    known = rules.groupBy("provider_id", "label").agg(F.count(F.lit(1)).alias("known"))
    same = rules.groupBy("provider_id", "label", "signature").agg(F.count_distinct("item_id").alias("items"), F.min("item_id").alias("rule_item"))
    j = r.join(candidates, ["label", "provider_id"], "left").join(known, ["provider_id", "label"], "left").join(same, ["provider_id", "label", "signature"], "left")
    outcome = (
        F.when(F.col("input_type") != "crawler", "unsupported_input")
        .when(F.col("provider_id").isNull() | (F.col("label") == ""), "incomplete_input")
        .when((F.coalesce("normalized_input", F.lit("")) != "") & (F.col("label") != F.col("normalized_input")), "input_normalization_changed")
        .when(F.col("has_patient_data"), "unsupported_patient_context").when(F.col("has_unknown_fields"), "unrecognized_source_fields")
        .when(F.col("candidates") > 1, "ambiguous_approved_alias").when(F.col("items") == 1, "reusable_exact_context")
        .when(F.col("items") > 1, "ambiguous_context").when(F.col("known") > 0, "source_context_changed")
        .when(F.col("candidates") == 1, "candidate_from_shared_catalog").otherwise("needs_source_evidence"))
    return j.select("run_id", "provider_id", "label", outcome.alias("outcome"), F.when(outcome == "reusable_exact_context", F.col("rule_item")).alias("planned_item_id"))


def research_tasks(plan: DataFrame) -> DataFrame:
    """Research work grouped by (provider, label, outcome)."""
    return plan.filter("outcome <> 'reusable_exact_context'").groupBy("provider_id", "label", "outcome").agg(F.count(F.lit(1)).alias("occurrences"))


def research_queue(tasks: DataFrame, signatures: DataFrame, holds: DataFrame, as_of) -> DataFrame:
    """State of each task: held while a hold is in time and covers exactly the signatures seen now.

    ``signatures`` / ``holds``: provider_id, label, signature in long form; holds add valid_until.
    Set equality is two anti-joins reduced to counts, so no set is ever collected.
    """
    key = ["provider_id", "label"]
    now = signatures.select(*key, "signature").distinct()
    valid = holds.filter(F.col("valid_until") > F.lit(as_of).cast("timestamp_ntz")).select(*key, "signature").distinct()
    match = now.withColumn("a", F.lit(1)).join(valid.withColumn("b", F.lit(1)), [*key, "signature"], "full_outer").groupBy(*key).agg(
        F.count("b").alias("held"), F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("equal"))
    j = tasks.join(match, key, "left")
    state = F.when(F.coalesce("held", F.lit(0)) == 0, "ready").when(F.col("equal"), "held").otherwise("hold_outdated")
    return j.select(*key, "outcome", "occurrences", state.alias("state"))


def alias_collisions(batch: DataFrame, names: DataFrame, aliases: DataFrame, disambiguation: DataFrame) -> DataFrame:
    """(alias, provider_id, kind) of proposed aliases that repeat or meet another item's term."""
    b = batch.withColumn("nt", norm_text("alias"))
    repeated = b.groupBy("nt", "provider_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("nt", "provider_id", F.lit("duplicate_scope").alias("kind"))
    def other(rows: DataFrame, kind: str) -> DataFrame:
        owner = rows.groupBy("nt").agg(F.min("item_id").alias("lo"), F.max("item_id").alias("hi"))
        return b.join(owner, "nt").filter((F.col("lo") != F.col("item_id")) | (F.col("hi") != F.col("item_id"))).select("nt", "provider_id", F.lit(kind).alias("kind"))
    return (
        repeated.unionByName(other(names.select(norm_text("name").alias("nt"), "item_id"), "other_name"))
        .unionByName(other(aliases.filter("status = 'approved'").select(norm_text("alias").alias("nt"), "item_id"), "other_alias"))
        .unionByName(b.join(disambiguation.select(norm_text("term").alias("nt")).distinct(), "nt", "left_semi").select("nt", "provider_id", F.lit("disambiguation").alias("kind")))
        .distinct())


def review_scope_check(current: DataFrame, snapshot: DataFrame, groups: DataFrame) -> DataFrame:
    """(kind, key, n) of a review scope that does not add up.

    ``current`` / ``snapshot``: run_id, label, provider_id, row_hash, guard_value; ``groups``: label, provider_id, expected_rows.
    """
    key = ["label", "provider_id"]
    changed = current.select("run_id", "row_hash").join(snapshot.select("run_id", F.col("row_hash").alias("old")), "run_id").filter("row_hash <> old").agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("changed_rows").alias("kind"), F.lit("").alias("key"), "n")
    per = current.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("guard_value").alias("guards"))
    j = groups.join(per, key, "left").fillna({"rows": 0, "guards": 0})
    wrong = j.filter("rows <> expected_rows").select(F.lit("row_count").alias("kind"), F.concat_ws("|", *key).alias("key"), F.col("rows").alias("n"))
    mixed = j.filter("guards > 1").select(F.lit("mixed_guard").alias("kind"), F.concat_ws("|", *key).alias("key"), F.col("guards").alias("n"))
    twice = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("repeated_group").alias("kind"), F.concat_ws("|", *key).alias("key"), "n")
    uncovered = per.join(groups, key, "left_anti").select(F.lit("uncovered").alias("kind"), F.concat_ws("|", *key).alias("key"), F.col("rows").alias("n"))
    return changed.filter("n > 0").unionByName(wrong).unionByName(mixed).unionByName(twice).unionByName(uncovered)


def review_ledger(expected: DataFrame, applied: DataFrame) -> DataFrame:
    """already_applied, not_applied or differs per review, from expected and applied counts."""
    done = applied.groupBy("review_id").agg(F.count(F.lit(1)).alias("applied"))
    j = expected.join(done, "review_id", "left").fillna({"applied": 0})
    state = F.when(F.col("applied") == F.col("expected_rows"), "already_applied").when(F.col("applied") == 0, "not_applied").otherwise("differs")
    return j.withColumn("state", state)


def catalog_lookup(items: DataFrame, names: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Active items whose name equals or contains the text, exact ones first."""
    wanted = norm_text(F.lit(text))
    rows = names.join(items.filter("status = 'active'").select("item_id"), "item_id", "left_semi").withColumn("nt", norm_text("name")).filter(F.contains("nt", wanted))
    per = best_by(rows, ["item_id"], [F.col("nt") != wanted, F.col("nt")], ["name", (F.col("nt") == wanted).alias("exact")])
    ordered = per.orderBy(F.desc("exact"), "name", "item_id")
    return ordered if limit is None else ordered.limit(limit)
