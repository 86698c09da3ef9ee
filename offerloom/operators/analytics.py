"""Click and usage metrics, dashboards, gates, corpus evaluation and backlog reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import by_shuffle

# Link types, surfaces and event names that are accepted, and metadata rules.
LINK_TYPES, SURFACES = ["booking", "study", "location", "provider"], ["web", "pwa", "android", "ios"]
EVENT_NAMES = ["consent_granted", "search_completed", "package_resolved", "package_resolved_from_image", "provider_contact_clicked", "pwa_installed"]
METADATA_KEYS = ["result_count", "item_count", "status", "review_required", "surface"]
EVENT_STATUS = ["ready", "partial", "needs_clarification", "no_match"]
# Actions that expect a resolution.
RESOLUTION_ACTIONS = ["resolve", "resolve_plus_preparation"]


def valid_clicks(clicks: DataFrame, offers: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason) clicks: active offer, same item and brand, a branch of the brand, known link and surface."""
    known = offers.filter("status = 'active'").select("offer_id", F.col("item_id").alias("oi"), F.col("provider_id").alias("op"))
    places = locations.filter(F.col("status").isin("active", "temporarily_closed")).select("location_id", F.col("provider_id").alias("lp"))
    j = clicks.join(known, "offer_id", "left").join(places, "location_id", "left")
    reason = (
        F.when(F.col("oi").isNull(), "unknown_offer").when(~F.col("oi").eqNullSafe(F.col("item_id")) | ~F.col("op").eqNullSafe(F.col("provider_id")), "offer_mismatch")
        .when(F.col("location_id").isNotNull() & ~F.coalesce(F.col("lp") == F.col("op"), F.lit(False)), "location_mismatch")
        .when(~F.coalesce(F.col("link_type").isin(*LINK_TYPES), F.lit(False)), "link_type").when(~F.coalesce(F.col("surface").isin(*SURFACES), F.lit(False)), "surface"))
    judged = j.withColumn("reason", reason).drop("oi", "op", "lp")
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def click_metrics(clicks: DataFrame) -> dict[str, DataFrame]:
    """Summary, daily, by service, by location and by link type; visitors are exact distinct counts."""
    total = F.count(F.lit(1)).alias("clicks")
    visitors = F.count_distinct("anonymous_id").alias("unique_visitors")
    return {
        "summary": clicks.agg(
            F.count(F.lit(1)).alias("total_clicks"), visitors, F.count_if(F.col("link_type") == "booking").alias("booking_clicks"),
            F.count_distinct("item_id").alias("services_with_clicks"), F.count_distinct("location_id").alias("locations_with_clicks")),
        "daily": clicks.groupBy(F.to_date("occurred_at").alias("day")).agg(total),
        "by_service": clicks.groupBy("item_id", "provider_id").agg(total, visitors),
        "by_location": clicks.groupBy("location_id", "provider_id").agg(total, visitors),
        "by_link_type": clicks.groupBy("link_type").agg(total),
    }


def scoped_clicks(clicks: DataFrame, memberships: DataFrame, organization_brands: DataFrame, as_of) -> DataFrame:
    """(user_id, click) rows a member may see: brand, location or organization grants valid on a day.

    Memberships are expanded to (user, brand) and (user, location) grants and de-duplicated first.
    """
    on = F.lit(as_of).cast("date")
    live = memberships.filter((F.col("status") == "active") & (F.col("valid_from") <= on) & (F.col("valid_to").isNull() | (F.col("valid_to") >= on)))
    brands = live.filter("scope_type = 'brand'").select("user_id", "provider_id").unionByName(
        live.filter("scope_type = 'organization'").join(organization_brands, "organization_id").select("user_id", organization_brands["provider_id"])).distinct()
    places = live.filter("scope_type = 'location'").select("user_id", "location_id").distinct()
    by_brand = clicks.join(brands, "provider_id").select("user_id", *clicks.columns)
    by_place = clicks.join(places, "location_id").select("user_id", *clicks.columns)
    seen = by_place.join(brands, ["user_id", "provider_id"], "left_anti").select("user_id", *clicks.columns)
    return by_brand.unionByName(seen)


def usage_totals(events: DataFrame) -> DataFrame:
    """Requests per (day, action)."""
    return events.groupBy(F.to_date("occurred_at").alias("day"), "action").agg(F.count(F.lit(1)).alias("requests"))


def usage_report(totals: DataFrame, last_day, days: int) -> DataFrame:
    """Window report over daily totals: per action requests, active days and the busiest day."""
    end = F.lit(last_day).cast("date")
    rows = totals.filter((F.col("day") <= end) & (F.col("day") > F.date_sub(end, days)))
    return rows.groupBy("action").agg(
        F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("active_days"), F.max_by("day", F.struct("requests", "day")).alias("busiest_day"))


def apply_retention(rows: DataFrame, as_of, column: str = "retention_until") -> DataFrame:
    """Rows still within retention (an instant equal to the limit is already out)."""
    return rows.filter(F.col(column) > F.lit(as_of).cast("timestamp_ntz"))


def event_contract(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) anonymous events: anonymous_id, event_name, metadata JSON text."""
    meta = F.coalesce("metadata", F.lit("{}"))
    v = F.try_parse_json(meta)
    keys = F.json_object_keys(meta)

    def kind(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))

    def text(key: str) -> Column:
        return F.get_json_object(meta, f"$.{key}")

    def count_bad(key: str) -> Column:
        return F.array_contains(keys, key) & ~F.coalesce((kind(key) == "BIGINT") & text(key).try_cast("bigint").between(0, 1000), F.lit(False))

    def listed_bad(key: str, values) -> Column:
        return F.array_contains(keys, key) & ~F.coalesce((kind(key) == "STRING") & text(key).isin(*values), F.lit(False))

    reason = (
        F.when(F.col("anonymous_id").isNull(), "anonymous_id").when(~F.coalesce(F.col("event_name").isin(*EVENT_NAMES), F.lit(False)), "event_name")
        .when(keys.isNull() | (F.octet_length(meta) > 2048), "metadata")
        .when(F.exists(keys, lambda k: ~k.isin(*METADATA_KEYS)), "metadata_key")
        .when(count_bad("result_count") | count_bad("item_count"), "count").when(listed_bad("status", EVENT_STATUS), "status")
        .when(F.array_contains(keys, "review_required") & ~F.coalesce(kind("review_required") == "BOOLEAN", F.lit(False)), "review_required")
        .when(listed_bad("surface", SURFACES), "surface"))
    judged = events.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def metrics_table(*parts: DataFrame) -> DataFrame:
    """One-row aggregates as (metric, value) rows."""
    long = [p.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in p.columns]))) for p in parts]
    return reduce(DataFrame.unionByName, long)


def ops_dashboard(runs: DataFrame, queue: DataFrame, offers: DataFrame, last: int = 20) -> tuple[DataFrame, DataFrame]:
    """(headline counts, last runs)."""
    counts = metrics_table(
        runs.agg(*[F.count_if(F.col("status") == s).alias(f"runs_{s}") for s in ("succeeded", "failed", "quarantined")]),
        queue.agg(*[F.count_if(F.col("status") == s).alias(f"queue_{s}") for s in ("pending", "ambiguous", "no_match")]),
        offers.agg(F.count_if(F.col("status") == "active").alias("active_offers")))
    return counts, runs.orderBy(F.desc("finished_at"), "run_id").limit(last)


def ops_lookups(brands: DataFrame, locations: DataFrame, offers: DataFrame, scopes: DataFrame, prices: DataFrame) -> DataFrame:
    """Per provider: branches, offers, current prices and the latest sighting."""
    seen = offers.select("offer_id", "provider_id").join(scopes.select("scope_id", "offer_id"), "offer_id").join(prices.filter("is_current").select("scope_id", "last_seen_at"), "scope_id")
    price = seen.groupBy("provider_id").agg(F.count(F.lit(1)).alias("current_prices"), F.max("last_seen_at").alias("last_seen_at"))
    return (
        brands.select("provider_id", "provider_name")
        .join(locations.groupBy("provider_id").agg(F.count(F.lit(1)).alias("locations")), "provider_id", "left")
        .join(offers.groupBy("provider_id").agg(F.count(F.lit(1)).alias("offers")), "provider_id", "left")
        .join(price, "provider_id", "left").fillna(0, ["locations", "offers", "current_prices"]))


def gate_report(items, offers, brands, scopes, prices, locations, runs, queue, as_of, *, min_shared=1, min_shared_priced=1, min_coordinate_pct=95.0) -> tuple[DataFrame, DataFrame]:
    """(metrics, verdict per threshold) of the publication gate."""
    at = F.lit(as_of).cast("timestamp_ntz")
    active = offers.filter("status = 'active'").join(brands.filter("status = 'active'").select("provider_id"), "provider_id", "left_semi")
    shared = active.groupBy("item_id").agg(F.count_distinct("provider_id").alias("b")).filter("b >= 2")
    priced_scope = scopes.filter("status = 'active'").join(prices.filter("is_current AND amount_minor > 0").select("scope_id"), "scope_id", "left_semi").select("offer_id")
    shared_priced = active.join(priced_scope, "offer_id", "left_semi").groupBy("item_id").agg(F.count_distinct("provider_id").alias("b")).filter("b >= 2")
    real = F.col("is_current") & (F.col("amount_minor") > 0)
    located = F.count_if((F.col("status") == "active") & F.col("lat").isNotNull())
    open_places = F.count_if(F.col("status") == "active")
    metrics = metrics_table(
        items.agg(F.count_if(F.col("status") == "active").alias("active_services")), offers.agg(F.count_if(F.col("status") == "active").alias("active_offers")),
        brands.agg(F.count_if(F.col("status") != "closed").alias("provider_brands")),
        prices.agg(F.count_if(real).alias("current_prices"), F.count_if(real & (F.col("last_seen_at") < at - F.make_dt_interval(days=F.lit(30)))).alias("stale_current_prices_30d")),
        shared.agg(F.count(F.lit(1)).alias("shared_services")), shared_priced.agg(F.count(F.lit(1)).alias("shared_priced_services")),
        locations.agg(open_places.alias("active_locations"), located.alias("locations_with_coordinates"),
                      F.coalesce(F.round(located / F.nullif(open_places, F.lit(0)) * 100, 2), F.lit(0.0)).alias("location_coordinate_pct")),
        runs.agg(F.count_if(F.col("status").isin("failed", "quarantined", "partial")).alias("failed_or_quarantined_runs")),
        queue.agg(F.count_if(F.col("status").isin("pending", "ambiguous", "no_match")).alias("normalization_review_queue")))
    limit = (F.when(F.col("metric") == "shared_services", float(min_shared)).when(F.col("metric") == "shared_priced_services", float(min_shared_priced))
             .when(F.col("metric") == "location_coordinate_pct", float(min_coordinate_pct)))
    verdicts = metrics.withColumn("threshold", limit).filter("threshold IS NOT NULL").withColumn("passed", F.col("value") >= F.col("threshold"))
    return metrics, verdicts


def coverage_report(summary: DataFrame) -> DataFrame:
    """Discovery coverage per status over hosts."""
    return summary.groupBy("status").agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("locations").alias("locations"), F.sum("offers").alias("offers"), F.sum("priced_offers").alias("priced_offers"),
        F.count_if(F.col("offers") > 0).alias("hosts_with_offers"))


def evaluate_corpus(expectations: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expected action x actual status, summary, unexpected and missing resolutions).

    ``expectations``: query_id, expected_action, expected_item_id; ``status``: query_id, status, item_id.
    """
    j = expectations.join(by_shuffle(status.select("query_id", "status", "item_id")), "query_id", "left").fillna({"status": "invalid"})
    wanted, resolved = F.col("expected_action").isin(*RESOLUTION_ACTIONS), F.col("status") == "resolved"
    summary = j.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(wanted).alias("resolution_expected"), F.count_if(wanted & resolved).alias("resolved_expected"),
        F.count_if(~wanted & resolved).alias("unexpected_resolved"), F.count_if(wanted & resolved & (F.col("item_id") != F.col("expected_item_id"))).alias("wrong_item"))
    ids = j.filter((wanted & ~resolved) | (~wanted & resolved)).select("query_id", F.when(wanted, "unresolved_expected").otherwise("unexpected_resolved").alias("kind"))
    return j.groupBy("expected_action", "status").agg(F.count(F.lit(1)).alias("n")), summary, ids


def regression_diff(before: DataFrame, after: DataFrame, weights: DataFrame, forbidden: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weighted transitions, changed cases, forbidden resolutions) of two resolver runs.

    ``before`` / ``after``: case_id, status, item_id; ``weights``: case_id, rows; ``forbidden``: case_id, item_id.
    """
    j = before.withColumnsRenamed({"status": "before_status", "item_id": "before_item"}).join(
        after.withColumnsRenamed({"status": "after_status", "item_id": "after_item"}), "case_id", "full_outer").join(weights, "case_id", "left").fillna({"rows": 1})
    transitions = j.groupBy("before_status", "after_status").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("cases"))
    changed = j.filter(~F.col("before_status").eqNullSafe(F.col("after_status")) | ~F.col("before_item").eqNullSafe(F.col("after_item")))
    bad = after.filter("status = 'resolved'").join(forbidden, ["case_id", "item_id"], "left_semi").select("case_id", "item_id")
    return transitions, changed, bad


def backlog_reports(queue: DataFrame) -> dict[str, DataFrame]:
    """Backlog by status, identifier origin, source policy and SKU/label cardinality (queue rows with
    provider_id, normalized_input, provider_sku, status, policy)."""
    by_sku = queue.filter("provider_sku IS NOT NULL").groupBy("provider_id", "provider_sku").agg(F.count_distinct("normalized_input").alias("labels"))
    by_label = queue.groupBy("provider_id", "normalized_input").agg(F.count_distinct("provider_sku").alias("skus"))
    return {
        "status": queue.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct("provider_id", "normalized_input")).alias("groups")),
        "sku_labels": by_sku.groupBy("labels").agg(F.count(F.lit(1)).alias("skus")),
        "label_skus": by_label.groupBy("skus").agg(F.count(F.lit(1)).alias("labels")),
        "policy": queue.groupBy("policy").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct("provider_id", "normalized_input")).alias("groups"),
                                              F.count_if(F.col("provider_sku").isNotNull()).alias("with_sku")),
    }


def cohort_summary(testers: DataFrame, as_of, length_days: int = 14) -> DataFrame:
    """Testers per status and the day of the test (clamped to its length) per cohort."""
    day = F.least(F.greatest(F.date_diff(F.lit(as_of).cast("date"), F.min("started_on")) + 1, F.lit(0)), F.lit(length_days))
    return testers.groupBy("cohort").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("invited", "active", "withdrawn")], F.count(F.lit(1)).alias("total"), day.cast("bigint").alias("test_day"))
