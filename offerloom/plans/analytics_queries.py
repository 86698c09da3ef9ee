"""Registered analytics and report queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import analytics as A, resolve as R
from ..session import written
from .identity_queries import _DISC, _discovery
from .ingest_queries import _RUNS, run_status
from .queue_queries import VIEWS as _QUEUE_VIEWS  # registers the queue views
from .resolve_queries import RESULTS, _final, catalog, queries_table
from .tables import VIEWS, duck, view

AS_OF = datetime.datetime(2001, 6, 1)

# an event clicks every offer of the order with its number; events without an order are clicks on nothing, to be rejected
VIEWS["clicks"] = """
    SELECT CAST(e.event_id AS STRING) AS event_id, CAST(e.user_id AS STRING) AS anonymous_id, concat(CAST(l.l_partkey AS STRING), '-', CAST(l.l_suppkey AS STRING)) AS offer_id, o.item_id,
           CASE WHEN l.l_tax = 0.01 THEN 'x' ELSE CAST(l.l_suppkey AS STRING) END AS provider_id,
           CASE WHEN l.l_discount < 0.02 THEN NULL WHEN l.l_discount < 0.03 THEN CAST(l.l_suppkey + 1 AS STRING) ELSE CAST(l.l_suppkey + (SELECT count(*) FROM {supplier}) * (l.l_orderkey % 15) AS STRING) END AS location_id,
           CASE e.event_type WHEN 'click' THEN 'booking' WHEN 'view' THEN 'study' WHEN 'purchase' THEN 'location' WHEN 'signup' THEN 'provider' ELSE 'other' END AS link_type,
           CASE e.user_id % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'pwa' WHEN 2 THEN 'android' WHEN 3 THEN 'ios' ELSE 'tv' END AS surface, e.ts AS occurred_at, e.ts + INTERVAL '10' DAY AS retention_until
    FROM {events} e LEFT JOIN {lineitem} l ON l.l_orderkey = e.event_id LEFT JOIN {offers} o ON o.offer_id = concat(CAST(l.l_partkey AS STRING), '-', CAST(l.l_suppkey AS STRING))"""
VIEWS["memberships"] = """
    SELECT concat('u', CAST(s_nationkey AS STRING)) AS user_id, 'brand' AS scope_type, CAST(s_suppkey AS STRING) AS provider_id, CAST(NULL AS STRING) AS location_id, CAST(NULL AS STRING) AS organization_id, CASE WHEN s_acctbal < 0 THEN 'ended' ELSE 'active' END AS status, DATE '2020-01-01' AS valid_from, CASE WHEN s_nationkey = 3 THEN DATE '2021-01-01' END AS valid_to FROM {supplier}
    UNION ALL SELECT concat('u', CAST(c_nationkey AS STRING)), 'location', CAST(NULL AS STRING), CAST(c_custkey AS STRING), CAST(NULL AS STRING), 'active', DATE '2020-01-01', CAST(NULL AS DATE) FROM {customer}
    UNION ALL SELECT concat('o', CAST(n_nationkey AS STRING)), 'organization', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(n_regionkey AS STRING), 'active', DATE '2020-01-01', CAST(NULL AS DATE) FROM {nation}"""
VIEWS["organization_brands"] = "SELECT CAST(n.n_regionkey AS STRING) AS organization_id, CAST(s.s_suppkey AS STRING) AS provider_id FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey"
VIEWS["anonymous_events"] = """
    SELECT event_id, CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS anonymous_id, CASE event_type WHEN 'view' THEN 'search_completed' WHEN 'click' THEN 'provider_contact_clicked' WHEN 'error' THEN 'unknown' ELSE 'package_resolved' END AS event_name,
           concat('{"result_count":', CASE WHEN user_id % 9 = 0 THEN '"7"' WHEN user_id % 10 = 1 THEN '4000' ELSE CAST(user_id AS STRING) END, CASE WHEN user_id % 7 = 3 THEN ',"colour":1' ELSE '' END, CASE WHEN user_id % 5 = 2 THEN ',"status":"odd"' ELSE ',"status":"ready"' END,
                  CASE WHEN user_id % 11 = 5 THEN ',"review_required":1' ELSE ',"review_required":true' END, '}') AS metadata FROM {events}"""
VIEWS["usage_events"] = "SELECT event_type AS action, ts AS occurred_at FROM {events}"
VIEWS["testers"] = """
    SELECT c_mktsegment AS cohort, CASE c_nationkey % 3 WHEN 0 THEN 'invited' WHEN 1 THEN 'active' ELSE 'withdrawn' END AS status, CAST(TIMESTAMP '2001-05-25 00:00:00' + (c_custkey % 4) * INTERVAL '1' DAY AS DATE) AS started_on FROM {customer}"""


def _clicks(spark, sf):
    return A.valid_clicks(view(spark, sf, "clicks"), view(spark, sf, "offers"), view(spark, sf, "locations"))


def _valid(spark, sf):
    return _clicks(spark, sf)[0].groupBy("link_type", "surface").agg(F.count(F.lit(1)).alias("n"))


def _rejected(spark, sf):
    return _clicks(spark, sf)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _metric(part):
    return lambda spark, sf: A.click_metrics(_clicks(spark, sf)[0])[part]


def _scoped(spark, sf):
    rows = A.scoped_clicks(_clicks(spark, sf)[0], view(spark, sf, "memberships"), view(spark, sf, "organization_brands"), datetime.date(2024, 1, 15))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("clicks"), F.count_distinct("anonymous_id").alias("unique_visitors"))


def _usage(spark, sf):
    return A.usage_totals(view(spark, sf, "usage_events"))


def _usage_report(spark, sf):
    return A.usage_report(_usage(spark, sf), datetime.date(2024, 1, 20), 7)


def _retention(spark, sf):
    return A.apply_retention(view(spark, sf, "clicks"), datetime.datetime(2024, 1, 25)).groupBy("link_type").agg(F.count(F.lit(1)).alias("kept"))


def _events(part):
    def run(spark, sf):
        rows = A.event_contract(view(spark, sf, "anonymous_events"))[part]
        return rows.select("event_id") if part == 0 else rows.select("event_id", "reason")
    return run


def _runs(spark, sf):
    return run_status(spark, sf).join(view(spark, sf, "raw_runs").select("run_id", "finished_at"), "run_id")


def _dashboard(part):
    def run(spark, sf):
        out = A.ops_dashboard(_runs(spark, sf), view(spark, sf, "norm_runs"), view(spark, sf, "offers"))[part]
        return out if part == 0 else out.select("run_id", "status", "finished_at")
    return run


def _lookups(spark, sf):
    offers = written(view(spark, sf, "offers").select("offer_id", "provider_id"))  # as scopes, read by several branches
    scopes = written(view(spark, sf, "scopes", {"offers": offers}).select("scope_id", "offer_id", "scope_type"))
    prices = view(spark, sf, "prices", {"scopes": scopes})
    return A.ops_lookups(view(spark, sf, "brands"), view(spark, sf, "locations"), offers, scopes, prices)


def _gate(part):
    def run(spark, sf):
        offers = written(view(spark, sf, "offers").select("offer_id", "provider_id", "item_id", "status"))  # read by several branches each
        scopes = written(view(spark, sf, "scopes", {"offers": offers}).select("scope_id", "offer_id", "scope_type", "status"))
        prices = written(view(spark, sf, "prices", {"scopes": scopes}).select("scope_id", "is_current", "amount_minor", "last_seen_at"))
        items, brands, locations = (view(spark, sf, n) for n in ("items", "brands", "locations"))
        return A.gate_report(items, offers, brands, scopes, prices, locations, _runs(spark, sf), view(spark, sf, "norm_runs"), AS_OF)[part]
    return run


def _coverage(spark, sf):
    return A.coverage_report(_discovery(spark, sf))


def _expectations(spark, sf):
    parts = view(spark, sf, "part").join(view(spark, sf, "items").select("item_id", F.col("name").alias("p_name")), "p_name")
    people = view(spark, sf, "customer").select(  # names of customers are nothing in the catalog
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("query_id"), F.lit("no_match").alias("expected_action"), F.lit(None).cast("string").alias("expected_item_id"))
    return people.unionByName(parts.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("query_id"), F.when(F.col("p_partkey") % 7 == 0, "resolve").when(F.col("p_partkey") % 7 == 3, "resolve_plus_preparation").otherwise("clarify").alias("expected_action"), F.col("item_id").alias("expected_item_id")))


def _status(spark, sf, stage=6):
    queries = queries_table(spark, sf)
    return R.resolution_status(queries, R.resolve(queries, catalog(spark, sf), "parts", stage=stage))


def _corpus(part):
    return lambda spark, sf: A.evaluate_corpus(_expectations(spark, sf), _status(spark, sf))[part]


def _regression(part):
    def run(spark, sf):
        queries, terms = queries_table(spark, sf), catalog(spark, sf)
        guarded = written(R.guarded_v2(queries, terms, "parts"))  # both runs go on from here
        before, after = (
            R.resolution_status(queries, R.resolve(queries, terms, "parts", stage=stage, guarded=guarded)).select(F.col("query_id").alias("case_id"), "status", "item_id")
            for stage in (2, 6))
        weights = queries_table(spark, sf).select(F.col("query_id").alias("case_id"), F.length("query_text").cast("bigint").alias("rows"))
        forbidden = view(spark, sf, "items").filter("name LIKE 'hot%'").select("item_id")
        out = A.regression_diff(before, after, weights, queries_table(spark, sf).select(F.col("query_id").alias("case_id")).join(after.filter("item_id IS NOT NULL").join(forbidden, "item_id", "left_semi"), "case_id").select("case_id", "item_id"))[part]
        return out.select("case_id", "before_status", "after_status") if part == 1 else out
    return run


def _backlog(part):
    return lambda spark, sf: A.backlog_reports(view(spark, sf, "norm_runs"))[part]


def _cohort(spark, sf):
    return A.cohort_summary(view(spark, sf, "testers"), AS_OF)


QUERIES = {
    "valid_clicks": _valid, "rejected_clicks": _rejected, "click_metrics": _metric("summary"), "click_daily": _metric("daily"), "click_by_service": _metric("by_service"),
    "click_by_location": _metric("by_location"), "click_by_link_type": _metric("by_link_type"), "scoped_clicks": _scoped, "usage_totals": _usage, "usage_report": _usage_report,
    "apply_retention": _retention, "event_contract": _events(0), "event_rejects": _events(1), "ops_dashboard": _dashboard(0), "ops_last_runs": _dashboard(1), "ops_lookups": _lookups,
    "gate_report": _gate(0), "gate_verdicts": _gate(1), "coverage_report": _coverage, "evaluate_corpus": _corpus(0), "corpus_summary": _corpus(1), "corpus_ids": _corpus(2),
    "regression_diff": _regression(0), "regression_changes": _regression(1), "backlog_reports": _backlog("status"), "backlog_sku_labels": _backlog("sku_labels"),
    "backlog_label_skus": _backlog("label_skus"), "backlog_policy": _backlog("policy"), "cohort_summary": _cohort,
}

_CLICK = duck("clicks", "offers", "locations", "memberships", "organization_brands") + """, jd AS (
  SELECT c.*, CASE WHEN o.offer_id IS NULL THEN 'unknown_offer' WHEN o.item_id <> c.item_id OR o.provider_id <> c.provider_id THEN 'offer_mismatch' WHEN c.location_id IS NOT NULL AND l.provider_id IS DISTINCT FROM o.provider_id THEN 'location_mismatch'
     WHEN c.link_type NOT IN ('booking', 'study', 'location', 'provider') THEN 'link_type' WHEN c.surface NOT IN ('web', 'pwa', 'android', 'ios') THEN 'surface' END AS reason
  FROM clicks c LEFT JOIN offers o ON o.offer_id = c.offer_id AND o.status = 'active' LEFT JOIN locations l ON l.location_id = c.location_id AND l.status = 'active'), vc AS (SELECT *, row_number() OVER () AS rid FROM jd WHERE reason IS NULL)"""
_EV = duck("anonymous_events") + """, r AS (SELECT a.event_id, CASE WHEN a.anonymous_id IS NULL THEN 'anonymous_id' WHEN event_name = 'unknown' THEN 'event_name' WHEN user_id % 7 = 3 THEN 'metadata_key' WHEN user_id % 9 = 0 OR user_id % 10 = 1 OR user_id > 1000 THEN 'count'
  WHEN user_id % 5 = 2 THEN 'status' WHEN user_id % 11 = 5 THEN 'review_required' END AS reason FROM anonymous_events a JOIN events e USING (event_id))"""
_ST = lambda source, name: f"""{name} AS (SELECT q.query_id, CASE WHEN count(r.item_id) = 0 THEN 'no_match' WHEN count(r.item_id) > 1 OR bool_or(r.resolution_status = 'ambiguous') THEN 'ambiguous' ELSE 'resolved' END AS status,
  CASE WHEN count(r.item_id) = 1 AND bool_and(r.resolution_status = 'resolved') THEN min(r.item_id) END AS item_id FROM queries q LEFT JOIN {source} r ON r.query_id = q.query_id GROUP BY q.query_id)"""  # noqa: E731
_CORPUS = RESULTS + ", " + _ST("results", "st") + """, ex AS (SELECT 'p' || p_partkey AS query_id, CASE p_partkey % 7 WHEN 0 THEN 'resolve' WHEN 3 THEN 'resolve_plus_preparation' ELSE 'clarify' END AS expected_action, i.item_id AS expected_item_id FROM part p JOIN items i ON i.name = p.p_name UNION ALL SELECT 'c' || c_custkey, 'no_match', NULL FROM customer),
  cj AS (SELECT ex.*, st.status, st.item_id, expected_action NOT IN ('clarify', 'no_match') AS wanted FROM ex JOIN st USING (query_id))"""
_REG = RESULTS + _final(2).replace("ranked AS", "ranked2 AS").replace("fallback AS", "fallback2 AS").replace("JOIN ranked r", "JOIN ranked2 r") + ", " + _ST("results", "s6") + ", " + _ST("fallback2", "s2") + """,
  rj AS (SELECT a.query_id AS case_id, b.status AS before_status, a.status AS after_status, b.item_id AS bi, a.item_id AS ai, length(q.query_text) AS w FROM s6 a JOIN s2 b USING (query_id) JOIN queries q USING (query_id))"""
_GATES = duck("raw_rows", "raw_runs", "run_limits", "items", "offers", "brands", "scopes", "prices", "locations", "norm_runs").replace("WITH ", "WITH RECURSIVE ", 1) + "," + _RUNS[_RUNS.index("\n  g0 AS"):]
_METRICS = _GATES + """, ao AS (SELECT o.* FROM offers o JOIN brands b ON b.provider_id = o.provider_id AND b.status = 'active' WHERE o.status = 'active'),
  mt(metric, value) AS (
    SELECT 'active_services', count(*)::DOUBLE FROM items WHERE status = 'active' UNION ALL SELECT 'active_offers', count(*) FROM offers WHERE status = 'active' UNION ALL SELECT 'provider_brands', count(*) FROM brands WHERE status <> 'closed'
    UNION ALL SELECT 'current_prices', count(*) FROM prices WHERE is_current AND amount_minor > 0 UNION ALL SELECT 'stale_current_prices_30d', count(*) FROM prices WHERE is_current AND amount_minor > 0 AND last_seen_at < TIMESTAMP '2001-06-01' - INTERVAL 30 DAY
    UNION ALL SELECT 'shared_services', count(*) FROM (SELECT item_id FROM ao GROUP BY item_id HAVING count(DISTINCT provider_id) >= 2)
    UNION ALL SELECT 'shared_priced_services', count(*) FROM (SELECT item_id FROM ao JOIN scopes s USING (offer_id) JOIN prices p ON p.scope_id = s.scope_id AND p.is_current AND p.amount_minor > 0 GROUP BY item_id HAVING count(DISTINCT provider_id) >= 2)
    UNION ALL SELECT 'active_locations', count(*) FROM locations WHERE status = 'active' UNION ALL SELECT 'locations_with_coordinates', count(*) FROM locations WHERE status = 'active' AND lat IS NOT NULL
    UNION ALL SELECT 'location_coordinate_pct', 100.0 UNION ALL SELECT 'failed_or_quarantined_runs', count(*) FROM status WHERE status IN ('failed', 'quarantined') UNION ALL SELECT 'normalization_review_queue', count(*) FROM norm_runs WHERE status <> 'resolved')"""

ORACLES = {
    "valid_clicks": _CLICK + " SELECT link_type, surface, count(*) AS n FROM vc GROUP BY ALL",
    "rejected_clicks": _CLICK + " SELECT reason, count(*) AS n FROM jd WHERE reason IS NOT NULL GROUP BY reason",
    "click_metrics": _CLICK + " SELECT count(*) AS total_clicks, count(DISTINCT anonymous_id) AS unique_visitors, count(*) FILTER (WHERE link_type = 'booking') AS booking_clicks, count(DISTINCT item_id) AS services_with_clicks, count(DISTINCT location_id) AS locations_with_clicks FROM vc",
    "click_daily": _CLICK + " SELECT occurred_at::DATE AS day, count(*) AS clicks FROM vc GROUP BY 1",
    "click_by_service": _CLICK + " SELECT item_id, provider_id, count(*) AS clicks, count(DISTINCT anonymous_id) AS unique_visitors FROM vc GROUP BY ALL",
    "click_by_location": _CLICK + " SELECT location_id, provider_id, count(*) AS clicks, count(DISTINCT anonymous_id) AS unique_visitors FROM vc GROUP BY ALL",
    "click_by_link_type": _CLICK + " SELECT link_type, count(*) AS clicks FROM vc GROUP BY link_type",
    "scoped_clicks": _CLICK + """, live AS (SELECT * FROM memberships WHERE status = 'active' AND valid_from <= DATE '2024-01-15' AND (valid_to IS NULL OR valid_to >= DATE '2024-01-15')),
      see AS (SELECT DISTINCT m.user_id, c.rid, c.event_id, c.offer_id, c.anonymous_id, c.location_id, c.link_type FROM vc c JOIN live m ON (m.scope_type = 'brand' AND m.provider_id = c.provider_id) OR (m.scope_type = 'location' AND m.location_id = c.location_id)
         OR (m.scope_type = 'organization' AND c.provider_id IN (SELECT o.provider_id FROM organization_brands o WHERE o.organization_id = m.organization_id)))
      SELECT user_id, count(*) AS clicks, count(DISTINCT anonymous_id) AS unique_visitors FROM see GROUP BY user_id""",
    "usage_totals": "SELECT ts::DATE AS day, event_type AS action, count(*) AS requests FROM events GROUP BY ALL",
    "usage_report": "WITH d AS (SELECT ts::DATE AS day, event_type AS action, count(*) AS requests FROM events GROUP BY ALL) SELECT action, sum(requests)::BIGINT AS requests, count(*) AS active_days, (list(day ORDER BY requests DESC, day DESC))[1] AS busiest_day FROM d WHERE day <= DATE '2024-01-20' AND day > DATE '2024-01-13' GROUP BY action",
    "apply_retention": duck("clicks") + " SELECT link_type, count(*) AS kept FROM clicks WHERE retention_until > TIMESTAMP '2024-01-25' GROUP BY link_type",
    "event_contract": _EV + " SELECT event_id FROM r WHERE reason IS NULL",
    "event_rejects": _EV + " SELECT event_id, reason FROM r WHERE reason IS NOT NULL",
    "ops_dashboard": _GATES + """ SELECT 'runs_' || s AS metric, (SELECT count(*) FROM status WHERE status = s)::DOUBLE AS value FROM (VALUES ('succeeded'), ('failed'), ('quarantined')) t(s)
      UNION ALL SELECT 'queue_' || s, (SELECT count(*) FROM norm_runs WHERE status = s) FROM (VALUES ('pending'), ('ambiguous'), ('no_match')) t(s) UNION ALL SELECT 'active_offers', count(*) FROM offers WHERE status = 'active'""",
    "ops_last_runs": _RUNS + " SELECT s.run_id, s.status, c.finished_at FROM status s JOIN rc c USING (run_id) ORDER BY finished_at DESC, run_id LIMIT 20",
    "ops_lookups": duck("brands", "locations", "offers", "scopes", "prices") + """ SELECT b.provider_id, b.provider_name, (SELECT count(*) FROM locations l WHERE l.provider_id = b.provider_id) AS locations, (SELECT count(*) FROM offers o WHERE o.provider_id = b.provider_id) AS offers, coalesce(x.n, 0) AS current_prices, x.seen AS last_seen_at
      FROM brands b LEFT JOIN (SELECT o.provider_id, count(*) AS n, max(p.last_seen_at) AS seen FROM offers o JOIN scopes s USING (offer_id) JOIN prices p ON p.scope_id = s.scope_id AND p.is_current GROUP BY o.provider_id) x USING (provider_id)""",
    "gate_report": _METRICS + " SELECT metric, value FROM mt",
    "gate_verdicts": _METRICS + " SELECT metric, value, CASE metric WHEN 'location_coordinate_pct' THEN 95.0::DOUBLE ELSE 1.0 END AS threshold, value >= CASE metric WHEN 'location_coordinate_pct' THEN 95.0 ELSE 1.0 END AS passed FROM mt WHERE metric IN ('shared_services', 'shared_priced_services', 'location_coordinate_pct')",
    "coverage_report": _DISC + " SELECT status, count(*) AS hosts, sum(locations)::BIGINT AS locations, sum(offers)::BIGINT AS offers, sum(priced_offers)::BIGINT AS priced_offers, count(*) FILTER (WHERE offers > 0) AS hosts_with_offers FROM disc GROUP BY status",
    "evaluate_corpus": _CORPUS + " SELECT expected_action, status, count(*) AS n FROM cj GROUP BY ALL",
    "corpus_summary": _CORPUS + " SELECT count(*) AS records, count(*) FILTER (WHERE wanted) AS resolution_expected, count(*) FILTER (WHERE wanted AND status = 'resolved') AS resolved_expected, count(*) FILTER (WHERE NOT wanted AND status = 'resolved') AS unexpected_resolved, count(*) FILTER (WHERE wanted AND status = 'resolved' AND item_id <> expected_item_id) AS wrong_item FROM cj",
    "corpus_ids": _CORPUS + " SELECT query_id, CASE WHEN wanted THEN 'unresolved_expected' ELSE 'unexpected_resolved' END AS kind FROM cj WHERE wanted <> (status = 'resolved')",
    "regression_diff": _REG + " SELECT before_status, after_status, sum(w)::BIGINT AS rows, count(*) AS cases FROM rj GROUP BY ALL",
    "regression_changes": _REG + " SELECT case_id, before_status, after_status FROM rj WHERE before_status <> after_status OR bi IS DISTINCT FROM ai",
    "backlog_reports": duck("norm_runs") + " SELECT status, count(*) AS rows, count(DISTINCT (provider_id, normalized_input)) AS groups FROM norm_runs GROUP BY status",
    "backlog_sku_labels": duck("norm_runs") + " SELECT labels, count(*) AS skus FROM (SELECT provider_id, provider_sku, count(DISTINCT normalized_input) AS labels FROM norm_runs WHERE provider_sku IS NOT NULL GROUP BY ALL) GROUP BY labels",
    "backlog_label_skus": duck("norm_runs") + " SELECT skus, count(*) AS labels FROM (SELECT provider_id, normalized_input, count(DISTINCT provider_sku) AS skus FROM norm_runs GROUP BY ALL) GROUP BY skus",
    "backlog_policy": duck("norm_runs") + " SELECT policy, count(*) AS rows, count(DISTINCT (provider_id, normalized_input)) AS groups, count(provider_sku) AS with_sku FROM norm_runs GROUP BY policy",
    "cohort_summary": duck("testers") + " SELECT cohort, count(*) FILTER (WHERE status = 'invited') AS invited, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'withdrawn') AS withdrawn, count(*) AS total, least(greatest(DATE '2001-06-01' - min(started_on) + 1, 0), 14)::BIGINT AS test_day FROM testers GROUP BY cohort",
}
