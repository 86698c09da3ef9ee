"""Registered normalization-queue queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import normqueue as Q
from . import duck_sql as D
from .resolve_queries import RESULTS, catalog, queries_table
from .tables import VIEWS, duck, view

AS_OF = datetime.datetime(2000, 1, 1)

# one waiting label per line of an order
VIEWS["norm_runs"] = """
    SELECT concat(CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING), '-', CAST(l.l_partkey AS STRING), '-', CAST(l.l_suppkey AS STRING), '-', CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS STRING)) AS run_id, p.p_brand AS provider_id,
           CASE l.l_linenumber WHEN 1 THEN p.p_name WHEN 2 THEN concat(lower(p.p_type), ' ', p.p_name) WHEN 3 THEN concat(split_part(p.p_name, ' ', 2), ' ', split_part(p.p_name, ' ', 1)) WHEN 4 THEN 'old' ELSE concat(p.p_name, ' xl') END AS normalized_input,
           upper(p.p_name) AS raw_text, CASE l.l_linestatus WHEN 'O' THEN 'pending' ELSE CASE WHEN l.l_tax > 0.06 THEN 'resolved' WHEN l.l_tax > 0.03 THEN 'ambiguous' ELSE 'no_match' END END AS status,
           l.l_shipdate AS created_at, CASE WHEN l.l_discount > 0.02 THEN CAST(l.l_partkey AS STRING) END AS provider_sku, l.l_quantity > 25 AS has_candidates, CASE WHEN l.l_suppkey % 3 = 0 THEN 'review' ELSE 'approved' END AS policy,
           CAST(l.l_suppkey AS STRING) AS source_id
    FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey"""
VIEWS["norm_decisions"] = """
    SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS run_id, concat('d', CAST(l_orderkey AS STRING), l_returnflag) AS decision_id,
           CAST(l_partkey AS STRING) AS selected_item_id, l_shipdate AS decided_at, concat('req', CAST(l_linenumber AS STRING)) AS request_id FROM {lineitem} WHERE l_returnflag = 'A'
    UNION ALL
    SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS run_id, concat('e', CAST(l_orderkey AS STRING), l_returnflag) AS decision_id,
           CAST(l_suppkey AS STRING) AS selected_item_id, l_shipdate + INTERVAL '1' DAY AS decided_at, 'late' AS request_id FROM {lineitem} WHERE l_returnflag = 'A' AND l_quantity > 40"""
VIEWS["offer_labels"] = """
    SELECT CASE WHEN s.policy = 'approved' THEN 'feed_a' ELSE 'feed_b' END AS source_key, s.normalized_input AS label, s.run_id AS external_record_id FROM {norm_runs} s"""
VIEWS["label_decisions"] = """
    SELECT source_key, label AS label_key, count(*) - CASE WHEN label LIKE 'cold%' THEN 1 ELSE 0 END AS expected_record_count, CASE WHEN label LIKE '%xl' THEN 'hold' ELSE 'publish' END AS action
    FROM {offer_labels} WHERE label NOT LIKE 'hot%' GROUP BY source_key, label
    UNION ALL SELECT 'feed_a' AS source_key, concat('gone ', name) AS label_key, 1 AS expected_record_count, 'hold' AS action FROM {items}"""
VIEWS["reviewed_contexts"] = """
    SELECT provider_id, normalized_input AS label, CASE WHEN provider_sku IS NULL THEN 'none' ELSE concat('i', substr(provider_sku, 1, 1)) END AS item_id, raw_text, concat('{"p":"', policy, '"}') AS context FROM {norm_runs} WHERE status = 'resolved'"""
VIEWS["expected_reviews"] = """
    SELECT provider_id, label, item_id, count(*) - CASE WHEN label LIKE 'blue%' THEN 1 ELSE 0 END AS expected_rows FROM {reviewed_contexts} GROUP BY provider_id, label, item_id"""
VIEWS["approved_aliases"] = """
    SELECT label, item_id, CASE WHEN item_id = 'i1' THEN 'global' ELSE 'provider' END AS alias_scope, provider_id FROM {reviewed_contexts} GROUP BY label, item_id, provider_id"""
VIEWS["research_holds"] = """
    SELECT DISTINCT provider_id, label, raw_text AS signature, CASE WHEN label LIKE 'red%' THEN TIMESTAMP '1999-01-01 00:00:00' ELSE TIMESTAMP '2005-01-01 00:00:00' END AS valid_until FROM {reviewed_contexts} WHERE label NOT LIKE '%widget'"""


def _queue(spark, sf):
    return Q.open_queue(view(spark, sf, "norm_runs"), view(spark, sf, "norm_decisions"))


def _open(spark, sf):
    return _queue(spark, sf).select("run_id", "status")


def _page(spark, sf):
    return Q.queue_page(_queue(spark, sf), 50, (AS_OF, "5")).select("run_id", "created_at")


def _matches(spark, sf):
    return Q.exact_matches(_queue(spark, sf), *[view(spark, sf, n) for n in ("items", "names", "aliases", "disambiguation")])


def _exact(spark, sf):
    return _matches(spark, sf).select("run_id", "item_id", "match_method", "matched_term")


def _exact_approved(spark, sf):
    approved = view(spark, sf, "norm_runs").filter("policy = 'approved'").select("source_id").distinct()
    return Q.exact_matches_approved(_matches(spark, sf), view(spark, sf, "norm_runs").select("run_id", "source_id"), approved).select("run_id", "item_id")


def _materialize(part):
    def run(spark, sf):
        runs = view(spark, sf, "norm_runs")
        records = runs.select(F.col("run_id").alias("record_key"), F.col("source_id").alias("source_key"), F.when(F.col("status") == "ambiguous", F.col("raw_text")).otherwise(F.col("normalized_input")).alias("payload_label"), "provider_id")
        labels = runs.select(F.col("run_id").alias("record_key"), F.col("normalized_input").alias("label")).unionByName(
            runs.filter("has_candidates AND status = 'no_match'").select(F.col("run_id").alias("record_key"), F.col("raw_text").alias("label")))
        queued = runs.filter("status = 'resolved'").select(F.col("run_id").alias("record_key"))
        return Q.materialize_queue(records, labels, queued)[part]
    return run


def _apply(spark, sf):
    decisions = view(spark, sf, "norm_decisions")
    everything = Q.exact_matches(view(spark, sf, "norm_runs").filter(F.col("status").isin(*Q.OPEN)), *[view(spark, sf, n) for n in ("items", "names", "aliases", "disambiguation")])
    return Q.apply_exact(everything, decisions, 500, "new-request")[1]


def _groups(spark, sf):
    return Q.queue_groups(_queue(spark, sf))


def _latest(spark, sf):
    return Q.latest_decision(view(spark, sf, "norm_decisions"))


def _fingerprint(spark, sf):
    from ..operators import resolve as R
    queries = queries_table(spark, sf)
    results = R.resolve(queries, catalog(spark, sf), "parts")
    return Q.review_fingerprint(queries.withColumn("scope", F.coalesce("provider_id", F.lit("all"))), results, "v6").select("scope", "normalized_query", "occurrences", "first_query_id")


def _review(part):
    def run(spark, sf):
        offers = view(spark, sf, "offer_labels")
        mapped = view(spark, sf, "norm_runs").filter("status = 'resolved'").select(F.when(F.col("policy") == "approved", "feed_a").otherwise("feed_b").alias("source_key"), F.col("run_id").alias("external_record_id"))
        return Q.review_report(offers, mapped, view(spark, sf, "label_decisions"))[part]
    return run


def _memory(part):
    def run(spark, sf):
        out = Q.label_memory(view(spark, sf, "reviewed_contexts"), view(spark, sf, "expected_reviews"))[part]
        return out.groupBy("provider_id", "label", "item_id").agg(F.count(F.lit(1)).alias("signatures"), F.sum("historical_rows").alias("rows")) if part == 0 else out
    return run


def _planned(spark, sf):
    rules, _ = Q.label_memory(view(spark, sf, "reviewed_contexts"), view(spark, sf, "expected_reviews"))
    rows = view(spark, sf, "norm_runs").select(
        "run_id", F.when(F.col("source_id") == "4", "ocr").otherwise("crawler").alias("input_type"), F.when(F.col("source_id") != "6", F.col("provider_id")).alias("provider_id"),
        F.when(F.col("normalized_input") == F.lower("raw_text"), F.col("raw_text")).otherwise(F.lit("")).alias("raw_text"), F.when(F.col("provider_sku") == "11", "changed").otherwise(F.col("normalized_input")).alias("normalized_input"),
        F.concat(F.lit('{"p":"'), "policy", F.lit('"}')).alias("context"), (F.col("provider_sku") == "12").eqNullSafe(F.lit(True)).alias("has_patient_data"), (F.col("provider_sku") == "13").eqNullSafe(F.lit(True)).alias("has_unknown_fields"))
    return Q.plan_reuse(rows, rules, view(spark, sf, "approved_aliases"))


def _plan(spark, sf):
    return _planned(spark, sf).select("run_id", "outcome", "planned_item_id")


def _tasks(spark, sf):
    return Q.research_tasks(_planned(spark, sf))


def _research(spark, sf):
    tasks = view(spark, sf, "reviewed_contexts").groupBy("provider_id", "label").agg(F.count(F.lit(1)).alias("occurrences")).withColumn("outcome", F.lit("needs_source_evidence"))
    signatures = view(spark, sf, "reviewed_contexts").select("provider_id", "label", F.when(F.col("label").like("new%"), F.concat("raw_text", F.lit("!"))).otherwise(F.col("raw_text")).alias("signature"))
    return Q.research_queue(tasks, signatures, view(spark, sf, "research_holds"), AS_OF)


def _collisions(spark, sf):
    batch = view(spark, sf, "norm_runs").select(F.col("normalized_input").alias("alias"), "provider_id", F.coalesce("provider_sku", F.lit("0")).alias("item_id")).distinct()
    return Q.alias_collisions(batch, *[view(spark, sf, n) for n in ("names", "aliases", "disambiguation")])


def _scope(spark, sf):
    runs = view(spark, sf, "norm_runs")
    snap = runs.select("run_id", F.col("normalized_input").alias("label"), "provider_id", F.col("status").alias("row_hash"), F.col("policy").alias("guard_value"))
    current = snap.withColumn("row_hash", F.when(F.col("row_hash") == "ambiguous", "pending").otherwise(F.col("row_hash")))
    groups = view(spark, sf, "norm_runs").filter("normalized_input NOT LIKE 'large%'").groupBy(F.col("normalized_input").alias("label"), "provider_id").agg((F.count(F.lit(1)) + F.when(F.first("normalized_input").like("%rod"), 1).otherwise(0)).alias("expected_rows"))
    return Q.review_scope_check(current, snap, groups)


def _ledger(spark, sf):
    applied = view(spark, sf, "norm_decisions").select(F.col("request_id").alias("review_id"))
    expected = view(spark, sf, "norm_runs").groupBy(F.concat(F.lit("req"), F.split_part("run_id", F.lit("-"), F.lit(2))).alias("review_id")).agg(F.count_if(F.col("status") != "x").alias("expected_rows"))
    return Q.review_ledger(expected.withColumn("expected_rows", F.when(F.col("review_id") == "req7", 0).otherwise(F.col("expected_rows"))), applied)


def _lookup(spark, sf):
    return Q.catalog_lookup(view(spark, sf, "items"), view(spark, sf, "names"), "Gear")


QUERIES = {
    "open_queue": _open, "queue_page": _page, "exact_matches": _exact, "exact_matches_approved": _exact_approved, "materialize_queue": _materialize(0),
    "materialize_conflicts": _materialize(1), "apply_exact": _apply, "queue_groups": _groups, "latest_decision": _latest, "capture_reviews": _fingerprint,
    "review_report": _review(0), "review_errors": _review(1), "label_memory": _memory(0), "label_memory_errors": _memory(1), "plan_reuse": _plan,
    "research_tasks": _tasks, "research_queue": _research, "alias_collisions": _collisions, "review_scope_check": _scope, "review_ledger": _ledger, "catalog_lookup": _lookup,
}

_OPEN = duck("norm_runs", "norm_decisions", "items", "names", "aliases", "disambiguation") + """,
  oq AS (SELECT * FROM norm_runs WHERE status IN ('pending', 'ambiguous', 'no_match') AND run_id NOT IN (SELECT run_id FROM norm_decisions))"""
_EXACT = lambda queue: f"""em AS (
  SELECT * FROM (
    SELECT r.run_id, r.created_at, r.source_id, i.item_id, n.name AS matched_term, 'exact' AS match_method, 1 AS o FROM {queue} r JOIN names n ON {D.norm('n.name')} = r.normalized_input JOIN items i ON i.item_id = n.item_id AND i.status = 'active'
    UNION ALL SELECT r.run_id, r.created_at, r.source_id, i.item_id, a.alias, CASE WHEN a.provider_id IS NULL THEN 'alias' ELSE 'provider_alias' END, CASE WHEN a.provider_id IS NULL THEN 3 ELSE 2 END
      FROM {queue} r JOIN aliases a ON {D.norm('a.alias')} = r.normalized_input AND a.status = 'approved' AND (a.provider_id IS NULL OR a.provider_id = r.provider_id) JOIN items i ON i.item_id = a.item_id AND i.status = 'active') x
  WHERE run_id NOT IN (SELECT run_id FROM {queue} WHERE normalized_input IN (SELECT term FROM disambiguation))
  QUALIFY min(item_id) OVER (PARTITION BY run_id) = max(item_id) OVER (PARTITION BY run_id) AND row_number() OVER (PARTITION BY run_id ORDER BY o, matched_term, item_id) = 1)"""  # noqa: E731
_CTX = """, ctx AS (SELECT *, raw_text || '|' || context AS sig FROM reviewed_contexts),
  cnt AS (SELECT provider_id, label, item_id, count(*) AS n FROM ctx GROUP BY ALL), ok AS (SELECT e.* FROM expected_reviews e LEFT JOIN cnt USING (provider_id, label, item_id) WHERE coalesce(n, 0) = expected_rows),
  rules AS (SELECT c.provider_id, c.label, c.item_id, c.sig, count(*) AS h FROM ctx c JOIN ok USING (provider_id, label, item_id) GROUP BY ALL)"""
_REUSE = duck("norm_runs", "reviewed_contexts", "expected_reviews", "approved_aliases") + _CTX + """,
  rw AS (SELECT run_id, CASE WHEN source_id = '4' THEN 'ocr' ELSE 'crawler' END AS it, CASE WHEN source_id <> '6' THEN provider_id END AS provider_id, CASE WHEN normalized_input = lower(raw_text) THEN raw_text ELSE '' END AS rt,
           CASE WHEN provider_sku = '11' THEN 'changed' ELSE normalized_input END AS ni, '{"p":"' || policy || '"}' AS cx, coalesce(provider_sku = '12', FALSE) AS pd, coalesce(provider_sku = '13', FALSE) AS uf FROM norm_runs),
  rl AS (SELECT *, CASE WHEN rt <> '' THEN lower(rt) ELSE ni END AS label, rt || '|' || cx AS sig FROM rw),
  j AS (SELECT rl.*, (SELECT count(DISTINCT item_id) FROM approved_aliases a WHERE a.label = rl.label AND (a.alias_scope = 'global' OR a.provider_id = rl.provider_id)) AS cands,
          (SELECT count(*) FROM rules r WHERE r.provider_id = rl.provider_id AND r.label = rl.label) AS known, (SELECT count(DISTINCT item_id) FROM rules r WHERE r.provider_id = rl.provider_id AND r.label = rl.label AND r.sig = rl.sig) AS same,
          (SELECT min(item_id) FROM rules r WHERE r.provider_id = rl.provider_id AND r.label = rl.label AND r.sig = rl.sig) AS rule_item FROM rl),
  pl AS (SELECT run_id, provider_id, label, CASE WHEN it <> 'crawler' THEN 'unsupported_input' WHEN provider_id IS NULL OR label = '' THEN 'incomplete_input' WHEN ni <> '' AND label <> ni THEN 'input_normalization_changed' WHEN pd THEN 'unsupported_patient_context'
           WHEN uf THEN 'unrecognized_source_fields' WHEN cands > 1 THEN 'ambiguous_approved_alias' WHEN same = 1 THEN 'reusable_exact_context' WHEN same > 1 THEN 'ambiguous_context' WHEN known > 0 THEN 'source_context_changed'
           WHEN cands = 1 THEN 'candidate_from_shared_catalog' ELSE 'needs_source_evidence' END AS outcome, rule_item FROM j)"""
_REPORT = duck("norm_runs", "offer_labels", "label_decisions") + """,
  rest AS (SELECT * FROM offer_labels WHERE external_record_id NOT IN (SELECT run_id FROM norm_runs WHERE status = 'resolved')),
  per AS (SELECT source_key, label AS label_key, count(*) AS records FROM rest GROUP BY ALL),
  jj AS (SELECT coalesce(p.source_key, d.source_key) AS source_key, coalesce(p.label_key, d.label_key) AS label_key, records, action,
     CASE WHEN d.action IS NULL THEN 'missing_decision' WHEN p.records IS NULL THEN 'stale_decision' WHEN records <> expected_record_count THEN 'count_mismatch' END AS problem FROM per p FULL JOIN label_decisions d ON d.source_key = p.source_key AND d.label_key = p.label_key)"""

ORACLES = {
    "open_queue": _OPEN + " SELECT run_id, status FROM oq",
    "queue_page": _OPEN + " SELECT run_id, created_at FROM oq WHERE (created_at, run_id) < (TIMESTAMP '2000-01-01', '5') ORDER BY created_at DESC, run_id DESC LIMIT 50",
    "exact_matches": _OPEN + ", " + _EXACT("oq") + " SELECT run_id, item_id, match_method, matched_term FROM em",
    "exact_matches_approved": _OPEN + ", " + _EXACT("oq") + " SELECT run_id, item_id FROM em WHERE source_id IN (SELECT source_id FROM norm_runs WHERE policy = 'approved')",
    "materialize_queue": duck("norm_runs") + " SELECT run_id AS record_key, source_id AS source_key, provider_id, CASE WHEN has_candidates AND status = 'no_match' THEN raw_text ELSE normalized_input END AS raw_text, normalized_input, 'pending' AS status FROM norm_runs WHERE status <> 'resolved' AND (NOT (has_candidates AND status = 'no_match') OR lower(raw_text) = normalized_input) AND (status <> 'ambiguous' OR lower(raw_text) = normalized_input)",
    "apply_exact": _OPEN + ", aq AS (SELECT * FROM norm_runs WHERE status IN ('pending', 'ambiguous', 'no_match')), " + _EXACT("aq") + """, b AS (SELECT * FROM em ORDER BY created_at, run_id LIMIT 500)
      SELECT (SELECT count(*) FROM b) AS selected, (SELECT count(*) FROM b WHERE run_id NOT IN (SELECT run_id FROM norm_decisions)) AS processed, (SELECT count(*) FROM b WHERE run_id IN (SELECT run_id FROM norm_decisions)) AS skipped, (SELECT count(*) FROM em) - (SELECT count(*) FROM b) AS remaining""",
    "queue_groups": _OPEN + """ SELECT provider_id, normalized_input, CASE WHEN bool_or(status = 'ambiguous') THEN 'ambiguous' WHEN bool_or(status = 'pending') THEN 'pending' ELSE 'no_match' END AS status, count(*) AS occurrence_count, count(DISTINCT provider_sku) AS distinct_sku_count,
        count(*) FILTER (WHERE has_candidates) AS rows_with_candidates, min(created_at) AS first_queued_at, max(created_at) AS last_queued_at, (list(run_id ORDER BY has_candidates DESC, created_at DESC, run_id DESC))[1] AS representative_run_id FROM oq GROUP BY provider_id, normalized_input""",
    "latest_decision": duck("norm_decisions") + " SELECT run_id, (list(selected_item_id ORDER BY decided_at DESC, decision_id DESC))[1] AS selected_item_id, max(decided_at) AS decided_at, count(*) AS decisions FROM norm_decisions GROUP BY run_id",
    "capture_reviews": RESULTS + """, sh AS (SELECT query_id, string_agg(item_id || ':' || resolution_status, ',' ORDER BY result_rank) AS fp, count(*) AS n, count(*) FILTER (WHERE resolution_status = 'resolved') AS r FROM results GROUP BY query_id)
      SELECT coalesce(q.provider_id, 'all') AS scope, q.nq AS normalized_query, count(*) AS occurrences, min(q.query_id) AS first_query_id FROM qn q LEFT JOIN sh USING (query_id) WHERE coalesce(r, 0) = 0 OR n > 1 GROUP BY 1, 2, coalesce(fp, '')""",
    "review_report": _REPORT + " SELECT source_key, action, count(*) AS labels, sum(records)::BIGINT AS records FROM jj WHERE problem IS NULL GROUP BY ALL",
    "review_errors": _REPORT + " SELECT source_key, label_key, problem FROM jj WHERE problem IS NOT NULL",
    "label_memory": duck("reviewed_contexts", "expected_reviews") + _CTX + " SELECT provider_id, label, item_id, count(*) AS signatures, sum(h)::BIGINT AS rows FROM rules GROUP BY ALL",
    "label_memory_errors": duck("reviewed_contexts", "expected_reviews") + _CTX + " SELECT provider_id, label, item_id, expected_rows, n AS rows FROM expected_reviews JOIN cnt USING (provider_id, label, item_id) WHERE n <> expected_rows",
    "plan_reuse": _REUSE + " SELECT run_id, outcome, CASE WHEN outcome = 'reusable_exact_context' THEN rule_item END AS planned_item_id FROM pl",
    "research_tasks": _REUSE + " SELECT provider_id, label, outcome, count(*) AS occurrences FROM pl WHERE outcome <> 'reusable_exact_context' GROUP BY ALL",
    "research_queue": duck("reviewed_contexts", "research_holds") + """, s AS (SELECT provider_id, label, list_sort(list(DISTINCT CASE WHEN label LIKE 'new%' THEN raw_text || '!' ELSE raw_text END)) AS a, count(*) AS occurrences FROM reviewed_contexts GROUP BY ALL),
      h AS (SELECT provider_id, label, list_sort(list(DISTINCT signature)) AS b FROM research_holds WHERE valid_until > TIMESTAMP '2000-01-01' GROUP BY ALL)
      SELECT provider_id, label, 'needs_source_evidence' AS outcome, occurrences, CASE WHEN b IS NULL THEN 'ready' WHEN a = b THEN 'held' ELSE 'hold_outdated' END AS state FROM s LEFT JOIN h USING (provider_id, label)""",
    "review_ledger": duck("norm_runs", "norm_decisions") + """, e AS (SELECT 'req' || split_part(run_id, '-', 2) AS review_id, count(*) AS n FROM norm_runs GROUP BY 1), x AS (SELECT review_id, CASE WHEN review_id = 'req7' THEN 0 ELSE n END AS expected_rows FROM e),
      a AS (SELECT request_id AS review_id, count(*) AS applied FROM norm_decisions GROUP BY 1)
      SELECT review_id, expected_rows, coalesce(applied, 0) AS applied, CASE WHEN coalesce(applied, 0) = expected_rows THEN 'already_applied' WHEN coalesce(applied, 0) = 0 THEN 'not_applied' ELSE 'differs' END AS state FROM x LEFT JOIN a USING (review_id)""",
    "alias_collisions": duck("norm_runs", "names", "aliases", "disambiguation") + f""", b AS (SELECT DISTINCT normalized_input AS nt, provider_id, coalesce(provider_sku, '0') AS item_id FROM norm_runs)
      SELECT DISTINCT nt, provider_id, 'duplicate_scope' AS kind FROM b GROUP BY nt, provider_id HAVING count(*) > 1
      UNION SELECT DISTINCT b.nt, b.provider_id, 'other_name' FROM b JOIN names n ON {D.norm('n.name')} = b.nt AND n.item_id <> b.item_id
      UNION SELECT DISTINCT b.nt, b.provider_id, 'other_alias' FROM b JOIN aliases a ON a.status = 'approved' AND {D.norm('a.alias')} = b.nt AND a.item_id <> b.item_id
      UNION SELECT DISTINCT nt, provider_id, 'disambiguation' FROM b WHERE nt IN (SELECT term FROM disambiguation)""",
    "review_scope_check": duck("norm_runs") + """, p AS (SELECT normalized_input AS label, provider_id, count(*) AS rows, count(DISTINCT policy) AS guards FROM norm_runs GROUP BY ALL)
      SELECT 'changed_rows' AS kind, '' AS key, count(*) AS n FROM norm_runs WHERE status = 'ambiguous' UNION ALL SELECT 'row_count', label || '|' || provider_id, rows FROM p WHERE label LIKE '%rod' AND label NOT LIKE 'large%'
      UNION ALL SELECT 'mixed_guard', label || '|' || provider_id, guards FROM p WHERE guards > 1 AND label NOT LIKE 'large%' UNION ALL SELECT 'uncovered', label || '|' || provider_id, rows FROM p WHERE label LIKE 'large%'""",
    "catalog_lookup": duck("items", "names") + f""" SELECT item_id, name, FALSE AS exact FROM (SELECT n.item_id, n.name FROM names n JOIN items i ON i.item_id = n.item_id AND i.status = 'active' WHERE contains({D.norm('n.name')}, 'gear') QUALIFY row_number() OVER (PARTITION BY n.item_id ORDER BY n.name) = 1)""",
}
