"""Registered source, ingest and quality queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import numbers as N, text as T
from ..operators import quality as V, resolve as R
from ..session import written
from ..sources import census as CE, contracts as C, mapping as M, pages as P, runs as RU
from . import duck_sql as D
from .resolve_queries import PREFIX, catalog
from .tables import VIEWS, duck, view

AS_OF = datetime.datetime(2001, 6, 1)

VIEWS["raw_rows"] = """
    SELECT concat('s', CAST(l_suppkey % 20 AS STRING)) AS source_key, concat('s', CAST(l_suppkey % 20 AS STRING), '-', substr(CAST(l_shipdate AS STRING), 1, 7)) AS run_id,
           l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq, l_linenumber * 18 AS n_observations, l_shipdate AS observed_at,
           concat('{"qty":', CAST(CAST(l_quantity AS INT) AS STRING), ',"part":', CAST(l_partkey % 7 AS STRING), CASE WHEN l_tax > 0.07 THEN ',"note":"long text here"' ELSE '' END, '}') AS payload
    FROM {lineitem}"""
VIEWS["raw_runs"] = """
    SELECT source_key, run_id, max(observed_at) AS finished_at, count(*) % 11 = 0 AS failed, concat(source_key, '/e') AS endpoint_id FROM {raw_rows} GROUP BY source_key, run_id"""
VIEWS["run_limits"] = "SELECT DISTINCT source_key, CAST(4 AS BIGINT) AS expected_min, CAST(3000 AS BIGINT) AS expected_max, 20.0 AS max_negative_pct FROM {raw_rows}"
VIEWS["study_rows"] = """
    SELECT concat('{"title":"', CASE WHEN p_size = 48 THEN ' ' ELSE p_name END, '","id":', CASE WHEN p_size = 49 THEN 'null' ELSE CAST(p_partkey AS STRING) END, ',"synonymous":"', p_brand,
           '","url":"', replace(p_name, ' ', '-'), '","price_list":"', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING), '","blue_card":', CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '"N/A"' END,
           ',"active":', CAST(p_size % 5 AS STRING), '}') AS payload, p_partkey, p_size, p_name, p_retailprice, p_brand, TIMESTAMP '2024-01-01 00:00:00' AS observed_at FROM {part}"""
VIEWS["census_rows"] = """
    SELECT CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS nom_estab, concat(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '621' WHEN c_mktsegment = 'FURNITURE' THEN '622' ELSE '561' END, CAST(c_nationkey AS STRING)) AS codigo_act,
           CASE WHEN c_nationkey = 24 THEN '09' ELSE '21' END AS cve_ent, concat('M', CAST(c_nationkey AS STRING)) AS municipio,
           CASE WHEN c_custkey % 13 = 0 THEN 'nan' ELSE CAST(CAST(17.5 + c_custkey % 40 / 10.0 AS DECIMAL(10,4)) AS STRING) END AS latitud, CAST(CAST(-99.5 + c_custkey % 30 / 10.0 AS DECIMAL(10,4)) AS STRING) AS longitud
    FROM {customer}
    UNION ALL SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'x1' ELSE CAST(s_suppkey AS STRING) END, s_name, '6215', '21', 'M0', '19.0', '-98.0' FROM {supplier}"""
VIEWS["registry_rows"] = """
    SELECT concat('PLSSA', lpad(CAST(c_custkey AS STRING), 6, '0')) AS registry_id, CASE WHEN c_nationkey < 12 THEN '21' ELSE '09' END AS entity, c_name AS name,
           concat('ver PLSSA', lpad(CAST(c_custkey * 7 % 1000 AS STRING), 6, '0'), ' y ', c_mktsegment) AS comment FROM {customer}
    UNION ALL SELECT concat('PLSSA', lpad(CAST(s_suppkey * 9 AS STRING), 6, '0')), '21', s_name, '' FROM {supplier} WHERE s_acctbal > 5000"""
VIEWS["registry_requested"] = "SELECT concat('PLSSA', lpad(CAST(o_custkey * 2 AS STRING), 6, '0')) AS registry_id FROM {orders}"
VIEWS["capture_rows"] = """
    SELECT CAST(l_partkey AS STRING) AS external_record_id, concat('{"n":', CAST(l_partkey AS STRING), ',"v":', CASE WHEN l_partkey % 9 = 0 AND l_tax > 0.04 THEN '2' ELSE '1' END, '}') AS payload,
           concat('term ', CAST(l_linenumber AS STRING)) AS query FROM {lineitem}"""
VIEWS["sources"] = """
    SELECT s_name AS source_name, 'provider_official' AS source_type, CAST(s_suppkey AS STRING) AS source_id, CASE WHEN s_acctbal < 1000 THEN 'paused' ELSE 'active' END AS status,
           CASE WHEN s_nationkey % 4 = 0 THEN 'review' ELSE 'approved' END AS policy, CASE WHEN s_suppkey % 6 <> 5 THEN CAST(s_suppkey AS STRING) END AS provider_id FROM {supplier}"""
VIEWS["endpoints"] = """
    SELECT CAST(s_suppkey AS STRING) AS source_id, concat('e', CAST(s_suppkey AS STRING)) AS endpoint_id, 'active' AS status, concat('https://h', CAST(s_suppkey AS STRING), '.example.com/api?k=1') AS url FROM {supplier}
    UNION ALL SELECT CAST(s_suppkey AS STRING), concat('f', CAST(s_suppkey AS STRING)), 'active', 'https://other.example.com/' FROM {supplier} WHERE s_nationkey = 7"""
VIEWS["expected_sources"] = """
    SELECT concat('k', CAST(s_suppkey AS STRING)) AS source_key, s_name AS source_name, 'provider_official' AS source_type, concat('https://h', CAST(s_suppkey AS STRING), '.example.com/', CASE WHEN s_suppkey % 7 = 3 THEN 'old' ELSE 'api' END) AS expected_url FROM {supplier}"""
VIEWS["place_batch"] = """
    SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN 'dup' ELSE CAST(c_custkey AS STRING) END AS external_record_id,
           concat('https://census.example.org/', CASE WHEN c_custkey % 19 = 0 THEN 'x' ELSE '' END, CASE WHEN c_custkey % 17 = 0 THEN 'dup' ELSE CAST(c_custkey AS STRING) END) AS source_url,
           CASE WHEN c_custkey % 23 = 0 THEN '[1]' ELSE concat('{"name":"', c_name, '"}') END AS payload, c_name,
           CASE WHEN c_custkey % 29 = 0 THEN 'name' WHEN c_custkey % 31 = 0 THEN 'colour' ELSE 'postal_code' END AS second_attribute FROM {customer}"""
VIEWS["release_rows"] = """
    SELECT concat(CAST(p_partkey % 30 AS STRING), '-', CAST(p_size % 10 AS STRING)) AS code, p_name AS long_name, p_type AS class, CAST(p_size % 4 AS STRING) AS classtype,
           CASE p_size % 5 WHEN 0 THEN 'DEPRECATED' WHEN 1 THEN 'Trial' ELSE 'ACTIVE' END AS status FROM {part}"""
VIEWS["edges"] = """
    SELECT a.p_partkey AS parent, b.p_partkey AS child FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey * 2 + 1
    UNION ALL SELECT p_partkey AS parent, CAST((p_partkey - 1 - (p_partkey - 1) % 4) / 4 AS BIGINT) AS child FROM {part} WHERE p_size = 50 AND p_partkey > 20"""

# two source shapes: a priced study feed and a census feed
STUDIES = M.SourceSpec(
    "study_feed", "provider_offer_price", ("$.id", "$.synonymous"), ("$.title",),
    (M.Field("offer", "provider_display_name", ("$.title",)), M.Field("offer", "provider_sku", ("$.synonymous",)),
     M.Field("price", "regular", ("$.price_list",), N.decimal_minor), M.Field("price", "blue_card", ("$.blue_card",), N.decimal_minor)),
    url=lambda p: F.concat(F.lit("https://studies.example.com/"), F.get_json_object(p, "$.url")),
    keep=lambda p: F.get_json_object(p, "$.active") != "0")
CENSUS = M.SourceSpec(
    "census_feed", "provider_location_discovered", ("$.Id", "$.CLEE"), ("$.Nombre", "$.Razon_social"),
    (M.Field("provider_location", "name", ("$.Nombre",), T.repair_text), M.Field("provider_location", "legal_name", ("$.Razon_social",), T.repair_text),
     M.Field("provider_location", "activity_code", ("$.Clase_actividad",)), M.Field("provider_location", "postal_code", ("$.CP",)),
     M.Field("provider_location", "latitude", ("$.Latitud",)), M.Field("provider_location", "longitude", ("$.Longitud",)),
     M.Field("provider_location", "website_url", ("$.www",))),
    url=lambda p: F.concat(F.lit("https://census.example.org/"), F.get_json_object(p, "$.Id")))


def _source_records(spark, sf):
    records, _ = M.source_records(view(spark, sf, "study_rows"), STUDIES)
    return records.select("external_record_id", "title", "source_url", F.array_join(F.transform("observations", lambda o: F.concat_ws("=", o["attribute_name"], o["observed_value"])), ",").alias("observations"))


def _source_rejects(spark, sf):
    return M.source_records(view(spark, sf, "study_rows"), STUDIES)[1].select("payload", "reject_reason")


def _page_links(spark, sf):
    parts = P.page_parts(view(spark, sf, "pages"))
    links = P.page_links(parts).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if("internal").alias("internal_links"))
    return parts.select("page_id", "title", F.size("headings").cast("bigint").alias("headings"), F.get("headings", F.lit(0)).alias("first_heading"),
                        F.size("jsonld").cast("bigint").alias("jsonld_blocks")).join(links, "page_id", "left").fillna({"links": 0, "internal_links": 0})


def _page_evidence(spark, sf):
    # the pages hold no study words, so every heading counts as one here
    return P.page_evidence(view(spark, sf, "pages"), hint=".").select("page_id", "kind", "name", "price_minor", "method", "confidence")


def _census(part):
    return lambda spark, sf: CE.census_scan(view(spark, sf, "census_rows"))[part]


def _census_records(spark, sf):
    return CE.census_scan(view(spark, sf, "census_rows"))["records"].select("external_record_id", "codigo_act", "lat", "lon", F.array_join("quality_flags", ",").alias("flags"))


def _registry(part):
    def run(spark, sf):
        return CE.registry_filter(view(spark, sf, "registry_rows"), "21", view(spark, sf, "registry_requested"))[part]
    return run


#: A smaller limit than the default, so that some payloads pass it.
MAX_BYTES = 40


def gated(spark, sf):
    return V.record_gate(view(spark, sf, "raw_rows"), max_bytes=MAX_BYTES)


def _record_gate(spark, sf):
    return gated(spark, sf).select("run_id", "seq", "parse_status", "error_detail")


def run_status(spark, sf, rows=None):
    runs, limits = view(spark, sf, "raw_runs"), view(spark, sf, "run_limits")
    if rows is None:  # only the counts are read
        return V.judge_runs(V.run_counts(view(spark, sf, "raw_rows"), max_bytes=MAX_BYTES), runs, limits)
    return V.run_gate(rows, runs, limits)


def _manifest(spark, sf, rows=None):
    # read by several branches, here and in the queries that pass their rows
    rows = written(gated(spark, sf)) if rows is None else rows
    return RU.run_manifest(rows, run_status(spark, sf, rows))


def _last_success(spark, sf):
    status = run_status(spark, sf).join(view(spark, sf, "raw_runs").select("run_id", "finished_at"), "run_id")
    return V.last_success(status)


def _quarantine(spark, sf):
    observations = view(spark, sf, "raw_rows").select("run_id", "seq", F.lit("candidate").alias("status"))
    return V.quarantine_observations(observations, run_status(spark, sf)).groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


def _artifact(spark, sf):
    rows = written(gated(spark, sf))
    manifests = _manifest(spark, sf, rows).withColumn("records_valid", F.when(F.length("run_id") % 2 == 0, F.col("records_valid") + 1).otherwise(F.col("records_valid")))
    observations = rows.filter("parse_status = 'parsed'").select("run_id", F.when(F.col("seq") % 5 == 0, "gone").otherwise(F.col("record_hash")).alias("record_hash"))
    return V.artifact_check(manifests, rows, observations)


def _publish_run(spark, sf):
    whole = written(gated(spark, sf).drop("payload"))
    rows = whole.filter("parse_status = 'parsed'").select("run_id", "record_hash", "source_key")
    runs = written(_manifest(spark, sf, whole))
    old_runs = runs.filter("source_key = 's1'").select("run_id")
    out = RU.publish_run(runs, rows, old_runs, rows.join(old_runs, "run_id", "left_semi"))
    return out["runs"].select("run_id", "status", "records_published").join(
        out["records"].groupBy("run_id").agg(F.count(F.lit(1)).alias("new_records")), "run_id", "left")


def _freshness(spark, sf):
    status = run_status(spark, sf).select("run_id", "status").join(view(spark, sf, "raw_runs").select("run_id", "endpoint_id", "finished_at"), "run_id")
    return V.endpoint_freshness(status)


def _stale(spark, sf):
    limits = view(spark, sf, "raw_runs").select("endpoint_id").distinct().withColumn("max_staleness_minutes", F.lit(60 * 24 * 30))
    return V.stale_facts(_freshness(spark, sf), limits, view(spark, sf, "prices"), AS_OF)


def _integrity(spark, sf):
    v = lambda n: view(spark, sf, n)
    locations, names, offers = v("locations"), v("names"), written(v("offers").drop("requires_quote", "seen"))  # offers, scopes and prices are read by several rules
    scopes = written(view(spark, sf, "scopes", {"offers": offers}).select("scope_id", "offer_id", "scope_type", "location_id"))
    prices = written(view(spark, sf, "prices", {"scopes": scopes}).select("price_id", "scope_id", "price_type", "channel", "price_key", "is_current"))
    own = scopes.filter("scope_type = 'location'").join(offers.select("offer_id", "provider_id"), "offer_id")
    series = prices.filter("is_current")
    return V.integrity_report(
        V.missing_parent("offer_item", offers, "offer_id", "item_id", v("items").filter("status = 'active'"), "item_id"),
        V.missing_parent("price_scope", prices, "price_id", "scope_id", scopes, "scope_id"),
        V.differs("scope_brand", own, "scope_id", "location_id", "provider_id", locations.filter("status = 'active'"), "location_id", "provider_id"),
        V.not_unique("primary_name", names, ["item_id", "locale"]),
        V.not_unique("current_price", series, ["scope_id", "price_type", "channel", "price_key"]),
        V.not_unique("active_offer", offers.filter("status = 'active'"), ["provider_id", "item_id"]),
        V.not_unique("provider_alias", v("aliases").filter("provider_id IS NOT NULL"), ["provider_id", "alias"]))


def _cycles(spark, sf):
    return V.component_cycles(view(spark, sf, "edges"))


def _union(part):
    def run(spark, sf):
        good, bad = M.union_captures(view(spark, sf, "capture_rows"))
        return good.select("external_record_id", F.array_join("queries", ",").alias("queries")) if part == 0 else bad
    return run


def _approved(spark, sf):
    return M.approved_sources(view(spark, sf, "sources"), view(spark, sf, "endpoints"), view(spark, sf, "expected_sources"))


def _contract(part):
    def run(spark, sf):
        rows = view(spark, sf, "place_batch")
        def obs(name, value):
            return F.struct(F.lit("provider_location").alias("entity_type"), F.lit("candidate").alias("status"), name.alias("attribute_name"), value.alias("observed_value"))
        batch = rows.withColumn("observations", F.array(obs(F.lit("name"), F.col("c_name")), obs(F.col("second_attribute"), F.lit("72000"))))
        good, bad = C.ingest_contract(batch, "https://census.example.org/")
        return good.select("c_custkey", "external_record_id") if part == 0 else bad.select("c_custkey", F.array_join("violations", ",").alias("violations"))
    return run


def _location_contract(spark, sf):
    rows = view(spark, sf, "locations").select(
        F.when(F.col("location_id").cast("bigint") % 12 == 0, "a b").otherwise(F.col("location_id")).alias("external_id"), T.slugify("location_name").alias("slug"), F.col("line1").alias("name"),
        F.concat(F.lit("https://p.example.com/"), "market_id", F.when(F.substring_index("market_id", "-", -1) == "3", "?q").otherwise("")).alias("url"), (F.col("lat") * F.when(F.substring_index("market_id", "-", -1) == "5", 5).otherwise(1)).alias("lat"), "lon", "location_id")
    return C.location_contract(rows).select("location_id", F.array_join("violations", ",").alias("violations"))


def _export(spark, sf):
    return M.catalog_terms_export(R.search_terms(catalog(spark, sf), "parts"), 200, 50).select("item_id", "term", "term_source")


def _index(part):
    return lambda spark, sf: M.terminology_index(view(spark, sf, "release_rows"), {"economy", "Promo", "SMALL"}, {"1", "2", "3"})[part]


def _content_rows(spark, sf):
    return M.observations_of(M.source_records(view(spark, sf, "study_rows"), STUDIES)[0], 0.9).groupBy("attribute_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("record_hash").alias("records"))


QUERIES = {
    "source_records": _source_records,
    "source_rejects": _source_rejects,
    "source_observations": _content_rows,
    "page_parts": _page_links,
    "page_evidence": _page_evidence,
    "census_scan": _census_records,
    "census_errors": _census("errors"),
    "census_by_class": _census("by_class"),
    "registry_filter": _registry("records"),
    "registry_missing": _registry("missing"),
    "registry_mentions": _registry("mentioned"),
    "record_gate": _record_gate,
    "run_gate": run_status,
    "write_run": _manifest,
    "last_success": _last_success,
    "quarantine_cascade": _quarantine,
    "artifact_check": _artifact,
    "publish_run": _publish_run,
    "endpoint_freshness": _freshness,
    "stale_facts": _stale,
    "integrity_report": _integrity,
    "component_cycles": _cycles,
    "union_captures": _union(0),
    "union_conflicts": _union(1),
    "approved_sources": _approved,
    "ingest_contract": _contract(0),
    "ingest_rejects": _contract(1),
    "location_contract": _location_contract,
    "catalog_terms_export": _export,
    "terminology_index": _index(0),
    "terminology_counts": _index(1),
    "terminology_duplicates": _index(2),
}

_GATE = """
  g0 AS (SELECT *, CASE WHEN n_observations > 100 THEN 'record contains too many observations' WHEN octet_length(payload::BLOB) > 40 THEN 'record payload exceeds the safety limit' END AS e0 FROM raw_rows),
  gated AS (SELECT *, CASE WHEN e0 IS NOT NULL THEN e0 WHEN row_number() OVER (PARTITION BY run_id, payload, e0 IS NULL ORDER BY seq) > 1 THEN 'duplicate record hash in run' END AS error_detail FROM g0),
  rc AS (SELECT r.source_key, r.run_id, r.finished_at, r.failed, r.endpoint_id, count(*) AS received, count(*) FILTER (WHERE g.error_detail IS NULL) AS valid FROM raw_runs r JOIN gated g USING (run_id) GROUP BY ALL),
  ordered AS (SELECT c.*, row_number() OVER (PARTITION BY c.source_key ORDER BY finished_at, run_id) AS rn, expected_min, expected_max, max_negative_pct FROM rc c JOIN run_limits l USING (source_key)),
  fold AS (
    SELECT source_key, rn, run_id, received, valid, NULL::BIGINT AS previous,
           CASE WHEN received > expected_max THEN 'quarantined' WHEN received < expected_min THEN 'quarantined' WHEN failed AND valid = 0 THEN 'failed' WHEN failed THEN 'quarantined' ELSE 'succeeded' END AS status FROM ordered WHERE rn = 1
    UNION ALL
    SELECT o.source_key, o.rn, o.run_id, o.received, o.valid, CASE WHEN f.status = 'succeeded' THEN f.received ELSE f.previous END AS p,
           CASE WHEN (CASE WHEN f.status = 'succeeded' THEN f.received ELSE f.previous END) > 0 AND round((o.received - (CASE WHEN f.status = 'succeeded' THEN f.received ELSE f.previous END))::DOUBLE / (CASE WHEN f.status = 'succeeded' THEN f.received ELSE f.previous END) * 100, 4) < -max_negative_pct THEN 'quarantined'
                WHEN o.received > expected_max THEN 'quarantined' WHEN o.received < expected_min THEN 'quarantined' WHEN o.failed AND o.valid = 0 THEN 'failed' WHEN o.failed THEN 'quarantined' ELSE 'succeeded' END
    FROM fold f JOIN ordered o ON o.source_key = f.source_key AND o.rn = f.rn + 1),
  status AS (SELECT f.source_key, f.run_id, f.received AS records_received, f.valid AS records_valid, f.previous AS previous_success_count,
                    CASE WHEN previous > 0 THEN round((received - previous)::DOUBLE / previous * 100, 4) END AS deviation_percentage, status FROM fold f)"""
_RUNS = duck("raw_rows", "raw_runs", "run_limits").replace("WITH ", "WITH RECURSIVE ", 1) + "," + _GATE

ORACLES = {
    "source_records": duck("study_rows") + """ SELECT CASE WHEN p_size = 49 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS external_record_id, p_name AS title, 'https://studies.example.com/' || replace(p_name, ' ', '-') AS source_url,
        'provider_display_name=' || p_name || ',provider_sku=' || p_brand || ',regular=' || CAST((p_retailprice::DECIMAL(12,2) * 100)::BIGINT AS VARCHAR) AS observations FROM study_rows WHERE p_size % 5 <> 0 AND p_size <> 48""",
    "source_rejects": duck("study_rows") + " SELECT payload, 'missing_title' AS reject_reason FROM study_rows WHERE p_size = 48",
    "source_observations": duck("study_rows") + """, k AS (SELECT *, md5(payload) AS h FROM study_rows WHERE p_size % 5 <> 0 AND p_size <> 48)
        SELECT a AS attribute_name, count(*) AS n, count(DISTINCT h) AS records FROM k, (VALUES ('provider_display_name'), ('provider_sku'), ('regular')) t(a) GROUP BY a""",
    "page_parts": """WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '<script\\b.*?</script\\s*>', ' ', 'gis'), '<style\\b.*?</style\\s*>', ' ', 'gis') AS body FROM pages),
      s AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\\.', '') AS host, body, regexp_extract(body, '<title[^>]*>(.*?)</title>', 1, 'is') AS t,
                   regexp_extract_all(body, '<h[1-6]\\b[^>]*>(.*?)</h[1-6]\\s*>', 1, 'is') AS hs, list_distinct(regexp_extract_all(body, '<a\\b[^>]*\\bhref=["'']([^"''#]+)', 1, 'i')) AS ls FROM b),
      c AS (SELECT page_id, host, ls, %s AS title, list_filter(list_transform(hs, lambda h: %s), lambda h: h <> '') AS heads FROM s)
      SELECT page_id, title, len(heads) AS headings, heads[1] AS first_heading, 0::BIGINT AS jsonld_blocks, len(ls) AS links,
             len(list_filter(ls, lambda l: NOT regexp_matches(l, '^[a-z]+:', 'i') OR regexp_replace(regexp_extract(lower(l), '^https?://([^/?#:]+)', 1), '^www\\.', '') = host)) AS internal_links FROM c""" % tuple(
        "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(%s, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))" % x for x in ("t", "h")),
    "census_scan": duck("census_rows") + """, w AS (SELECT *, try_cast(latitud AS DOUBLE) AS la, try_cast(longitud AS DOUBLE) AS lo FROM census_rows WHERE codigo_act LIKE '621%' OR codigo_act LIKE '622%'),
      k AS (SELECT *, coalesce(NOT isnan(la) AND la BETWEEN 17.7 AND 21.0 AND lo BETWEEN -99.1 AND -96.6, FALSE) AS ok FROM w)
      SELECT trim(id) AS external_record_id, codigo_act, CASE WHEN ok THEN la END AS lat, CASE WHEN ok THEN lo END AS lon,
             concat_ws(',', CASE WHEN trim(nom_estab) = '' THEN 'missing_business_name' END, CASE WHEN NOT ok THEN 'invalid_coordinates' END) AS flags FROM k""",
    "census_errors": duck("census_rows") + """, w AS (SELECT * FROM census_rows WHERE codigo_act LIKE '621%' OR codigo_act LIKE '622%')
      SELECT id AS external_record_id, 'other_state' AS error FROM census_rows WHERE cve_ent <> '21' UNION ALL SELECT id, 'invalid_id' FROM w WHERE NOT regexp_full_match(id, '[0-9]{1,16}')
      UNION ALL SELECT id, 'duplicate_id' FROM w GROUP BY id HAVING count(*) > 1""",
    "census_by_class": duck("census_rows") + " SELECT codigo_act, count(*) AS n FROM census_rows WHERE codigo_act LIKE '621%' OR codigo_act LIKE '622%' GROUP BY codigo_act",
    "registry_filter": duck("registry_rows", "registry_requested") + " SELECT * FROM registry_rows WHERE entity = '21' AND registry_id IN (SELECT registry_id FROM registry_requested)",
    "registry_missing": duck("registry_rows", "registry_requested") + " SELECT DISTINCT registry_id FROM registry_requested WHERE registry_id NOT IN (SELECT registry_id FROM registry_rows WHERE entity = '21')",
    "registry_mentions": duck("registry_rows", "registry_requested") + " SELECT registry_id, regexp_extract(comment, '[A-Z]{5}[0-9]{6}') AS mentioned_id FROM registry_rows WHERE entity = '21' AND comment <> '' AND registry_id IN (SELECT registry_id FROM registry_requested)",
    "record_gate": _RUNS + " SELECT run_id, seq, CASE WHEN error_detail IS NULL THEN 'parsed' ELSE 'invalid' END AS parse_status, error_detail FROM gated",
    "run_gate": _RUNS + " SELECT * FROM status",
    "write_run": _RUNS + " SELECT source_key, run_id, records_received, records_valid, records_received - records_valid AS records_rejected, status, deviation_percentage FROM status",
    "last_success": _RUNS + " SELECT s.source_key, max_by(s.records_received, (c.finished_at, c.run_id)) AS previous_success_count, max(c.finished_at) AS last_success_at FROM status s JOIN rc c USING (run_id) WHERE status = 'succeeded' GROUP BY s.source_key",
    "quarantine_cascade": _RUNS + " SELECT run_id, CASE WHEN status = 'quarantined' THEN 'quarantined' ELSE 'candidate' END AS status, records_received AS n FROM status",
    "artifact_check": _RUNS + """ SELECT run_id, 'count_mismatch' AS problem, 1 AS n FROM status WHERE length(run_id) % 2 = 0
      UNION ALL SELECT run_id, 'orphan_observation', count(*) FROM gated WHERE error_detail IS NULL AND seq % 5 = 0 GROUP BY run_id""",
    "publish_run": _RUNS + " SELECT run_id, status, CASE WHEN status = 'succeeded' THEN records_valid ELSE 0 END AS records_published, nullif(records_valid, 0) AS new_records FROM status WHERE source_key <> 's1'",
    "endpoint_freshness": _RUNS + " SELECT endpoint_id, max(finished_at) AS last_success_at FROM status JOIN rc USING (run_id) WHERE status = 'succeeded' GROUP BY endpoint_id",
    "stale_facts": duck("raw_rows", "raw_runs", "run_limits", "prices").replace("WITH ", "WITH RECURSIVE ", 1) + "," + _GATE + """
      SELECT 'endpoint' AS kind, e.endpoint_id AS key FROM (SELECT DISTINCT endpoint_id FROM raw_runs) e LEFT JOIN (SELECT endpoint_id, max(finished_at) AS m FROM status JOIN rc USING (run_id) WHERE status = 'succeeded' GROUP BY endpoint_id) f USING (endpoint_id)
      WHERE m IS NULL OR date_diff('minute', m, TIMESTAMP '2001-06-01') > 43200
      UNION ALL SELECT 'price', price_id FROM prices WHERE is_current AND last_seen_at < TIMESTAMP '2001-06-01' - INTERVAL 30 DAY""",
    "integrity_report": duck("offers", "scopes", "locations", "prices", "names", "aliases", "items") + """
      SELECT 'offer_item' AS rule, offer_id AS key, item_id AS detail FROM offers WHERE item_id NOT IN (SELECT item_id FROM items WHERE status = 'active')
      UNION ALL SELECT 'price_scope', price_id, scope_id FROM prices WHERE scope_id NOT IN (SELECT scope_id FROM scopes)
      UNION ALL SELECT 'scope_brand', s.scope_id, o.provider_id || '!=' || l.provider_id FROM scopes s JOIN offers o USING (offer_id) JOIN locations l ON l.location_id = s.location_id AND l.status = 'active' WHERE s.scope_type = 'location' AND o.provider_id <> l.provider_id
      UNION ALL SELECT 'primary_name', item_id || '|' || locale, count(*)::VARCHAR FROM names GROUP BY item_id, locale HAVING count(*) > 1
      UNION ALL SELECT 'current_price', scope_id || '|' || price_type || '|' || channel || '|' || price_key, count(*)::VARCHAR FROM prices WHERE is_current GROUP BY scope_id, price_type, channel, price_key HAVING count(*) > 1
      UNION ALL SELECT 'active_offer', provider_id || '|' || item_id, count(*)::VARCHAR FROM offers WHERE status = 'active' GROUP BY provider_id, item_id HAVING count(*) > 1
      UNION ALL SELECT 'provider_alias', provider_id || '|' || alias, count(*)::VARCHAR FROM aliases WHERE provider_id IS NOT NULL GROUP BY provider_id, alias HAVING count(*) > 1""",
    "component_cycles": duck("edges").replace("WITH ", "WITH RECURSIVE ", 1) + """, reach AS (SELECT parent AS a, child AS b FROM edges UNION SELECT r.a, e.child FROM reach r JOIN edges e ON e.parent = r.b)
      SELECT DISTINCT e.parent, e.child FROM edges e JOIN reach r ON r.a = e.child AND r.b = e.parent""",
    "union_captures": duck("capture_rows") + " SELECT external_record_id, array_to_string(list_sort(list(DISTINCT query)), ',') AS queries FROM capture_rows GROUP BY external_record_id HAVING count(DISTINCT payload) = 1",
    "union_conflicts": duck("capture_rows") + " SELECT external_record_id, count(DISTINCT payload) AS variants FROM capture_rows GROUP BY external_record_id HAVING count(DISTINCT payload) > 1",
    "approved_sources": duck("sources", "endpoints", "expected_sources") + """ SELECT x.source_key, s.source_id, min(e.endpoint_id) AS endpoint_id FROM expected_sources x JOIN sources s ON s.source_name = x.source_name JOIN endpoints e ON e.source_id = s.source_id
      WHERE s.status = 'active' AND s.policy = 'approved' AND s.provider_id IS NOT NULL GROUP BY x.source_key, s.source_id, x.expected_url HAVING count(*) = 1 AND min(regexp_replace(e.url, '[?#].*', '')) = x.expected_url""",
    "ingest_contract": duck("place_batch") + " SELECT c_custkey, external_record_id FROM place_batch WHERE c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 23 <> 0 AND c_custkey % 29 <> 0 AND c_custkey % 31 <> 0",
    "ingest_rejects": duck("place_batch") + """ SELECT * FROM (SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 19 = 0 THEN 'source_url' END, CASE WHEN c_custkey % 23 = 0 THEN 'payload_shape' END, CASE WHEN second_attribute = 'colour' THEN 'observation_shape' END,
      CASE WHEN second_attribute = 'name' THEN 'duplicate_attribute' END, CASE WHEN external_record_id = 'dup' THEN 'duplicate_id' END) AS violations FROM place_batch) WHERE violations <> ''""",
    "location_contract": duck("locations") + """ SELECT location_id, concat_ws(',', CASE WHEN location_id::BIGINT % 12 = 0 THEN 'external_id' END, CASE WHEN trim(line1) = '' THEN 'name' END, CASE WHEN split_part(market_id, '-', 2) = '3' THEN 'url' END, CASE WHEN split_part(market_id, '-', 2) = '5' THEN 'coordinates' END, CASE WHEN location_id::BIGINT % 12 = 0 THEN 'duplicate_id' END) AS violations FROM locations""",
    "catalog_terms_export": PREFIX + " SELECT item_id, term, term_source FROM search_terms ORDER BY item_id, term_source, nt, term_provider NULLS FIRST, term LIMIT 200 OFFSET 50",
    "terminology_index": duck("release_rows") + " SELECT * FROM release_rows WHERE class IN ('ECONOMY', 'PROMO', 'SMALL') AND classtype IN ('1', '2', '3') AND upper(status) IN ('ACTIVE', 'TRIAL')",
    "terminology_counts": duck("release_rows") + " SELECT count(*) AS rows_seen, count(*) FILTER (WHERE class IN ('ECONOMY', 'PROMO', 'SMALL') AND classtype IN ('1', '2', '3') AND upper(status) IN ('ACTIVE', 'TRIAL')) AS rows_written FROM release_rows",
    "terminology_duplicates": duck("release_rows") + " SELECT code, count(*) AS n FROM release_rows WHERE class IN ('ECONOMY', 'PROMO', 'SMALL') AND classtype IN ('1', '2', '3') AND upper(status) IN ('ACTIVE', 'TRIAL') GROUP BY code HAVING count(*) > 1",
}
