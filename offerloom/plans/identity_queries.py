"""Registered establishment-identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import VENUE_WORDS
from ..operators import identity as E
from . import duck_sql as D
from .tables import VIEWS, duck, view

VIEWS["establishments"] = """
    SELECT concat('c', CAST(c_custkey AS STRING)) AS external_record_id, md5(c_name) AS record_hash,
           concat(CASE c_custkey % 4 WHEN 0 THEN 'Laboratorio Polar ' WHEN 1 THEN 'L.R. Norte ' WHEN 2 THEN 'Ultrasonido Centro ' ELSE 'Tienda ' END, CAST(c_custkey % 50 AS STRING)) AS name,
           CASE WHEN c_custkey % 5 = 0 THEN 'Grupo Sur SA' ELSE '' END AS legal_name,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'Laboratorios médicos y de diagnóstico del sector privado' WHEN 'MACHINERY' THEN 'Laboratorios de pruebas' ELSE c_mktsegment END AS activity,
           CASE WHEN c_custkey % 7 <> 0 THEN CAST(19 + (c_custkey % 40) / 200.0 AS DOUBLE) END AS lat, CASE WHEN c_custkey % 7 <> 0 THEN CAST(-98 - (c_custkey % 30) / 200.0 AS DOUBLE) END AS lon,
           concat('Calle ', CAST(c_custkey % 3 AS STRING)) AS address, CAST(72000 + c_custkey % 20 AS STRING) AS postal_code,
           CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('www.h', CAST(c_custkey % 25 AS STRING), '.example.com/p', CAST(c_custkey % 6 AS STRING)) END AS website_url
    FROM {customer}"""
VIEWS["brand_locations"] = """
    SELECT concat('s', CAST(s_suppkey AS STRING)) AS location_id, CASE WHEN s_suppkey % 3 = 0 THEN 'north' ELSE 'polar' END AS brand_key, concat('Laboratorio Polar Sucursal ', CAST(s_suppkey % 60 AS STRING)) AS name,
           CAST(72000 + s_suppkey % 33 AS STRING) AS postal_code, CAST(19 + (s_suppkey % 37) / 200.0 + 0.001 AS DOUBLE) AS lat, CAST(-98 - (s_suppkey % 29) / 200.0 AS DOUBLE) AS lon FROM {supplier}"""
VIEWS["brand_candidates"] = """
    SELECT external_record_id AS candidate_id, CASE WHEN name LIKE 'Laboratorio%' THEN 'polar' WHEN name LIKE 'L.R.%' THEN 'north' END AS brand_key,
           CASE WHEN name LIKE 'Laboratorio%' THEN 'matched' WHEN name LIKE 'L.R.%' THEN 'review_required' END AS brand_status, name, postal_code, lat, lon FROM {establishments}"""
VIEWS["host_runs"] = """
    SELECT concat('h', CAST(s_suppkey % 30 AS STRING), '-', CAST(s_suppkey AS STRING), '.example.com') AS host, CASE s_nationkey % 3 WHEN 0 THEN 'failed' ELSE 'succeeded' END AS status,
           CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey END AS records_valid, CASE s_suppkey % 3 WHEN 0 THEN 'HTTP 503 temporary' WHEN 1 THEN 'HTTP 404' ELSE 'timed out; robots.txt' END AS errors FROM {supplier}"""
VIEWS["host_records"] = """
    SELECT concat('h', CAST(l_suppkey % 30 AS STRING), '-', CAST(l_suppkey AS STRING), '.example.com') AS host,
           CASE l_returnflag WHEN 'A' THEN 'provider_location_discovered' WHEN 'N' THEN 'provider_offer_discovered' ELSE 'provider_offer_price' END AS record_type FROM {lineitem}"""
VIEWS["anchor_records"] = """
    SELECT CASE WHEN p_size % 2 = 0 THEN 'feed_a' ELSE 'feed_b' END AS source_key, CAST(p_partkey AS STRING) AS external_record_id,
           CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, ' plus') ELSE p_name END AS title FROM {part}"""
VIEWS["reviewed_pairs"] = """
    SELECT source_key, external_record_id, 'r1' AS item_id FROM {anchor_records} WHERE title LIKE '%gear plus'"""

RULES = [("polar", "laboratorio polar", None, "matched", 0.99), ("north", "(^| )l r( |$)", "^grupo sur sa$", "review_required", 0.55)]


def _classified(spark, sf):
    return E.classify_census(view(spark, sf, "establishments"))


def _classify(spark, sf):
    return _classified(spark, sf).select("external_record_id", "classification", "review_status")


def _sites(spark, sf):
    return E.dedupe_sites(_classified(spark, sf))[0].select("classification", "dedupe_key", "external_record_id", "duplicate_count")


def _members(spark, sf):
    return E.dedupe_sites(_classified(spark, sf))[1].select("dedupe_key", "external_record_id")


def _brand(spark, sf):
    return E.brand_signal(view(spark, sf, "establishments"), RULES).select(
        "external_record_id", F.col("brand_match.brand_key").alias("brand_key"), F.col("brand_match.status").alias("status"), F.col("brand_match.confidence").alias("confidence"))


def _match(spark, sf):
    return E.match_locations(view(spark, sf, "brand_candidates"), view(spark, sf, "brand_locations")).select(
        "candidate_id", "status", "location_id", F.round("distance_meters", 1).alias("distance_meters"), "name_similarity", "same_postal", "score", "nearby")


def _hosts(spark, sf):
    return E.host_seed_rows(_classified(spark, sf)).select("host", "records", F.array_join("classifications", ",").alias("classifications"), "seed_url")


def _tables(spark):
    excluded = spark.createDataFrame([("h3.example.com",), ("h8.example.com",)], "host string")
    overrides = spark.createDataFrame([("h5.example.com", "Quinta"), ("h9.example.com", "Quinta")], "host string, brand_name string")
    return excluded, overrides


def _websites(part):
    return lambda spark, sf: E.website_identities(_classified(spark, sf), *_tables(spark))[part]


def _inventory(part):
    def run(spark, sf):
        groups = spark.createDataFrame([("direct_clinical", "first"), ("related_clinical", "second")], "classification string, priority_group string")
        return E.source_inventory(_classified(spark, sf), groups)[part]
    return run


def _discovery(spark, sf):
    return E.discovery_summary(view(spark, sf, "host_records"), view(spark, sf, "host_runs").drop("errors"))


def _portfolio(part):
    def run(spark, sf):
        mapping = view(spark, sf, "host_runs").select(
            F.concat(F.lit("k"), "host").alias("provider_key"), "host", F.array(F.concat(F.lit("c"), F.col("records_valid").cast("string")), F.concat(F.lit("c"), (F.col("records_valid") * 40).cast("string"))).alias("census_ids"))
        found = _discovery(spark, sf).filter("status <> 'empty'")
        return E.provider_portfolio(mapping, found, _classified(spark, sf))[part]
    return run


def _golden(part):
    def run(spark, sf):
        return E.golden_catalog(view(spark, sf, "items"), view(spark, sf, "anchor_records"), view(spark, sf, "reviewed_pairs"))[part]
    return run


def _retry(spark, sf):
    return E.retry_seeds(view(spark, sf, "host_runs")).select("host", "status")


def _review(spark, sf):
    census = _classified(spark, sf)
    reviewed = view(spark, sf, "establishments").select(
        F.when(F.col("postal_code") == "72003", "c3").when(F.col("postal_code") == "72004", "none").otherwise(F.col("external_record_id")).alias("external_record_id"),
        F.when(F.col("postal_code") == "72005", "https://else.example.com").otherwise(F.col("website_url")).alias("website_url"))
    return E.identity_review_check(reviewed, census).groupBy("external_record_id", "problem").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "classify_census": _classify, "dedupe_sites": _sites, "dedupe_members": _members, "brand_signal": _brand, "match_locations": _match,
    "host_seeds": _hosts, "website_identities": _websites(0), "website_clashes": _websites(1), "source_inventory": _inventory(0), "source_top_hosts": _inventory(1),
    "provider_portfolio": _portfolio(0), "portfolio_errors": _portfolio(1), "golden_catalog": _golden(0), "golden_queue": _golden(1),
    "discovery_summary": _discovery, "retry_seeds": _retry, "identity_review_check": _review,
}

_CLASS = duck("establishments") + f""", cl AS (
  SELECT *, CASE WHEN act = '{E.DIRECT_ACTIVITY}' THEN 'direct_clinical' WHEN act IN ('laboratorios de pruebas', 'consultorios dentales del sector privado') OR contains(nm, 'radiologia') OR contains(nm, 'ultrasonido') OR contains(nm, 'imagenologia') OR contains(nm, 'medicina nuclear') THEN 'related_clinical' ELSE 'non_clinical' END AS classification,
         regexp_extract(website_url, '^www\\.([^/]+)', 1) AS h0
  FROM (SELECT *, {D.norm('activity')} AS act, {D.norm('name')} || ' ' || {D.norm('legal_name')} AS nm FROM establishments)),
  c AS (SELECT *, nullif(h0, '') AS host FROM cl)"""
_KEY = f"""k AS (SELECT *, CASE WHEN {D.norm('legal_name')} <> '' THEN {D.norm('legal_name')} ELSE {D.norm('name')} END || '|' || CASE WHEN lat IS NOT NULL THEN printf('%.5f', lat) || '|' || printf('%.5f', lon) ELSE {D.norm('address')} END AS dedupe_key FROM c)"""
_TOK = lambda x: f"list_distinct(list_filter({D.toks(D.norm(x))}, lambda w: NOT list_contains({D.string_list(VENUE_WORDS)}, w)))"
_DISC = duck("host_runs", "host_records") + """, d AS (SELECT r.host, CASE WHEN r.status = 'succeeded' AND r.records_valid = 0 THEN 'empty' ELSE r.status END AS status, r.records_valid,
  (SELECT count(*) FROM host_records x WHERE x.host = r.host AND record_type = 'provider_location_discovered') AS locations, (SELECT count(*) FROM host_records x WHERE x.host = r.host AND record_type = 'provider_offer_discovered') AS service_only_offers,
  (SELECT count(*) FROM host_records x WHERE x.host = r.host AND record_type = 'provider_offer_price') AS priced_offers FROM host_runs r), disc AS (SELECT *, service_only_offers + priced_offers AS offers FROM d)"""
_PORT = _DISC + ", " + _CLASS.replace("WITH ", "", 1) + """, m AS (SELECT 'k' || host AS provider_key, host, unnest(['c' || records_valid, 'c' || (records_valid * 40)]) AS eid FROM host_runs),
  f AS (SELECT m.*, c.classification FROM m LEFT JOIN c ON c.external_record_id = m.eid), g AS (SELECT r.host, 'k' || r.host AS provider_key, x.offers, x.priced_offers FROM host_runs r LEFT JOIN disc x ON x.host = r.host AND x.status <> 'empty')"""

ORACLES = {
    "classify_census": _CLASS + " SELECT external_record_id, classification, CASE classification WHEN 'direct_clinical' THEN 'candidate' WHEN 'related_clinical' THEN 'review_required' ELSE 'excluded' END AS review_status FROM c",
    "dedupe_sites": _CLASS + ", " + _KEY + " SELECT classification, dedupe_key, min(external_record_id) AS external_record_id, count(*) AS duplicate_count FROM k GROUP BY classification, dedupe_key",
    "dedupe_members": _CLASS + ", " + _KEY + " SELECT dedupe_key, external_record_id FROM k",
    "brand_signal": duck("establishments") + """ SELECT external_record_id, CASE WHEN name LIKE 'Laboratorio Polar%' THEN 'polar' WHEN name LIKE 'L.R.%' AND legal_name = 'Grupo Sur SA' THEN 'north' END AS brand_key,
        CASE WHEN name LIKE 'Laboratorio Polar%' THEN 'matched' WHEN name LIKE 'L.R.%' AND legal_name = 'Grupo Sur SA' THEN 'review_required' END AS status, CASE WHEN name LIKE 'Laboratorio Polar%' THEN 0.99 WHEN name LIKE 'L.R.%' AND legal_name = 'Grupo Sur SA' THEN 0.55 END AS confidence FROM establishments""",
    "match_locations": duck("brand_candidates", "brand_locations") + f""", p AS (
        SELECT c.candidate_id, c.brand_status, {D.haversine('c.lat', 'c.lon', 'l.lat', 'l.lon')} AS d, {_TOK('c.name')} AS a, {_TOK('l.name')} AS b, c.postal_code = l.postal_code AS sp, l.location_id FROM brand_candidates c JOIN brand_locations l ON l.brand_key = c.brand_key),
      s AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)) END AS sim FROM p),
      t AS (SELECT *, sim * 0.55 + CASE WHEN sp THEN 0.25 ELSE 0 END + CASE WHEN d IS NULL THEN 0 ELSE (1 - least(d, 1000.0) / 1000.0) * 0.2 END AS score FROM s),
      b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY round(score, 9) DESC, coalesce(d, 1e6), location_id) = 1)
      SELECT c.candidate_id, CASE WHEN c.brand_key IS NULL THEN 'unmatched' WHEN c.brand_status = 'matched' AND round(d, 2) <= 350 AND (sim > 0 OR (sp AND round(d, 2) <= 100)) THEN 'matched' ELSE 'review_required' END AS status, location_id, round(round(d, 2), 1) AS distance_meters, round(sim, 4) AS name_similarity, sp AS same_postal, round(score, 5) AS score, coalesce(round(d, 2) <= 1000, FALSE) AS nearby
      FROM brand_candidates c LEFT JOIN b USING (candidate_id)""",
    "host_seeds": _CLASS + """ SELECT host, records, classifications, seed_url FROM (SELECT DISTINCT host, website_url AS seed_url FROM c WHERE host IS NOT NULL)
      JOIN (SELECT host, count(DISTINCT external_record_id) AS records, array_to_string(list_sort(list(DISTINCT classification)), ',') AS classifications FROM c WHERE host IS NOT NULL GROUP BY host) USING (host)""",
    "website_identities": _CLASS + f""", w AS (SELECT host, CASE WHEN host IN ('h5.example.com', 'h9.example.com') THEN 'Quinta' ELSE min_by(name, external_record_id) END AS name, count(*) AS sites FROM c WHERE classification = 'direct_clinical' AND lat IS NOT NULL AND host IS NOT NULL AND host NOT IN ('h3.example.com', 'h8.example.com') GROUP BY host),
      v AS (SELECT *, replace({D.norm('name')}, ' ', '-') AS slug FROM w) SELECT * FROM v WHERE slug IN (SELECT slug FROM v GROUP BY slug HAVING count(*) = 1)""",
    "website_clashes": _CLASS + f""", w AS (SELECT host, CASE WHEN host IN ('h5.example.com', 'h9.example.com') THEN 'Quinta' ELSE min_by(name, external_record_id) END AS name FROM c WHERE classification = 'direct_clinical' AND lat IS NOT NULL AND host IS NOT NULL AND host NOT IN ('h3.example.com', 'h8.example.com') GROUP BY host)
      SELECT replace({D.norm('name')}, ' ', '-') AS slug, count(*) AS hosts FROM w GROUP BY 1 HAVING count(*) > 1""",
    "source_inventory": _CLASS + " SELECT CASE classification WHEN 'direct_clinical' THEN 'first' WHEN 'related_clinical' THEN 'second' ELSE 'other' END AS priority_group, count(*) AS sites, count(host) AS with_website, count(*) - count(host) AS without_website FROM c GROUP BY 1",
    "source_top_hosts": _CLASS + " SELECT host, count(*) AS sites FROM c WHERE host IS NOT NULL GROUP BY host ORDER BY sites DESC, host LIMIT 10",
    "provider_portfolio": _PORT + """ SELECT g.host, g.provider_key, coalesce(g.offers, 0) AS offers, coalesce(g.priced_offers, 0) AS priced_offers, (SELECT count(classification) FROM f WHERE f.provider_key = g.provider_key) AS census_sites,
        (SELECT count(*) FROM f WHERE f.provider_key = g.provider_key AND classification = 'direct_clinical') AS direct_sites FROM g""",
    "portfolio_errors": _PORT + " SELECT provider_key, 'census_id' AS kind, eid AS reference FROM f WHERE classification IS NULL UNION ALL SELECT provider_key, 'host', host FROM g WHERE offers IS NULL",
    "golden_catalog": duck("items", "anchor_records", "reviewed_pairs") + f""" SELECT r.source_key, r.external_record_id, coalesce(v.item_id, i.item_id) AS item_id, CASE WHEN v.item_id IS NOT NULL THEN 'reviewed' ELSE 'exact' END AS method
        FROM anchor_records r LEFT JOIN reviewed_pairs v USING (source_key, external_record_id) LEFT JOIN items i ON i.name = {D.norm('r.title')} WHERE v.item_id IS NOT NULL OR i.item_id IS NOT NULL""",
    "golden_queue": duck("items", "anchor_records", "reviewed_pairs") + f""" SELECT r.source_key, r.external_record_id, {D.norm('r.title')} AS normalized_title FROM anchor_records r LEFT JOIN reviewed_pairs v USING (source_key, external_record_id)
        WHERE v.item_id IS NULL AND {D.norm('r.title')} NOT IN (SELECT name FROM items)""",
    "discovery_summary": _DISC + " SELECT * FROM disc",
    "retry_seeds": duck("host_runs") + " SELECT host, status FROM host_runs WHERE status = 'failed' AND errors LIKE '%503%'",
    "identity_review_check": _CLASS + """, r AS (SELECT CASE postal_code WHEN '72003' THEN 'c3' WHEN '72004' THEN 'none' ELSE external_record_id END AS eid, CASE WHEN postal_code = '72005' THEN 'else.example.com' ELSE host END AS h FROM c),
      n AS (SELECT eid, count(*) AS k FROM r GROUP BY eid), j AS (SELECT r.eid, r.h, n.k, c.classification AS cl, c.host AS ch FROM r JOIN n USING (eid) LEFT JOIN c ON c.external_record_id = r.eid),
      p AS (SELECT eid, 'repeated' AS problem FROM j WHERE k > 1 UNION ALL SELECT eid, 'missing' FROM j WHERE cl IS NULL UNION ALL SELECT eid, 'wrong_class' FROM j WHERE cl = 'non_clinical' UNION ALL SELECT eid, 'other_host' FROM j WHERE cl IS NOT NULL AND h IS DISTINCT FROM ch)
      SELECT eid AS external_record_id, problem, count(*) AS n FROM p GROUP BY eid, problem""",
}
