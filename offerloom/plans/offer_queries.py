"""Registered offer, price and package queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import offers as O, packages as P, resolve as R
from ..session import by_shuffle, cut_lineage, written
from . import duck_sql as D
from .resolve_queries import RESULTS, catalog, queries_table
from .tables import VIEWS, duck, view

AS_OF = datetime.datetime(1999, 6, 1)

VIEWS["price_observations"] = """
    SELECT CAST(l_partkey AS STRING) AS part_id, CAST(l_suppkey AS STRING) AS provider_id, CAST(round(l_extendedprice / l_quantity / 100) AS BIGINT) AS amount_minor, l_shipdate AS observed_at FROM {lineitem}"""
VIEWS["price_objects"] = """
    SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS record_key,
           round(l_extendedprice) AS regular, CASE WHEN l_discount > 0.08 THEN 0.0 ELSE round(l_extendedprice * 0.9) END AS online,
           CASE WHEN l_tax > 0.06 THEN l_extendedprice + 0.5 ELSE 10.0 END AS prepaid, 5.0 AS other FROM {lineitem}"""
VIEWS["captures"] = """
    SELECT CASE WHEN l_linestatus = 'O' THEN 'feed_a' ELSE 'feed_b' END AS source_key, concat(CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS external_record_id,
           sha2_stub AS record_hash, p_name AS display_name, CAST(l_partkey AS STRING) AS provider_sku, location_external_id
    FROM (SELECT l.l_linestatus, l.l_partkey, l.l_suppkey, p.p_name, md5(concat(p.p_name, CAST(max(l.l_linenumber) AS STRING))) AS sha2_stub,
                 CAST(max(l.l_orderkey) % 15 AS STRING) AS location_external_id
          FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey GROUP BY l.l_linestatus, l.l_partkey, l.l_suppkey, p.p_name) x"""
# every offer has a reviewed mapping; some labels or hashes moved on, some records vanished
VIEWS["mappings"] = """
    SELECT CASE WHEN length(o.offer_id) % 2 = 0 THEN 'feed_a' ELSE 'feed_b' END AS source_key, o.offer_id AS external_record_id, concat('k', o.provider_id) AS provider_key, o.item_id,
           upper(i.name) AS provider_alias, CASE WHEN o.seen > 1 THEN 'old label' ELSE '' END AS observed_label,
           md5(concat(i.name, CAST(1 + CAST(o.provider_id AS BIGINT) % 4 AS STRING))) AS expected_hash, CAST(o.provider_id AS BIGINT) % 2 = 0 AS branch_priced
    FROM {offers} o JOIN {items} i ON i.item_id = o.item_id"""
VIEWS["drift_current"] = """
    SELECT p.price_id, CASE WHEN p.price_type = 'regular' THEN 'feed_a' ELSE 'feed_b' END AS source_key, s.offer_id AS external_record_id, p.amount_minor,
           CASE WHEN p.price_key = 'member' THEN 'web' ELSE p.channel END AS channel, p.currency, s.location_id AS scope_location, s.scope_type = 'location' AS branch_priced
    FROM {prices} p JOIN {scopes} s ON s.scope_id = p.scope_id"""
VIEWS["drift_capture"] = """
    SELECT CASE WHEN l_linestatus = 'O' THEN 'feed_a' ELSE 'feed_b' END AS source_key, concat(CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS external_record_id,
           CASE WHEN max(l_tax) >= 0.08 THEN NULL ELSE CAST(round(min(l_extendedprice / l_quantity) * 100) AS BIGINT) END AS fresh_amount_minor,
           CAST(max(l_suppkey) + (SELECT count(*) FROM {supplier}) * (max(l_orderkey) % 15) AS STRING) AS fresh_location
    FROM {lineitem} GROUP BY l_linestatus, l_partkey, l_suppkey"""


def _v(spark, sf, *names, held=None):
    return [(held or {}).get(n) or view(spark, sf, n, held) for n in names]


def _supply(spark, sf) -> dict:
    """Offers and scopes, written once for a query that reads both several times."""
    offers = written(view(spark, sf, "offers").select("offer_id", "provider_id", "item_id", "requires_quote", "status"))
    return {"offers": offers, "scopes": written(view(spark, sf, "scopes", {"offers": offers}))}


def _resolve_prices(spark, sf):
    asks, offers, scopes, prices, locations, markets = _v(spark, sf, "price_asks", "offers", "scopes", "prices", "locations", "market_locations")
    return O.resolve_prices(asks, offers, scopes, prices, locations, markets).select(
        "ask_id", "price_type", "price_key", "price_id", "scope_type", "specificity", "amount_minor")


def _current(spark, sf):
    return O.current_prices(view(spark, sf, "prices"), AS_OF).select("price_id", "scope_id", "amount_minor")


def _expand(spark, sf):
    offers, scopes, locations, markets = _v(spark, sf, "offers", "scopes", "locations", "market_locations")
    rows = O.expand_offers(offers, scopes, locations, markets)
    return rows.groupBy("offer_id", "scope_type").agg(F.count(F.lit(1)).alias("n"), F.count("location_id").alias("branches"), F.min("location_id").alias("first_branch"))


def item_rows(spark, sf):
    brands, offers, scopes, prices, locations, markets, links = _v(
        spark, sf, "brands", "offers", "scopes", "prices", "locations", "market_locations", "links", held=_supply(spark, sf))
    return O.item_offer_rows(brands, offers, scopes, prices, locations, markets, links, as_of=AS_OF)


def _results(spark, sf):
    # read by several branches below, and a plan of its own
    return cut_lineage(R.resolve(queries_table(spark, sf), catalog(spark, sf), "parts"))


def _offer_search(spark, sf):
    return O.offer_search(_results(spark, sf), view(spark, sf, "names"), item_rows(spark, sf)).drop("source_url")


def _offer_search_near(spark, sf):
    positions = queries_table(spark, sf).select("query_id", (F.lit(19.0) + F.length("query_text") / 100).alias("lat"), F.lit(-98.5).alias("lon"))
    rows = written(item_rows(spark, sf).drop("source_url"))
    return O.offer_search_near(_results(spark, sf), positions, rows)


def _resolve_search(spark, sf):
    queries, results = queries_table(spark, sf), _results(spark, sf)
    found = O.offer_search(results, view(spark, sf, "names"), item_rows(spark, sf))
    nested = O.resolve_search(queries, results, R.resolution_status(queries, results), found)
    return nested.select("query_id", "status", F.coalesce(F.size("candidates"), F.lit(0)).cast("bigint").alias("n_candidates"),
                         F.coalesce(F.when(F.col("offers").isNotNull(), F.size("offers")), F.lit(0)).cast("bigint").alias("n_offers"),
                         F.get("offers", F.lit(0))["offer_id"].alias("first_offer"))


def _links(spark, sf):
    scopes = written(view(spark, sf, "scopes"))  # read by every kind of link
    asks, links, markets = _v(spark, sf, "price_asks", "links", "market_locations", held={"scopes": scopes})
    return O.offer_links(asks, scopes, links, markets)


def _service_detail(spark, sf):
    d = O.service_detail(*_v(spark, sf, "items", "names", "aliases", "attributes", "offers"))
    return d.select("item_id", F.size("names").cast("bigint").alias("n_names"), F.coalesce(F.size("aliases"), F.lit(-1)).cast("bigint").alias("n_aliases"),
                    F.get("names", F.lit(0))["name"].alias("first_name"), "offer_count", "provider_count")


def _provider_detail(spark, sf):
    return O.provider_detail(*_v(spark, sf, "brands", "locations", "offers"))


def _summaries(spark, sf):
    asked = view(spark, sf, "requests").groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item_index", "item_id"))), lambda s: s["item_id"]).alias("item_ids"))
    return O.service_summaries(asked, view(spark, sf, "items"), view(spark, sf, "descriptions"))


def _addresses(spark, sf):
    return O.branch_addresses(*_v(spark, sf, "locations", "offers", "scopes", "market_locations"))


def _by_provider(spark, sf):
    return O.offers_by_provider(*_v(spark, sf, "offers", "scopes", "brands"))


def _versions(spark, sf):
    return O.price_versions(view(spark, sf, "price_observations"), ["part_id", "provider_id"]).select(
        "part_id", "provider_id", F.col("version").cast("bigint").alias("version"), "amount_minor", "valid_from", "last_seen_at", "valid_to", "is_current")


def _price_rows(spark, sf):
    objects = view(spark, sf, "price_objects").select("record_key", F.create_map(
        *[x for k in ("regular", "online", "prepaid", "other") for x in (F.lit(k), F.col(k))]).alias("prices"))
    return O.price_rows(objects)[0]


def _price_refused(spark, sf):
    objects = view(spark, sf, "price_objects").select("record_key", F.create_map(
        *[x for k in ("regular", "online", "prepaid", "other") for x in (F.lit(k), F.col(k))]).alias("prices"))
    return O.price_rows(objects)[1]


def _publish(part):
    def run(spark, sf):
        if part == "rejects":
            return O.publish_offers(view(spark, sf, "mappings"), view(spark, sf, "captures"))["rejects"]
        out = O.publish_offers(view(spark, sf, "mappings"), view(spark, sf, "captures"), written)
        return out["scopes"].join(out["offers"].select("offer_id", "provider_key", "item_id"), "offer_id").groupBy("provider_key", "item_id", "scope_type").agg(
            F.count_distinct("offer_id").alias("offers"), F.count(F.lit(1)).alias("scopes"))
    return run


def _brand_scopes(spark, sf):
    return O.default_brand_scopes(view(spark, sf, "offers")).select("scope_id", "offer_id", "scope_type")


def _drift(spark, sf):
    scopes = written(view(spark, sf, "scopes").select("scope_id", "offer_id", "scope_type", "location_id"))  # read by prices and by what they meet
    return O.price_drift(view(spark, sf, "drift_current", {"scopes": scopes}), view(spark, sf, "drift_capture")).select("price_id", "source_key", "state")


def _package_offers(spark, sf):
    offers, scopes, prices, locations, markets, brands = _v(spark, sf, "offers", "scopes", "prices", "locations", "market_locations", "brands")
    expanded = O.expand_offers(offers, scopes, locations, markets, brand_to_branches=True)
    return P.package_offers(expanded, offers, scopes, prices, locations, markets, brands, at=AS_OF).select(
        "item_id", "offer_id", "location_id", "scope_id", "price_type", "price_key", "amount_minor", "requires_quote")


#: What a plan of the registered queries may visit: a trip of three branches is the feature; the planner's own default is any number.
BRANCHES_PER_PLAN = 3


def _plan(objective):
    def run(spark, sf):
        best = P.best_branch_offer(view(spark, sf, "branch_offers"))
        plans = P.plan_packages(view(spark, sf, "requests"), best, objective, max_branches=BRANCHES_PER_PLAN)
        chosen = F.transform("selected_offers", lambda o: F.concat_ws("@", o["offer_id"], o["location_id"]))
        return plans.withColumns({
            "chosen_offers": F.array_join(chosen, "|"), "missing_items": F.array_join("missing_item_indexes", ",")}).drop(
            "selected_offers", "missing_item_indexes")
    return run


def _package_status(spark, sf):
    queries = queries_table(spark, sf)
    asked = view(spark, sf, "requests").select("request_id", F.concat(F.lit("p"), "item_id").alias("query_id"))
    status = R.resolution_status(queries, _results(spark, sf)).join(by_shuffle(asked), "query_id")
    covered = view(spark, sf, "offers").filter("status = 'active'").select("item_id").distinct()
    reached = status.filter("status = 'resolved'").join(covered, "item_id", "left_semi").groupBy("request_id").agg(F.count(F.lit(1)).alias("coverage_count"))
    return P.package_status(status, reached)


QUERIES = {
    "resolve_prices": _resolve_prices,
    "current_prices": _current,
    "expand_offers": _expand,
    "offer_search": _offer_search,
    "offer_search_near": _offer_search_near,
    "resolve_search": _resolve_search,
    "offer_links": _links,
    "service_detail": _service_detail,
    "provider_detail": _provider_detail,
    "service_summaries": _summaries,
    "branch_addresses": _addresses,
    "offers_by_provider": _by_provider,
    "price_versions": _versions,
    "price_rows": _price_rows,
    "price_rows_refused": _price_refused,
    "publish_offers": _publish("offers"),
    "publish_rejects": _publish("rejects"),
    "brand_scopes": _brand_scopes,
    "price_drift": _drift,
    "package_offers": _package_offers,
    "package_status": _package_status,
    "plan_packages": _plan("balanced"),
    "plan_lowest_cost": _plan("lowest_cost"),
    "plan_nearest": _plan("nearest"),
    "plan_all_in_one": _plan("all_in_one"),
}

_AS = "TIMESTAMP '1999-06-01 00:00:00'"
_NOW = f"""now_prices AS (SELECT * FROM prices WHERE is_current AND (valid_from IS NULL OR {_AS} >= valid_from) AND (valid_to IS NULL OR {_AS} < valid_to))"""
_EXPANDED = """expanded AS (
  SELECT o.offer_id, o.provider_id, o.item_id, o.requires_quote, s.scope_id, s.scope_type, CASE s.scope_type WHEN 'location' THEN 3 WHEN 'market' THEN 2 ELSE 1 END AS specificity,
         CASE s.scope_type WHEN 'location' THEN s.location_id WHEN 'market' THEN m.location_id END AS location_id
  FROM offers o JOIN scopes s ON s.offer_id = o.offer_id LEFT JOIN market_locations m ON s.scope_type = 'market' AND m.market_id = s.market_id AND m.provider_id = o.provider_id
  WHERE o.status = 'active' AND s.status = 'active' AND (s.scope_type <> 'market' OR m.location_id IS NOT NULL)
    AND (s.scope_type <> 'location' OR EXISTS (SELECT 1 FROM locations l WHERE l.location_id = s.location_id AND l.provider_id = o.provider_id)))"""
_ROWS = _NOW + ", " + _EXPANDED + """, item_rows AS (
  SELECT e.*, b.provider_name, p.price_type, p.price_key, p.amount_minor, l.lat, l.lon
  FROM expanded e JOIN brands b ON b.provider_id = e.provider_id AND b.status = 'active' LEFT JOIN now_prices p ON p.scope_id = e.scope_id LEFT JOIN locations l ON l.location_id = e.location_id
  WHERE e.location_id IS NOT NULL OR e.offer_id NOT IN (SELECT offer_id FROM scopes WHERE scope_type = 'location' AND status = 'active'))"""
_SEARCH_VIEWS = ("names", "aliases", "descriptions", "disambiguation", "lexicon", "attributes", "identifiers", "queries",
                 "brands", "offers", "scopes", "prices", "locations", "market_locations", "links")


def _search(extra: str) -> str:
    from .resolve_queries import _CODES, _STAGES, _TERMS, _final
    return duck(*_SEARCH_VIEWS) + "," + _TERMS + _STAGES + _final(6, _CODES) + ", " + _ROWS + extra


_FOUND = """, ranked_rows AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, provider_id ORDER BY amount_minor NULLS LAST, offer_id, location_id NULLS LAST, price_type NULLS FIRST, price_key NULLS FIRST, scope_id) AS provider_rank FROM item_rows),
found AS (
  SELECT * FROM (
    SELECT r.query_id, r.item_id, r.display_name, r.confidence, x.offer_id, x.provider_id, x.provider_name, x.location_id, x.price_type, x.price_key, x.amount_minor,
           row_number() OVER (PARTITION BY r.query_id ORDER BY x.provider_rank > 1, r.confidence DESC, x.provider_name, r.display_name, r.item_id, x.provider_rank) AS offer_rank
    FROM results r JOIN ranked_rows x ON x.item_id = r.item_id WHERE x.provider_rank <= 20) WHERE offer_rank <= 20)"""


def _plan_sql(order: str) -> str:
    return duck("requests", "branch_offers") + f""",
  pick AS (
    SELECT * FROM branch_offers QUALIFY row_number() OVER (PARTITION BY item_id, location_id ORDER BY requires_quote OR amount_minor IS NULL, amount_minor IS NULL, amount_minor, provider_name || '|' || offer_id) = 1),
  need AS (SELECT request_id, count(*) AS n FROM requests GROUP BY request_id),
  cells AS (
    SELECT r.request_id, r.item_index, b.*, round({D.haversine('b.lat', 'b.lon', 'r.lat', 'r.lon')}, 3) AS dist FROM requests r JOIN pick b ON b.item_id = r.item_id),
  branch AS (
    SELECT request_id, location_id, bit_or(1::HUGEINT << item_index::INT) AS mask, count(*) AS covered, min(dist) AS dist, min(provider_name || '|' || location_name) AS label
    FROM cells GROUP BY request_id, location_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY covered DESC, dist, label, location_id) AS rk FROM branch),
  sets AS (
    SELECT request_id, location_id AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS c, bit_count(mask) AS cov, 1 AS size, dist, location_id AS ids FROM ranked
    UNION ALL SELECT x.request_id, x.location_id, y.location_id, NULL, bit_count(x.mask | y.mask), 2, greatest(x.dist, y.dist), x.location_id || '|' || y.location_id FROM ranked x JOIN ranked y ON y.request_id = x.request_id AND y.rk > x.rk
    UNION ALL SELECT x.request_id, x.location_id, y.location_id, z.location_id, bit_count(x.mask | y.mask | z.mask), 3, greatest(x.dist, y.dist, z.dist), x.location_id || '|' || y.location_id || '|' || z.location_id
      FROM ranked x JOIN ranked y ON y.request_id = x.request_id AND y.rk > x.rk JOIN ranked z ON z.request_id = x.request_id AND z.rk > y.rk),
  tops AS (SELECT request_id, max(cov, 3)[3] AS third, min(cov) AS least FROM sets GROUP BY request_id),
  kept AS (SELECT s.* FROM sets s JOIN tops t USING (request_id) WHERE s.cov >= coalesce(t.third, t.least)),
  chosen AS (
    SELECT k.request_id, k.ids, c.item_index,
           min(struct_pack(q := c.requires_quote OR c.amount_minor IS NULL, m := c.amount_minor IS NULL, amt := coalesce(c.amount_minor, 0), nm := c.provider_name || '|' || c.offer_id, oid := c.offer_id, loc := c.location_id)) AS best
    FROM kept k JOIN cells c ON c.request_id = k.request_id AND c.location_id IN (k.a, k.b, k.c) GROUP BY k.request_id, k.ids, c.item_index),
  priced AS (SELECT request_id, ids, bool_or(best.q) AS quoted, sum(best.amt) AS amt, string_agg(best.oid || '@' || best.loc, '|' ORDER BY item_index) AS chosen_offers, list(item_index) AS held FROM chosen GROUP BY request_id, ids),
  solutions AS (
    SELECT k.request_id, k.ids AS location_ids, k.cov, k.size, k.dist, n.n, p.quoted OR k.cov < n.n AS requires_quote, CASE WHEN k.cov = n.n AND NOT p.quoted THEN p.amt::BIGINT END AS total, p.chosen_offers, p.held
    FROM kept k JOIN priced p ON p.request_id = k.request_id AND p.ids = k.ids JOIN need n ON n.request_id = k.request_id),
  final AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cov DESC, {order}, location_ids) AS solution_rank FROM solutions)
  SELECT request_id, solution_rank, location_ids, cov::BIGINT AS coverage_count, size::BIGINT AS location_count, total AS total_amount_minor, requires_quote, dist AS distance_meters,
         n AS requested_count, round(cov::DOUBLE / n * 100, 2) AS coverage_percent, chosen_offers,
         (SELECT coalesce(string_agg(r.item_index::VARCHAR, ',' ORDER BY r.item_index), '') FROM requests r WHERE r.request_id = final.request_id AND NOT list_contains(held, r.item_index)) AS missing_items, CASE WHEN total IS NOT NULL THEN 'MXN' END AS currency FROM final WHERE solution_rank <= 3"""


_PRICED = """
  own AS (SELECT a.*, l.timezone, timezone(l.timezone, timezone('UTC', a.at)) AS local FROM price_asks a JOIN locations l ON l.location_id = a.location_id JOIN offers o ON o.offer_id = a.offer_id AND o.provider_id = l.provider_id),
  cand AS (
    SELECT a.ask_id, p.*, s.scope_type, CASE s.scope_type WHEN 'location' THEN 3 WHEN 'market' THEN 2 ELSE 1 END AS specificity, strftime(a.local, '%H:%M:%S') AS lt, isodow(a.local) AS dow
    FROM own a JOIN scopes s ON s.offer_id = a.offer_id AND s.status = 'active' JOIN prices p ON p.scope_id = s.scope_id AND p.is_current
    WHERE (p.valid_from IS NULL OR a.at >= p.valid_from) AND (p.valid_to IS NULL OR a.at < p.valid_to)
      AND (s.scope_type = 'brand' OR (s.scope_type = 'location' AND s.location_id = a.location_id)
           OR (s.scope_type = 'market' AND s.market_id IN (SELECT m.market_id FROM market_locations m WHERE m.location_id = a.location_id)))),
  priced AS (
    SELECT * FROM cand
    WHERE (weekdays IS NULL OR list_contains(weekdays, dow)) AND (day_time_from IS NULL OR day_time_to IS NULL
      OR (day_time_from <= day_time_to AND lt >= day_time_from AND lt < day_time_to) OR (day_time_from > day_time_to AND (lt >= day_time_from OR lt < day_time_to)))
    QUALIFY row_number() OVER (PARTITION BY ask_id, price_type, channel, price_key ORDER BY specificity DESC, valid_from DESC NULLS LAST, created_at DESC, price_id DESC) = 1)"""
_PRICE_VIEWS = ("price_asks", "offers", "scopes", "prices", "locations", "market_locations")

ORACLES = {
    "resolve_prices": duck(*_PRICE_VIEWS) + "," + _PRICED + " SELECT ask_id, price_type, price_key, price_id, scope_type, specificity, amount_minor FROM priced",
    "current_prices": duck("prices") + ", " + _NOW + " SELECT price_id, scope_id, amount_minor FROM now_prices",
    "expand_offers": duck("offers", "scopes", "market_locations", "locations") + ", " + _EXPANDED + " SELECT offer_id, scope_type, count(*) AS n, count(location_id) AS branches, min(location_id) AS first_branch FROM expanded GROUP BY offer_id, scope_type",
    "offer_search": _search(_FOUND + " SELECT * FROM found"),
    "offer_search_near": _search(f""", pos AS (SELECT query_id, 19.0 + length(query_text) / 100.0 AS qlat, -98.5 AS qlon FROM queries),
      spots AS (SELECT DISTINCT r.item_id, p.qlat, p.qlon FROM results r JOIN pos p USING (query_id)),
      near_rows AS (
        SELECT s.qlat, s.qlon, x.*, round({D.haversine('x.lat', 'x.lon', 's.qlat', 's.qlon')}, 3) AS distance_meters FROM spots s JOIN item_rows x ON x.item_id = s.item_id),
      near_ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item_id, qlat, qlon, provider_id ORDER BY distance_meters NULLS LAST, amount_minor NULLS LAST, provider_name, offer_id, scope_id, location_id NULLS FIRST, price_type NULLS FIRST, price_key NULLS FIRST) AS provider_rank FROM near_rows)
      SELECT * FROM (
        SELECT r.query_id, r.item_id, r.display_name, r.confidence, x.offer_id, x.provider_id, x.provider_name, x.location_id, x.distance_meters, x.price_type, x.price_key, x.amount_minor,
               row_number() OVER (PARTITION BY r.query_id ORDER BY x.provider_rank > 1, r.confidence DESC, x.distance_meters NULLS LAST, x.provider_name, r.display_name, r.item_id, x.provider_rank) AS offer_rank
        FROM results r JOIN pos p USING (query_id) JOIN near_ranked x ON x.item_id = r.item_id AND x.qlat = p.qlat AND x.qlon = p.qlon WHERE x.provider_rank <= 20) WHERE offer_rank <= 20"""),
    "resolve_search": _search(_FOUND + """, cand AS (SELECT query_id, count(*) AS c, bool_or(resolution_status = 'ambiguous') AS unclear FROM results GROUP BY query_id),
      deduped AS (SELECT query_id, count(DISTINCT (item_id, offer_id, coalesce(location_id, ''), coalesce(price_type, ''), coalesce(price_key, ''))) AS n, min_by(offer_id, offer_rank) AS first_offer FROM found GROUP BY query_id)
      SELECT q.query_id, CASE WHEN c.c IS NULL THEN 'no_match' WHEN c.c > 1 OR c.unclear THEN 'ambiguous' ELSE 'resolved' END AS status, coalesce(c.c, 0) AS n_candidates, coalesce(d.n, 0) AS n_offers, d.first_offer
      FROM queries q LEFT JOIN cand c USING (query_id) LEFT JOIN deduped d USING (query_id)"""),
    "offer_links": duck("price_asks", "scopes", "links", "market_locations") + """, pairs AS (SELECT DISTINCT offer_id, location_id FROM price_asks),
      elig AS (SELECT a.offer_id, a.location_id, s.scope_id, CASE s.scope_type WHEN 'location' THEN 3 WHEN 'market' THEN 2 ELSE 1 END AS sp FROM pairs a JOIN scopes s ON s.offer_id = a.offer_id AND s.status = 'active'
        WHERE s.scope_type = 'brand' OR (s.scope_type = 'location' AND s.location_id = a.location_id) OR (s.scope_type = 'market' AND s.market_id IN (SELECT market_id FROM market_locations m WHERE m.location_id = a.location_id))),
      best AS (SELECT e.offer_id, e.location_id, l.link_target, l.url FROM elig e JOIN links l ON l.scope_id = e.scope_id WHERE l.status = 'active'
        QUALIFY row_number() OVER (PARTITION BY e.offer_id, e.location_id, l.link_target ORDER BY e.sp DESC, l.verified_at DESC NULLS LAST, l.created_at DESC, l.link_id DESC) = 1),
      w AS (SELECT offer_id, location_id, max(url) FILTER (WHERE link_target IN ('study', 'booking')) AS study_url, max(url) FILTER (WHERE link_target = 'location') AS location_url, max(url) FILTER (WHERE link_target = 'booking') AS booking_url, bool_or(link_target = 'provider') AS p FROM best GROUP BY ALL)
      SELECT p.offer_id, p.location_id, study_url, location_url, booking_url, CASE WHEN study_url IS NOT NULL AND location_url IS NOT NULL THEN 'study_and_location' WHEN study_url IS NOT NULL THEN 'study_only' WHEN location_url IS NOT NULL THEN 'location_only' WHEN w.p THEN 'provider_only' ELSE 'none' END AS link_capability
      FROM pairs p LEFT JOIN w USING (offer_id, location_id)""",
    "service_detail": duck("items", "names", "aliases", "offers") + """
      SELECT i.item_id, (SELECT count(DISTINCT name) FROM names n WHERE n.item_id = i.item_id) AS n_names,
        coalesce((SELECT CASE WHEN count(*) = 0 THEN -1 ELSE count(*) END FROM aliases a WHERE a.item_id = i.item_id AND a.status = 'approved'), -1) AS n_aliases,
        (SELECT min(name) FROM names n WHERE n.item_id = i.item_id) AS first_name,
        (SELECT count(*) FROM offers o WHERE o.item_id = i.item_id AND o.status = 'active') AS offer_count, (SELECT count(DISTINCT provider_id) FROM offers o WHERE o.item_id = i.item_id AND o.status = 'active') AS provider_count
      FROM items i WHERE i.status = 'active'""",
    "provider_detail": duck("brands", "locations", "offers") + """, l AS (SELECT provider_id, count(*) AS location_count, count(*) FILTER (WHERE status = 'active') AS active_location_count FROM locations GROUP BY provider_id),
      o AS (SELECT provider_id, count(*) AS offer_count, count(DISTINCT item_id) AS service_count FROM offers WHERE status = 'active' GROUP BY provider_id)
      SELECT b.provider_id, b.provider_name, b.status, coalesce(location_count, 0) AS location_count, coalesce(active_location_count, 0) AS active_location_count, coalesce(offer_count, 0) AS offer_count, coalesce(service_count, 0) AS service_count
      FROM brands b LEFT JOIN l USING (provider_id) LEFT JOIN o USING (provider_id)""",
    "service_summaries": duck("requests", "items", "descriptions") + """ SELECT r.request_id, r.item_index AS position, r.item_id, d.description FROM requests r JOIN items i ON i.item_id = r.item_id AND i.status = 'active' JOIN descriptions d ON d.item_id = r.item_id""",
    "branch_addresses": duck("locations", "offers", "scopes", "market_locations") + """ SELECT location_id, concat_ws(', ', trim(line1), nullif(trim(line2), ''), nullif(trim(locality), ''), 'C.P. ' || postal_code) AS address FROM locations l
      WHERE l.status = 'active' AND trim(line1) <> '' AND (EXISTS (SELECT 1 FROM offers o WHERE o.status = 'active' AND o.provider_id = l.provider_id)
        OR l.location_id IN (SELECT s.location_id FROM scopes s JOIN offers o ON o.offer_id = s.offer_id AND o.status = 'active' WHERE s.scope_type = 'location' AND o.provider_id = l.provider_id)
        OR l.market_id IN (SELECT s.market_id FROM scopes s JOIN offers o ON o.offer_id = s.offer_id AND o.status = 'active' WHERE s.scope_type = 'market' AND o.provider_id = l.provider_id))""",
    "offers_by_provider": duck("offers", "scopes", "brands") + """ SELECT b.provider_id, b.provider_name, count(DISTINCT o.offer_id) AS offer_count, count(DISTINCT o.item_id) AS service_count, count(DISTINCT s.location_id) AS branch_count, count(*) FILTER (WHERE s.location_id IS NULL) AS unscoped_offers
      FROM brands b JOIN offers o ON o.provider_id = b.provider_id AND o.status = 'active' LEFT JOIN scopes s ON s.offer_id = o.offer_id AND s.scope_type = 'location' GROUP BY b.provider_id, b.provider_name""",
    "price_versions": duck("price_observations") + """, d AS (SELECT part_id, provider_id, observed_at, min(amount_minor) AS a FROM price_observations GROUP BY ALL),
      c AS (SELECT *, CASE WHEN lag(a) OVER w IS DISTINCT FROM a THEN 1 ELSE 0 END AS ch FROM d WINDOW w AS (PARTITION BY part_id, provider_id ORDER BY observed_at)),
      v AS (SELECT *, sum(ch) OVER (PARTITION BY part_id, provider_id ORDER BY observed_at) AS version FROM c),
      g AS (SELECT part_id, provider_id, version::BIGINT AS version, min(a) AS amount_minor, min(observed_at) AS valid_from, max(observed_at) AS last_seen_at FROM v GROUP BY ALL)
      SELECT *, lead(valid_from) OVER (PARTITION BY part_id, provider_id ORDER BY version) AS valid_to, lead(valid_from) OVER (PARTITION BY part_id, provider_id ORDER BY version) IS NULL AS is_current FROM g""",
    "price_rows": duck("price_objects") + """ SELECT record_key, price_type, price_key, amount_minor FROM (
        SELECT record_key, 'regular' AS price_type, 'default' AS price_key, regular::BIGINT AS amount_minor, regular AS v FROM price_objects
        UNION ALL SELECT record_key, 'online', 'default', online::BIGINT, online FROM price_objects UNION ALL SELECT record_key, 'other', 'prepaid', prepaid::BIGINT, prepaid FROM price_objects) WHERE v > 0 AND v = floor(v)""",
    "price_rows_refused": duck("price_objects") + " SELECT record_key, 'prepaid' AS source_type FROM price_objects WHERE prepaid <> floor(prepaid)",
    "publish_rejects": duck("mappings", "captures") + f""", j AS (SELECT m.*, c.record_hash, trim(c.display_name) AS observed FROM mappings m LEFT JOIN captures c USING (source_key, external_record_id))
      SELECT source_key, external_record_id, 'record_missing' AS reason FROM j WHERE record_hash IS NULL
      UNION ALL SELECT source_key, external_record_id, 'label_changed' FROM j WHERE record_hash IS NOT NULL AND NOT CASE WHEN trim(observed_label) <> '' THEN observed = trim(observed_label) ELSE {D.norm('observed')} = {D.norm('provider_alias')} END
      UNION ALL SELECT source_key, external_record_id, 'hash_mismatch' FROM j WHERE record_hash <> expected_hash""",
    "publish_offers": duck("mappings", "captures") + f""", g AS (SELECT m.*, c.location_external_id, m.branch_priced AND c.location_external_id <> '' AS at_branch FROM mappings m JOIN captures c USING (source_key, external_record_id)
        WHERE c.record_hash = m.expected_hash AND CASE WHEN trim(observed_label) <> '' THEN trim(c.display_name) = trim(observed_label) ELSE {D.norm('c.display_name')} = {D.norm('provider_alias')} END)
      SELECT provider_key, item_id, CASE WHEN at_branch THEN 'location' ELSE 'market' END AS scope_type, count(DISTINCT CASE WHEN at_branch THEN 'item ' || item_id ELSE external_record_id END) AS offers, count(DISTINCT (external_record_id, location_external_id)) AS scopes FROM g GROUP BY ALL""",
    "brand_scopes": duck("offers") + " SELECT 'b' || offer_id AS scope_id, offer_id, 'brand' AS scope_type FROM offers",
    "price_drift": duck("drift_current", "drift_capture") + """ SELECT c.price_id, c.source_key, CASE WHEN f.external_record_id IS NULL THEN 'unmatched_source' WHEN branch_priced AND scope_location IS DISTINCT FROM fresh_location THEN 'location_binding_requires_review'
        WHEN channel <> 'any' OR currency <> 'MXN' THEN 'contract_not_comparable' WHEN fresh_amount_minor IS NULL THEN 'source_price_missing' WHEN fresh_amount_minor = amount_minor THEN 'amount_same' ELSE 'amount_changed_requires_review' END AS state
      FROM drift_current c LEFT JOIN drift_capture f USING (source_key, external_record_id)""",
    "package_offers": duck("offers", "scopes", "prices", "locations", "market_locations", "brands") + f""",
      wide AS (SELECT o.item_id, o.offer_id, o.provider_id, o.requires_quote, s.scope_id, l.location_id, CASE s.scope_type WHEN 'location' THEN 3 WHEN 'market' THEN 2 ELSE 1 END AS sp
        FROM offers o JOIN scopes s ON s.offer_id = o.offer_id AND s.scope_type = 'brand' JOIN locations l ON l.provider_id = o.provider_id WHERE o.status = 'active'
        UNION ALL SELECT o.item_id, o.offer_id, o.provider_id, o.requires_quote, s.scope_id, s.location_id, 3 FROM offers o JOIN scopes s ON s.offer_id = o.offer_id AND s.scope_type = 'location' JOIN locations l ON l.location_id = s.location_id AND l.provider_id = o.provider_id WHERE o.status = 'active'
        UNION ALL SELECT o.item_id, o.offer_id, o.provider_id, o.requires_quote, s.scope_id, m.location_id, 2 FROM offers o JOIN scopes s ON s.offer_id = o.offer_id AND s.scope_type = 'market' JOIN market_locations m ON m.market_id = s.market_id AND m.provider_id = o.provider_id WHERE o.status = 'active'),
      one AS (SELECT w.* FROM wide w QUALIFY row_number() OVER (PARTITION BY w.item_id, w.offer_id, w.location_id ORDER BY sp DESC, scope_id) = 1),
      live AS (SELECT w.* FROM one w JOIN locations l ON l.location_id = w.location_id AND l.status = 'active' JOIN brands b ON b.provider_id = w.provider_id AND b.status = 'active'),
      price_asks AS (SELECT offer_id || '@' || location_id AS ask_id, offer_id, location_id, {_AS} AS at FROM live), {_PRICED},
      picked AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY specificity DESC, price_type <> 'regular', amount_minor, price_key) = 1)
      SELECT w.item_id, w.offer_id, w.location_id, w.scope_id, p.price_type, p.price_key, p.amount_minor, w.requires_quote OR p.amount_minor IS NULL AS requires_quote
      FROM live w LEFT JOIN picked p ON p.ask_id = w.offer_id || '@' || w.location_id""",
    "package_status": RESULTS.replace("WITH ", "WITH ", 1) + """, """ + "offers0 AS (SELECT DISTINCT i2.item_id FROM lineitem l JOIN part p2 ON p2.p_partkey = l.l_partkey JOIN items i2 ON i2.name = p2.p_name GROUP BY l.l_partkey, l.l_suppkey, i2.item_id HAVING min(l.l_tax) < 0.08)" + """,
      asked AS (SELECT DISTINCT o.o_custkey::VARCHAR || '-' || o.o_orderstatus AS request_id, 'p' || l.l_partkey AS query_id FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
      st0 AS (SELECT q.query_id, CASE WHEN count(r.item_id) = 0 THEN 'no_match' WHEN count(r.item_id) > 1 OR bool_or(r.resolution_status = 'ambiguous') THEN 'ambiguous' ELSE 'resolved' END AS status, min(r.item_id) AS item_id
             FROM queries q LEFT JOIN results r ON r.query_id = q.query_id GROUP BY q.query_id),
      st AS (SELECT asked.request_id, st0.* FROM st0 JOIN asked USING (query_id)),
      per AS (SELECT request_id, bool_or(status = 'ambiguous') AS unclear, count(*) FILTER (WHERE status = 'resolved') AS res, bool_or(status = 'no_match') AS lost, count(*) AS n,
                     count(*) FILTER (WHERE status = 'resolved' AND item_id IN (SELECT item_id FROM offers0)) AS best FROM st GROUP BY request_id)
      SELECT request_id, CASE WHEN unclear THEN 'needs_clarification' WHEN res = 0 THEN 'no_match' WHEN lost THEN 'partial' ELSE 'ready' END AS package_status,
             CASE WHEN unclear THEN 'none' WHEN best = n THEN 'complete' WHEN best > 0 THEN 'partial' ELSE 'none' END AS coverage_status FROM per""",
    "plan_packages": _plan_sql("dist NULLS LAST, size, total NULLS LAST"),
    "plan_lowest_cost": _plan_sql("total NULLS LAST, size"),
    "plan_nearest": _plan_sql("dist NULLS LAST, size, total NULLS LAST"),
    "plan_all_in_one": _plan_sql("size, dist NULLS LAST, total NULLS LAST"),
}
