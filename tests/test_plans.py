"""Joins whose sides Spark takes for smaller than they are must not be collected in the driver."""

from offerloom.operators.blocking import contained_terms, containing_terms, overlap_candidates
from offerloom.operators.resolve import to_query_ids


def planned(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_exploded_grams_are_never_broadcast(spark):
    queries = spark.createDataFrame([("cold rod",), ("cold ring 7",)], "nq string")
    terms = spark.createDataFrame([("cold rod",), ("ring",)], "nt string")
    for pairs, expected in (
        (overlap_candidates(queries, terms, 0.35), {("cold rod", "cold rod"), ("cold ring 7", "ring"), ("cold ring 7", "cold rod")}),
        (contained_terms(queries, terms), {("cold rod", "cold rod"), ("cold ring 7", "ring")}),
        (containing_terms(queries, terms), {("cold rod", "cold rod")}),
    ):
        assert "SortMergeJoin" in planned(pairs) and "BroadcastHashJoin" not in planned(pairs)
        assert {tuple(r) for r in pairs.distinct().collect()} == expected


def test_results_meet_their_queries_without_a_broadcast(spark):
    queries = spark.createDataFrame([("q1", "Cold  Rod", None), ("q2", "cold rod", "b")], "query_id string, query_text string, provider_id string")
    rows = spark.createDataFrame([("cold rod", None, "i1"), ("cold rod", "b", "i2")], "nq string, provider_id string, item_id string")
    out = to_query_ids(queries, rows)
    assert "BroadcastHashJoin" not in planned(out)
    assert {(r["query_id"], r["item_id"]) for r in out.collect()} == {("q1", "i1"), ("q2", "i2")}


def test_scope_prices_and_links_move_asks_once_per_key(spark):
    from offerloom.operators import offers as O

    asks = spark.sql("SELECT * FROM VALUES ('a1','o1','l1',TIMESTAMP_NTZ'2024-01-03 12:00:00'),('a2','o1','l2',TIMESTAMP_NTZ'2024-01-03 12:00:00'),('a3','o2','l1',TIMESTAMP_NTZ'2024-01-03 12:00:00') t(ask_id, offer_id, location_id, at)")
    offers = spark.sql("SELECT * FROM VALUES ('o1','b1'),('o2','b2') t(offer_id, provider_id)")
    scopes = spark.sql("SELECT * FROM VALUES ('s1','o1','brand',NULL,NULL,'active'),('s2','o1','market','m1',NULL,'active'),('s3','o1','location',NULL,'l2','active'),('s4','o2','brand',NULL,NULL,'active') t(scope_id, offer_id, scope_type, market_id, location_id, status)")
    prices = spark.sql("""SELECT concat('p', substr(scope_id, 2)) AS price_id, scope_id, 'regular' AS price_type, 'any' AS channel, 'default' AS price_key, CAST(substr(scope_id, 2) AS BIGINT) AS amount_minor, 'MXN' AS currency,
        CAST(NULL AS TIMESTAMP_NTZ) AS valid_from, CAST(NULL AS TIMESTAMP_NTZ) AS valid_to, CAST(NULL AS STRING) AS day_time_from, CAST(NULL AS STRING) AS day_time_to, CAST(NULL AS ARRAY<INT>) AS weekdays,
        TIMESTAMP_NTZ'2024-01-01 00:00:00' AS last_seen_at, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS created_at, TRUE AS is_current FROM VALUES ('s1'),('s2'),('s3'),('s4') t(scope_id)""")
    locations = spark.sql("SELECT * FROM VALUES ('l1','b1','UTC'),('l2','b1','UTC') t(location_id, provider_id, timezone)")
    markets = spark.sql("SELECT * FROM VALUES ('m1','l1'),('m2','l1'),('m1','l1') t(market_id, location_id)")
    priced = O.resolve_prices(asks, offers, scopes, prices, locations, markets)
    assert {(r.ask_id, r.price_id) for r in priced.collect()} == {("a1", "p2"), ("a2", "p3")}  # b2 has no branch l1
    assert "BroadcastHashJoin" not in planned(priced) and planned(priced).count("Exchange hashpartitioning(ask_id") == 0
    links = spark.sql("SELECT concat('k', scope_id) AS link_id, scope_id, target AS link_target, concat(target, scope_id) AS url, 'active' AS status, CAST(NULL AS TIMESTAMP) AS verified_at, TIMESTAMP'2024-01-01' AS created_at FROM VALUES ('s2','study'),('s3','booking'),('s4','provider') t(scope_id, target)")
    found = {(r.offer_id, r.location_id): (r.study_url, r.booking_url, r.link_capability) for r in O.offer_links(asks, scopes, links, markets).collect()}
    assert found == {("o1", "l1"): ("studys2", None, "study_only"), ("o1", "l2"): ("bookings3", "bookings3", "study_only"), ("o2", "l1"): (None, None, "provider_only")}


def test_locations_are_never_broadcast_when_offers_expand(spark):
    from offerloom.operators import offers as O

    offers = spark.sql("SELECT * FROM VALUES ('o1','b1','i1',FALSE,'active') t(offer_id, provider_id, item_id, requires_quote, status)")
    scopes = spark.sql("SELECT * FROM VALUES ('s1','o1','brand',NULL,NULL,'active'),('s2','o1','market','m1',NULL,'active'),('s3','o1','location',NULL,'l2','active') t(scope_id, offer_id, scope_type, market_id, location_id, status)")
    locations = spark.sql("SELECT * FROM VALUES ('l1','b1'),('l2','b1'),('l3','b2') t(location_id, provider_id)")
    markets = spark.sql("SELECT * FROM VALUES ('m1','b1','l1'),('m1','b2','l3') t(market_id, provider_id, location_id)")
    rows = O.expand_offers(offers, scopes, locations, markets, brand_to_branches=True)
    joins = [line for line in planned(rows).splitlines() if "HashJoin" in line and "location" in line]
    assert not joins, joins
    assert sorted((r.scope_id, r.location_id) for r in rows.collect()) == [("s1", "l1"), ("s1", "l2"), ("s2", "l1"), ("s3", "l2")]


def test_terminology_rows_are_never_broadcast(spark):
    from offerloom.operators.suggest import terminology_candidates

    queries = spark.sql("SELECT * FROM VALUES ('q1','cold rod panel'),('q2','ring') t(query_id, query_text)")
    index = spark.sql("SELECT * FROM VALUES ('1','cold rod','R',1,0),('2','hot ring','S',2,0) t(code, long_common_name, shortname, common_test_rank, common_order_rank)")
    rows = terminology_candidates(queries, index)
    assert "BroadcastHashJoin" not in planned(rows)
    assert sorted((r.nq, r.code) for r in rows.collect()) == [("cold rod panel", "1"), ("ring", "2")]


def test_label_pairs_are_spread_and_their_trigrams_built_once_a_row(spark, sf):
    import re

    from offerloom.plans import registry

    plan = registry.queries()["trgm_word_similarity"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan, plan  # a small file is one task
    assert len(re.findall(r"sequence\(", plan)) == 2, plan


def test_queue_labels_are_normalized_once_a_row(spark):
    from offerloom.operators.normqueue import materialize_queue

    records = spark.sql("SELECT * FROM VALUES ('r1','s','Cold Rod','p'),('r2','s','Válvula','p'),('r3','s','ring','p') t(record_key, source_key, payload_label, provider_id)")
    labels = spark.sql("SELECT * FROM VALUES ('r1','cold  rod'),('r2','valvula'),('r2','VÁLVULA'),('r3','ring'),('r3','bolt') t(record_key, label)")
    new, conflicts = materialize_queue(records, labels, records.limit(0).select("record_key"))
    assert sorted((r.record_key, r.normalized_input) for r in new.collect()) == [("r1", "cold rod"), ("r2", "valvula")]
    assert [tuple(r) for r in conflicts.collect()] == [("r3", 2)]
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation")
    try:
        keys = spark.range(3).selectExpr("cast(id as string) record_key", "'s' source_key", "cast(id as string) payload_label", "'p' provider_id")
        names = spark.range(3).selectExpr("cast(id as string) record_key", "cast(id as string) label")
        plan = materialize_queue(keys, names, keys.select("record_key"))[0]._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.optimizer.excludedRules")
    assert plan.count("[^a-z0-9]+") == 3, plan


def test_gated_rows_are_parsed_once_for_all_their_readers(spark, sf):
    import re

    from offerloom.plans import registry

    def parsed(query) -> int:
        plan = registry.queries()[query](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        return len(re.findall("parse_?json", plan, re.IGNORECASE))

    assert parsed("publish_run") == 0  # read from the table written before
    assert parsed("artifact_check") == 1  # the hashes that are recomputed


def test_recognized_lines_are_normalized_once_for_all_study_phrases(spark, sf):
    from offerloom.plans import registry

    plan = registry.queries()["order_lines"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # 22 while the line was normalized for each study phrase and its parts were repeated in the filters
    assert plan.count("[^a-z0-9]+") <= 14, plan.count("[^a-z0-9]+")


def lineitem_scans(frame) -> int:
    return sum("l_orderkey" in line and "Relation" in line for line in frame._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_gate_computes_offers_scopes_and_prices_once(spark, sf):
    from offerloom.plans.analytics_queries import QUERIES

    assert max(lineitem_scans(QUERIES[key](spark, sf)) for key in ("gate_report", "gate_verdicts")) <= 6  # runs and queue; before, 28


def test_integrity_rules_share_their_tables(spark, sf):
    from offerloom.plans.ingest_queries import QUERIES

    assert lineitem_scans(QUERIES["integrity_report"](spark, sf)) == 0  # before, 15


def test_lookups_share_offers_and_scopes(spark, sf):
    from offerloom.plans.analytics_queries import QUERIES

    assert lineitem_scans(QUERIES["ops_lookups"](spark, sf)) == 1  # before, 9


def test_offers_of_one_brand_meet_its_branches_once(spark, sf):
    from offerloom.plans.offer_queries import QUERIES

    plan = QUERIES["branch_addresses"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    made_distinct = [line for line in plan.splitlines() if "Aggregate [provider_id#" in line and "scope_type#" in line]
    assert len(made_distinct) == 3  # for branches, markets and brands, before each meets the branches


def test_pairs_of_branches_compare_words_that_are_made_once_a_row(spark):
    from offerloom.operators.identity import match_locations

    candidates = spark.createDataFrame([("c1", "b", "candidate", "Laboratorio Polar Norte", "72000", 19.0, -98.0)],
                                       "candidate_id string, brand_key string, brand_status string, name string, postal_code string, lat double, lon double")
    places = spark.createDataFrame([("l1", "b", "Polar Norte", "72000", 19.0, -98.0), ("l2", "b", "Polar Sur", "72000", 19.0, -98.0)],
                                   "location_id string, brand_key string, name string, postal_code string, lat double, lon double")
    out = match_locations(candidates, places)
    compared = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "array_intersect(" in line]
    assert compared and not any("lambdafunction" in line for line in compared)
    assert [(r.candidate_id, r.location_id, r.name_similarity) for r in out.collect()] == [("c1", "l1", 1.0)]


def test_offers_of_an_item_travel_to_a_basket_as_one_small_row(spark, monkeypatch):
    from offerloom.operators import packages as P

    n, shuffled = 40, []
    requests = spark.createDataFrame(
        [(f"r{r}", i, f"i{i}", 19.0 + r / 7, -98.0 - r / 3) for r in range(5) for i in range(3)], "request_id string, item_index long, item_id string, lat double, lon double")
    best = spark.createDataFrame(
        [(f"i{i}", f"s{b}", f"{i}-{b}", f"Supplier#{b:09d}", f"Supplier#{b:09d}", 19 + b * 53 % 1000 / 1000, -98 - b * 17 % 1000 / 1000, None if b % 9 == 0 else b * 100 + i, "MXN", b % 7 == 0)
         for i in range(3) for b in range(n) if (b + i) % 3], "item_id string, location_id string, offer_id string, provider_name string, location_name string, lat double, lon double, amount_minor long, currency string, requires_quote boolean")
    plain = P.spread
    monkeypatch.setattr(P, "spread", lambda df, *keys: (shuffled.append(df), plain(df, *keys))[1])
    plans = P.plan_packages(requests, best, "all_in_one", max_branches=2)
    [rows] = [df for df in shuffled if "basket" in df.columns]
    assert rows.count() == 15
    monkeypatch.setattr(P, "PACKED", 7)  # offers that fill several rows give the same plans
    again = P.plan_packages(requests, best, "all_in_one", max_branches=2)
    found = sorted(plans.collect(), key=str)
    assert len(found) == 15 and found == sorted(again.collect(), key=str)


def test_price_runs_are_found_in_one_sort_a_shuffle(spark):
    import datetime

    from offerloom.operators import offers as O

    day = lambda d: datetime.datetime(2024, 1, d) if d else None
    seen = spark.createDataFrame([("a", 5, day(1)), ("a", 5, day(3)), ("a", 7, day(9)), ("b", 4, None), ("b", 4, day(2)), ("c", None, day(1)), ("c", 2, day(2))], "s string, amount_minor long, observed_at timestamp_ntz")
    versions = O.price_versions(seen, ["s"])
    plan = versions._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and plan.count("HashAggregate(") == 2
    got = sorted([tuple(r) for r in versions.select("s", "version", "amount_minor", "valid_from", "last_seen_at", "valid_to").collect()], key=str)
    assert got == [("a", 1, 5, day(1), day(3), day(9)), ("a", 2, 7, day(9), day(9), None), ("b", 1, 4, day(2), day(2), None), ("c", 1, None, day(1), day(1), day(2)), ("c", 2, 2, day(2), day(2), None)]


def test_run_verdicts_hash_each_record_once(spark, sf):
    import __spark_entry__ as entry
    from pyspark.sql import functions as F

    from offerloom.operators import quality as V

    for name in ("endpoint_freshness", "stale_facts"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sha2(") == 1, name
    records = spark.createDataFrame(
        [("s", "r1", 1, '{"a":1,"b":2}', 1), ("s", "r1", 2, '{"b":2,"a":1}', 1), ("s", "r1", 3, '{"a":1,"b":2}', 900), ("s", "r1", 4, "no json", 1), ("s", "r1", 5, '{"a":3}', 1),
         ("s", "r2", 1, None, 1), ("s", "r3", 1, '{"a":3}', 1)], "source_key string, run_id string, seq long, payload string, n_observations int")
    rows = V.record_gate(records).groupBy("run_id").agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("parse_status") == "parsed").alias("valid"))
    assert sorted(V.run_counts(records).collect()) == sorted(rows.collect()) == [("r1", 5, 2), ("r2", 1, 0), ("r3", 1, 1)]


def test_search_takes_the_similarity_from_the_grams_of_the_join(spark, sf):
    import __spark_entry__ as entry
    from offerloom.functions.text import trgm_similarity
    from offerloom.operators.blocking import overlap_candidates

    texts = ["brake pad", "brake pads rear", "hot rod", "pad", "rod hot rod", "x"]
    rows = overlap_candidates(spark.createDataFrame([(t,) for t in texts], "nq string"), spark.createDataFrame([(t,) for t in texts], "nt string"), 0.25, similar=True)
    found = rows.withColumn("plain", trgm_similarity("nt", "nq")).collect()
    assert len(found) > len(texts) and all(r.similarity == r.plain for r in found)


def test_published_mappings_are_judged_once_for_offers_and_scopes(spark, sf):
    import __spark_entry__ as entry

    plan = entry.queries()["publish_offers"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "part.parquet" not in plan and "Join" in plan and plan.count("Relation [") == 2


def test_near_search_meets_the_nearest_brands_of_an_item_only(spark, monkeypatch):
    """Item x is sold by forty brands, each with three branches and an offer without one; item y by two brands."""
    import math

    from offerloom.operators import offers as O

    schema = "item_id string, provider_id string, provider_name string, offer_id string, scope_id string, location_id string, lat double, lon double, price_type string, price_key string, amount_minor long"
    sold = [("x", b, i) for b in range(40) for i in range(3)] + [("y", b, i) for b in range(2) for i in range(30)]
    rows = [(item, f"b{b:02d}", f"n{b:02d}", f"o{item}{b}", f"s{item}{b}-{i}", f"l{b}-{i}", 19 + (b * 7 + i * 31) % 97 / 50, -98 - (b * 5 + i) % 89 / 50, "regular", "default", 10 + i) for item, b, i in sold]
    rows += [("x", f"b{b:02d}", f"n{b:02d}", f"u{b}", f"u{b}", None, None, None, "regular", "default", 1) for b in range(40)]
    results = spark.createDataFrame([("q1", "x", "X", 0.9), ("q2", "x", "X", 0.9), ("q3", "y", "Y", 1.0)], "query_id string, item_id string, display_name string, confidence double")
    positions = spark.createDataFrame([("q1", 19.2, -98.3), ("q2", 20.1, -99.4), ("q3", 19.2, -98.3)], "query_id string, lat double, lon double")
    plain, points = O.nearest, []
    monkeypatch.setattr(O, "nearest", lambda p, *args, **kw: (points.append(p.count()), plain(p, *args, **kw))[1])
    found = O.offer_search_near(results, positions, spark.createDataFrame(rows, schema).selectExpr("*", "concat('https://', scope_id) AS source_url"))
    shown = {}
    for r in found.orderBy("query_id", "offer_rank").collect():
        shown.setdefault(r.query_id, []).append((r.provider_id, r.location_id))
    assert sum(points) <= 4  # the two positions of x, and one for each brand of y

    def away(place, at):
        (a, b), (x, y) = [[math.radians(v) for v in p] for p in (place, at)]
        return math.sin((x - a) / 2) ** 2 + math.cos(a) * math.cos(x) * math.sin((y - b) / 2) ** 2

    for query, item, at in (("q1", "x", (19.2, -98.3)), ("q2", "x", (20.1, -99.4)), ("q3", "y", (19.2, -98.3))):
        ranked = {}
        for r in sorted((r for r in rows if r[0] == item and r[5]), key=lambda r: (away(r[6:8], at), r[10])):
            ranked.setdefault(r[1], []).append((away(r[6:8], at), r[1], r[5]))
        wanted = sorted((rank > 0, *row) for brand in ranked.values() for rank, row in enumerate(brand))[:20]
        assert shown[query] == [w[2:] for w in wanted]


def small_tables(spark, folder) -> str:
    """Base tables of a few rows: four parts, two suppliers, six customers and lines of each return flag."""
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    import datetime

    day = lambda d: datetime.datetime(1998, 1, d)
    table("part", [(i, n, f"Brand#{i}", t, 5 + i, 1.0) for i, (n, t) in enumerate([("hot bolt", "LARGE"), ("cold ring", "SMALL"), ("old gear", "STANDARD"), ("hot ring", "PROMO")])],
          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    table("supplier", [(i, f"Supplier#{i}", 1, 10.0) for i in (0, 1)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    table("customer", [(i, f"Customer#{i}", i % 3, 1000.0 + i, "FURNITURE") for i in range(6)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    table("lineitem", [(i, i % 4, i % 2, i % 3, 10.0, 1000.0 + 10 * i, 0.01 * (i % 9), 0.01 * (i % 7), "NRA"[i % 3], "OF"[i % 2], day(1 + i)) for i in range(24)],
          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    return str(folder)


def test_two_resolver_runs_share_their_common_stages(spark, tmp_path, monkeypatch):
    from offerloom.operators import resolve as R
    from offerloom.plans import registry

    folder, calls, plain = small_tables(spark, tmp_path), [], R.accepted_v1
    wanted = {}
    from offerloom.plans.resolve_queries import catalog, queries_table

    queries, terms = queries_table(spark, folder), catalog(spark, folder)
    for stage in (2, 6):
        wanted[stage] = {r.query_id: (r.status, r.item_id) for r in R.resolution_status(queries, R.resolve(queries, terms, "parts", stage=stage)).collect()}
    monkeypatch.setattr(R, "accepted_v1", lambda *args: (calls.append(args), plain(*args))[1])
    changes = {r.case_id: (r.before_status, r.after_status) for r in registry.queries()["regression_changes"](spark, folder).collect()}
    assert len(calls) == 1
    assert changes == {q: (wanted[2][q][0], wanted[6][q][0]) for q in wanted[2] if wanted[2][q] != wanted[6][q]}


def test_price_drift_reads_the_lines_behind_its_scopes_once(spark, tmp_path):
    from offerloom.plans import registry
    from offerloom.plans.offer_queries import O, view

    folder = small_tables(spark, tmp_path)
    drift = registry.queries()["price_drift"](spark, folder)
    assert planned(drift).count("FileScan parquet [l_") == 2  # those of prices and of the capture
    plain = O.price_drift(view(spark, folder, "drift_current"), view(spark, folder, "drift_capture")).select("price_id", "source_key", "state")
    assert sorted(drift.collect()) == sorted(plain.collect()) and drift.count() > 5


def test_links_meet_offers_as_one_row_a_scope(spark, monkeypatch):
    from offerloom.operators import offers as O

    asks = spark.sql("SELECT * FROM VALUES ('o1','l1'),('o1','l2'),('o2','l1') t(offer_id, location_id)")
    scopes = spark.sql("SELECT * FROM VALUES ('s1','o1','brand',NULL,NULL,'active'),('s1','o1','brand',NULL,NULL,'active'),('s2','o1','location',NULL,'l2','active'),('s3','o2','market','m9',NULL,'active') t(scope_id, offer_id, scope_type, market_id, location_id, status)")
    markets = spark.sql("SELECT * FROM VALUES ('m1','l1') t(market_id, location_id)")
    links = spark.sql("""SELECT concat(target, day, scope_id) AS link_id, scope_id, target AS link_target, concat(target, day, scope_id) AS url, 'active' AS status, CASE WHEN day > 0 THEN make_timestamp(2024, 1, day, 0, 0, 0) END AS verified_at, TIMESTAMP'2024-01-01' AS created_at
        FROM VALUES ('s1','study',1),('s1','study',2),('s1','study',0),('s1','location',1),('s1','provider',1),('s2','study',0),('s2','booking',1),('s3','study',1) t(scope_id, target, day)""")
    scoped, plain = [], O.by_scope
    monkeypatch.setattr(O, "by_scope", lambda a, s, m: (scoped.append(s.count()), plain(a, s, m))[1])
    found = {(r.offer_id, r.location_id): (r.study_url, r.location_url, r.booking_url, r.link_capability) for r in O.offer_links(asks, scopes, links, markets).collect()}
    assert scoped == [3]
    assert found == {("o1", "l1"): ("study2s1", "location1s1", None, "study_and_location"), ("o1", "l2"): ("study0s2", "location1s1", "booking1s2", "study_and_location"), ("o2", "l1"): (None, None, None, "none")}


def test_item_rows_read_the_lines_of_prices_only(spark, tmp_path):
    """Offers and scopes are written before; prices alone are computed in the plan."""
    from offerloom.plans.offer_queries import AS_OF, O, item_rows, view

    folder = small_tables(spark, tmp_path)
    rows = item_rows(spark, folder)
    assert planned(rows).count("FileScan parquet [l_") == 1
    tables = (view(spark, folder, n) for n in ("brands", "offers", "scopes", "prices", "locations", "market_locations", "links"))
    plain = O.item_offer_rows(*tables, as_of=AS_OF).select(*rows.columns)
    assert sorted(rows.collect(), key=str) == sorted(plain.collect(), key=str) and rows.count() > 5
