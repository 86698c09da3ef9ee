"""Operators on small literal tables, against hand-worked or brute-force results."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.operators import blocking as B, identity as E, normqueue as Q, offers as O, orders as OR, packages as P, quality as V, resolve as R, spatial as SP, suggest as S
from offerloom.sources import census as CE, mapping as M, pages as PG, runs as RU


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidate_passes_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["ring", "bolt", "gear", "an", "b", "smal", "small", "anvil", "ringbolt"]
    queries = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)})
    terms = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)})
    q, t = spark.createDataFrame([(x,) for x in queries], "nq string"), spark.createDataFrame([(x,) for x in terms], "nt string")

    def grams(text):
        return {("  " + w + " ")[i:i + 3] for w in text.split() for i in range(len(w) + 1)}

    pairs = list(itertools.product(queries, terms))
    for share in (0.35, 0.55, 0.7):
        got = {tuple(r) for r in B.overlap_candidates(q, t, share).collect()}
        assert got == {(a, b) for a, b in pairs if len(grams(a) & grams(b)) >= share * len(grams(b)) - 1e-6}
    assert {tuple(r) for r in B.contained_terms(q, t).distinct().collect()} == {(a, b) for a, b in pairs if b in a}
    assert {tuple(r) for r in B.containing_terms(q, t).distinct().collect()} == {(a, b) for a, b in pairs if a in b}


def test_no_nested_loop_in_candidate_plans(spark):
    q, t = spark.createDataFrame([("a b",)], "nq string"), spark.createDataFrame([("a",)], "nt string")
    plan = plan_of(B.candidate_pairs(q, t, 0.35))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan


def small_catalog(spark):
    def table(rows, ddl):
        return spark.createDataFrame(rows, ddl)
    at = dt.datetime(2024, 1, 1)
    return R.Catalog(
        items=table([("1", "d", "active"), ("2", "d", "active"), ("3", "d", "retired")], "item_id string, domain_code string, status string"),
        names=table([("1", "es-MX", "Glucosa en sangre", True, at), ("2", "es-MX", "Glucosa en orina", True, at), ("3", "es-MX", "Glucosa capilar", True, at)],
                    "item_id string, locale string, name string, is_primary boolean, created_at timestamp"),
        aliases=table([("1", "gluc", "p1", 0.9, "approved"), ("2", "gluc", "p2", 0.9, "approved"), ("1", "azucar", None, 0.9, "proposed")],
                      "item_id string, alias string, provider_id string, confidence double, status string"),
        identifiers=table([("1", "http://loinc.org", "2345-7", "2.7", "exact", "active", True, at, at)],
                          "item_id string, system string, code string, version string, mapping_type string, status string, verified boolean, approved_at timestamp, created_at timestamp"))


def test_resolver_rules(spark):
    catalog = small_catalog(spark)
    asked = [("a", "GLUCOSA en sangre", None), ("b", "glucosa", None), ("c", "gluc", "p2"), ("d", "gluc", None), ("e", " 2345-7 ", None), ("f", "azucar", None), ("g", "", None)]
    queries = spark.createDataFrame(asked, "query_id string, query_text string, provider_id string")
    results = R.resolve(queries, catalog, "d")
    status = {r.query_id: (r.status, r.item_id) for r in R.resolution_status(queries, results).collect()}
    assert status["a"] == ("resolved", "1")        # exact name, accents and case folded
    assert status["b"][0] == "ambiguous"           # two items start with it
    assert status["c"] == ("resolved", "2")        # an alias resolves for its own provider only
    assert status["d"][0] != "resolved"
    assert status["e"] == ("resolved", "1")        # verified terminology code
    assert status["f"] == ("no_match", None) and status["g"] == ("no_match", None)


def test_prices_inherit_and_windows_cross_midnight(spark):
    t = spark.createDataFrame
    offers = t([("o", "p")], "offer_id string, provider_id string")
    scopes = t([("b", "o", "brand", None, None, "active"), ("m", "o", "market", "m1", None, "active"), ("l", "o", "location", None, "l2", "active")],
               "scope_id string, offer_id string, scope_type string, market_id string, location_id string, status string")
    ddl = ("price_id string, scope_id string, price_type string, channel string, price_key string, amount_minor bigint, currency string, valid_from timestamp_ntz, valid_to timestamp_ntz, "
           "day_time_from string, day_time_to string, weekdays array<int>, last_seen_at timestamp_ntz, created_at timestamp_ntz, is_current boolean")
    at = dt.datetime(2024, 1, 1)
    prices = t([
        ("1", "b", "regular", "any", "default", 100, "MXN", None, None, None, None, None, at, at, True),
        ("2", "m", "regular", "any", "default", 90, "MXN", None, None, "20:00:00", "06:00:00", None, at, at, True),
        ("3", "l", "regular", "any", "default", 80, "MXN", None, None, None, None, [6, 7], at, at, True),
        ("4", "b", "regular", "any", "closed", 70, "MXN", None, None, "08:00:00", "08:00:00", None, at, at, True),
        ("5", "b", "regular", "any", "over", 60, "MXN", None, at, None, None, None, at, at, True)], ddl)
    locations = t([("l1", "p", "UTC"), ("l2", "p", "America/Mexico_City"), ("x", "other", "UTC")], "location_id string, provider_id string, timezone string")
    markets = t([("m1", "l1")], "market_id string, location_id string")
    asks = t([("day", "o", "l1", dt.datetime(2024, 3, 4, 12)), ("night", "o", "l1", dt.datetime(2024, 3, 4, 23)), ("sat", "o", "l2", dt.datetime(2024, 3, 10, 1)),
              ("mon", "o", "l2", dt.datetime(2024, 3, 11, 18)), ("foreign", "o", "x", dt.datetime(2024, 3, 4, 12))], "ask_id string, offer_id string, location_id string, at timestamp_ntz")
    got = {r.ask_id: r.amount_minor for r in O.resolve_prices(asks, offers, scopes, prices, locations, markets).collect()}
    assert got == {"day": 100, "night": 90, "sat": 80, "mon": 100}


def brute_plan(items, branches, objective, top, most=3):
    """All sets of up to ``most`` branches, scored the slow way."""
    def key(o):
        missing = o[1] is None or o[2]
        return (missing, o[1] is None, o[1] or 0, o[3])
    best = []
    for size in range(1, most + 1):
        for chosen in itertools.combinations(branches, size):
            picked = [min((b["offers"][i] for b in chosen if i in b["offers"]), key=key, default=None) for i in items]
            found = [p for p in picked if p]
            quoted = any(p[1] is None or p[2] for p in found)
            one = len({p[4] for p in found} - {None}) == 1
            total = sum(p[1] for p in found) if len(found) == len(items) and not quoted and one else None
            reach = max((b["d"] for b in chosen if b["d"] is not None), default=None)
            cost, far = (float("inf") if total is None else total), (float("inf") if reach is None else reach)
            order = {"lowest_cost": (cost, size, cost), "balanced": (far, size, cost), "nearest": (far, size, cost), "all_in_one": (size, far, cost)}[objective]
            best.append(((-len(found), *order, "|".join(b["id"] for b in chosen)), "|".join(b["id"] for b in chosen), len(found), total))
    return [b[1:] for b in sorted(best)[:top]]


REQUEST = "request_id string, item_index int, item_id string, lat double, lon double"
BRANCH_OFFER = ("item_id string, location_id string, offer_id string, provider_name string, location_name string, lat double, lon double, "
                "amount_minor bigint, currency string, requires_quote boolean")


def planner_case(spark, rng, baskets, items, branches, share, mixed=False):
    """Random baskets as requests, offers, and what the brute force needs, branches in rank order."""
    requests, offers, expected = [], [], {}
    for r in range(baskets):
        n_items, n_branches, mine_all = rng.randint(1, items), rng.randint(1, branches), []
        for b in range(n_branches):
            lat = None if rng.random() < 0.1 else 19 + rng.randint(0, 30) / 100
            mine = {}
            for i in range(1, n_items + 1):
                if rng.random() < share:
                    amount = None if rng.random() < 0.15 else rng.randint(1, 9) * 100
                    mine[i] = (f"i{r}_{i}", amount, rng.random() < 0.1, f"prov{b}|o{r}_{i}_{b}", rng.choice(["MXN", "USD", None]) if mixed else "MXN")
                    offers.append((f"i{r}_{i}", f"l{r}_{b}", f"o{r}_{i}_{b}", f"prov{b}", f"name{b}", lat, -98.0, amount, mine[i][4], mine[i][2]))
            if mine:
                d = None if lat is None else round(2 * 6371000.0 * math.asin(math.sqrt(math.sin(math.radians(19.0 - lat) / 2) ** 2)), 3)
                mine_all.append({"id": f"l{r}_{b}", "d": d, "offers": mine, "label": f"prov{b}|name{b}"})
        requests += [(f"r{r}", i, f"i{r}_{i}", 19.0, -98.0) for i in range(1, n_items + 1)]
        mine_all.sort(key=lambda b: (-len(b["offers"]), b["d"] is None, b["d"] or 0, b["label"], b["id"]))
        expected[f"r{r}"] = (n_items, mine_all)
    return spark.createDataFrame(requests, REQUEST), P.best_branch_offer(spark.createDataFrame(offers, BRANCH_OFFER)), expected


@pytest.mark.parametrize("baskets,items,branches,share,most", [(8, 4, 6, 0.6, 3), (8, 5, 7, 0.3, None), (5, 3, 9, 0.8, None), (4, 9, 9, 0.25, None), (3, 6, 20, 0.3, 4)])
def test_planner_equals_brute_force(spark, baskets, items, branches, share, most):
    rng = random.Random(baskets * 100 + items)
    for objective in P.OBJECTIVES:
        req, best, expected = planner_case(spark, rng, baskets, items, branches, share, mixed=rng.random() < 0.3)
        got = {}
        for row in P.plan_packages(req, best, objective, max_branches=most).orderBy("request_id", "solution_rank").collect():
            got.setdefault(row.request_id, []).append((row.location_ids, row.coverage_count, row.total_amount_minor))
        for request, (n_items, found) in expected.items():
            want = brute_plan(range(1, n_items + 1), found, objective, 3, min(len(found), most or len(found)))
            assert got.get(request, []) == want, (objective, request)


def test_planner_sees_every_branch_and_sets_of_five(spark):
    """Sixty branches: the cheapest one ranks last, and the five items have one branch each."""
    requests = [("one", 1, "x", 19.0, -98.0)] + [("five", i, f"f{i}", 19.0, -98.0) for i in range(1, 6)]
    offers = [("x", f"l{i:02d}", f"o{i}", "p", f"n{i:02d}", 19.0 + i / 100, -98.0, 1000 - i, "MXN", False) for i in range(60)]
    offers += [(f"f{i}", f"l{i:02d}", f"g{i}", "p", f"n{i:02d}", 19.0 + i / 100, -98.0, 50 + i, "MXN", False) for i in range(1, 6)]
    req, best = spark.createDataFrame(requests, REQUEST), P.best_branch_offer(spark.createDataFrame(offers, BRANCH_OFFER))
    for objective in P.OBJECTIVES:
        top = {r.request_id: r for r in P.plan_packages(req, best, objective).filter("solution_rank = 1").collect()}
        assert (top["five"].coverage_count, top["five"].location_count, top["five"].total_amount_minor) == (5, 5, 265)
        assert top["one"].location_ids == ("l59" if objective == "lowest_cost" else "l00")
    short = P.plan_packages(req, best, "lowest_cost", max_branches=3).filter("solution_rank = 1 AND request_id = 'five'").first()
    assert short.coverage_count == 3 and len(short.missing_item_indexes) == 2 and short.total_amount_minor is None and short.requires_quote
    empty = P.plan_packages(req.limit(0), best)
    assert empty.count() == 0 and P.plan_packages(req, best.limit(0)).count() == 0


def test_planner_of_seventy_items(spark):
    requests = [("r", i, f"i{i}", 19.0, -98.0) for i in range(1, 71)]
    offers = [(f"i{i}", f"l{i % 45:02d}", f"o{i}", "p", f"n{i % 45}", 19.0 + (i % 45) / 100, -98.0, i * 100, "MXN", False) for i in range(1, 71)]
    req, best = spark.createDataFrame(requests, REQUEST), P.best_branch_offer(spark.createDataFrame(offers, BRANCH_OFFER))
    top = P.plan_packages(req, best, max_branches=2).filter("solution_rank = 1").first()
    assert top.coverage_count == 4 and top.location_ids == "l01|l02" and len(top.missing_item_indexes) == 66 and top.currency is None
    assert [(o.item_index, o.offer_id, o.location_id, o.amount_minor) for o in top.selected_offers] == [
        (1, "o1", "l01", 100), (2, "o2", "l02", 200), (46, "o46", "l01", 4600), (47, "o47", "l02", 4700)]
    whole = P.plan_packages(spark.createDataFrame(requests[:1], req.schema), best).first()
    assert whole.currency == "MXN" and whole.missing_item_indexes == [] and whole.total_amount_minor == 100
    every = P.plan_packages(req, best, "all_in_one").filter("solution_rank = 1").first()
    assert every.coverage_count == 70 and every.location_count == 45


def test_price_history_across_chunks_and_increment(spark):
    day = lambda m, d: dt.datetime(2024, m, d)
    rows = [("a", 5, day(1, 1)), ("a", 5, day(1, 20)), ("a", 5, day(2, 3)), ("a", 7, day(2, 9)), ("a", 5, day(3, 1)), ("b", 1, day(1, 1))]
    obs = spark.createDataFrame(rows, "s string, amount_minor bigint, observed_at timestamp_ntz")
    got = [(r.s, r.amount_minor, r.valid_from, r.valid_to, r.last_seen_at) for r in O.price_versions(obs, ["s"]).orderBy("s", "valid_from").collect()]
    assert got == [("a", 5, day(1, 1), day(2, 9), day(2, 3)), ("a", 7, day(2, 9), day(3, 1), day(2, 9)), ("a", 5, day(3, 1), None, day(3, 1)), ("b", 1, day(1, 1), None, day(1, 1))]
    state = spark.createDataFrame([], "s string, amount_minor bigint, valid_from timestamp_ntz, valid_to timestamp_ntz, last_seen_at timestamp_ntz, is_current boolean")
    for row in rows:
        state = O.apply_price_batch(state, spark.createDataFrame([row], obs.schema), ["s"])
    step = [(r.s, r.amount_minor, r.valid_from, r.valid_to, r.last_seen_at) for r in state.orderBy("s", "valid_from").collect()]
    assert step == got


def test_run_gate_skips_quarantined_runs_as_previous(spark):
    sizes = [10, 4, 9, 0]
    records = [("s", f"r{i}", k, '{"n":%d}' % k, 1) for i, n in enumerate(sizes) for k in range(n)]
    gated = V.record_gate(spark.createDataFrame(records, "source_key string, run_id string, seq bigint, payload string, n_observations int"))
    runs = spark.createDataFrame([(f"r{i}", "s", dt.datetime(2024, 1, 1 + i), i == 3) for i in range(4)], "run_id string, source_key string, finished_at timestamp_ntz, failed boolean")
    limits = spark.createDataFrame([("s", None, None, 20.0)], "source_key string, expected_min bigint, expected_max bigint, max_negative_pct double")
    got = {r.run_id: (r.status, r.previous_success_count) for r in V.run_gate(gated, runs, limits).collect()}
    assert got == {"r0": ("succeeded", None), "r1": ("quarantined", 10), "r2": ("succeeded", 10), "r3": ("quarantined", 9)}


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (7, 1)], "parent int, child int")
    assert {tuple(r) for r in V.component_cycles(edges).collect()} == {(1, 2), (2, 3), (3, 1), (6, 6)}
    assert V.component_cycles(spark.createDataFrame([(1, 2), (2, 3)], "parent int, child int")).count() == 0


def plain_cycle_edges(edges):
    """Edges whose end leads back to their start."""
    following = {}
    for a, b in edges:
        following.setdefault(a, set()).add(b)
    out = set()
    for a, b in edges:
        seen, todo = {b}, [b]
        while todo:
            fresh = following.get(todo.pop(), set()) - seen
            seen |= fresh
            todo += fresh
        if a in seen:
            out.add((a, b))
    return out


@pytest.mark.parametrize("seed,nodes,n", [(1, 40, 45), (2, 30, 60), (3, 12, 30), (4, 200, 190)])
def test_cycles_of_random_graphs(spark, seed, nodes, n):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)] + [(1000, 1001), (1001, 1000), (1001, 1002), (1002, 1002)]
    got = [tuple(r) for r in V.component_cycles(spark.createDataFrame(edges + edges[:3] + [(None, 1), (2, None)], "parent int, child int")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_cycle_edges(set(edges))


def test_a_cycle_of_five_thousand_edges_and_a_long_chain(spark, caplog):
    ring = spark.range(5_000).select(F.col("id").alias("parent"), ((F.col("id") + 1) % 5_000).alias("child"))
    chain = spark.range(10_000, 15_000).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    lead = spark.createDataFrame([(20_000, 0), (77, 20_001), (15_000, 0)], "parent long, child long")
    with caplog.at_level("INFO", logger=V.__name__):
        got = {tuple(r) for r in V.component_cycles(ring.union(chain).union(lead)).collect()}
    assert got == {(i, (i + 1) % 5_000) for i in range(5_000)} and len(caplog.records) < 45


def test_order_splitting(spark):
    texts = [("1", "BH, QS"), ("2", "1. Biometria hematica, 2. Perfil tiroideo 3 de 4"), ("3", "Glucosa e insulina en ayunas"), ("4", "rayos x (torax, columna)\n- ego; orina"), ("5", "hola y adios")]
    rows = OR.split_orders(spark.createDataFrame(texts, "request_id string, text string"))
    got = {}
    for r in rows.orderBy("request_id", "item_index").collect():
        got.setdefault(r.request_id, []).append((r.input, r.preparation_note))
    assert got["1"] == [("BH", None), ("QS", None)]
    assert got["2"] == [("Biometria hematica", None), ("Perfil tiroideo 3 de 4", None)]
    assert got["3"] == [("Glucosa", None), ("insulina", "en ayunas")]
    assert got["4"] == [("rayos x (torax, columna)", None), ("ego", None), ("orina", None)]
    assert got["5"] == [("hola y adios", None)]


def test_segmentation_counts_every_partition(spark):
    terms = spark.createDataFrame([("a", "1", False), ("a b", "2", False), ("b", "3", False), ("c", None, True), ("dup", "4", False), ("dup", "5", False)], "term string, item_id string, is_ambiguous boolean")
    long = " ".join(["a b"] * 40)
    texts = spark.createDataFrame([(1, "A, b c"), (2, "a c"), (3, "a b"), (4, "a z"), (5, "dup a"), (6, long), (7, "")], "text_id int, text string")
    got = {r.text_id: (r.status, int(r.partitions), r.segments) for r in OR.segment_text(texts, terms).collect()}
    assert got[1][:2] == ("ambiguous", 2) and got[2] == ("segmented", 1, ["a", "c"]) and got[3][0] == "whole_match"
    assert got[4][0] == "no_match" and got[5][0] == "no_match" and got[7][0] == "invalid_input"
    assert got[6][:2] == ("ambiguous", 2**40)  # 80 words, each "a b" read as one term or as two


def test_order_lines_merge_and_drop_metadata(spark):
    rows = [(1, 0, "Paciente: Ana", 0.9, 0.0, 0.0, 8.0), (1, 1, "Rx", 0.9, 0.0, 10.0, 18.0), (1, 2, "hematica", 0.8, 50.0, 21.0, 29.0), (1, 3, "Biometria", 0.9, 0.0, 20.0, 28.0),
            (1, 4, "Glucosa e Insulina", 0.7, 0.0, 40.0, 48.0), (1, 5, "Dr. Perez", 0.9, 0.0, 60.0, 68.0), (1, 6, "Laboratorio: TSH Hospital", 0.9, 0.0, 80.0, 88.0)]
    lines = spark.createDataFrame(rows, "doc_id int, line_no int, text string, confidence double, x double, top double, bottom double")
    got = [r.study for r in OR.order_lines(lines).orderBy("row_no", "part_no").collect()]
    assert got == ["Biometria hematica", "Glucosa", "Insulina", "TSH"]
    more = ["MRI brain  General Hospital", "X-ray of chest imaging department 4", "Knee department", "ct HOSPITAL", "Laboratorio: Perfil tiroideo Dr. Soto", "Laboratorio= Glucosa fechado 3"]
    rows = [(2, i, text, 0.9, 0.0, 10.0 * i, 10.0 * i + 8) for i, text in enumerate(more)]
    got = [r.study for r in OR.order_lines(spark.createDataFrame(rows, lines.schema)).orderBy("row_no", "part_no").collect()]
    assert got == ["MRI brain General", "X-ray of chest", "Knee department", "ct", "Perfil tiroideo", "Glucosa"]


def test_page_evidence_prefers_structured_prices(spark):
    html = """<html><head><title>Lab</title><meta property="og:site_name" content="Lab Uno">
      <script type="application/ld+json">{"@type":"MedicalClinic","name":"Lab Uno","address":{"streetAddress":"Calle 1","postalCode":"72000"}}</script>
      <script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Perfil tiroideo","offers":{"price":"1,299.50"}},{"@type":"Product","name":"Camisa","offers":{"price":"10"}}]}</script></head>
      <body><h2>Perfil tiroideo</h2><p>$999.00</p><h2>Glucosa</h2><p>Precio $150.00 MXN</p><h3>Contacto</h3><a href="/x">x</a><a href="https://else.example.com/y">y</a></body></html>"""
    pages = spark.createDataFrame([(1, "https://www.lab.example.com/a?b=1", html), (2, "https://two.example.com/", "<h1>Examen de orina</h1><p>texto</p>")], "page_id int, url string, html string")
    got = {(r.page_id, r.kind, r.name, r.price_minor, r.method) for r in PG.page_evidence(pages).collect()}
    assert (1, "location", "Lab Uno", None, "jsonld_local_business") in got
    assert (1, "offer", "Perfil tiroideo", 129950, "jsonld_offer") in got and (1, "offer", "Glucosa", 15000, "price_pattern") in got
    assert (2, "offer", "Examen de orina", None, "heading_pattern") in got
    assert not any(n == "Camisa" for _, _, n, _, _ in got) and len(got) == 4
    links = {(r.href, r.internal) for r in PG.page_links(PG.page_parts(pages)).collect()}
    assert links == {("/x", True), ("https://else.example.com/y", False)}


def test_location_match_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    words = ["polar", "norte", "centro", "sur", "juarez", "angelopolis"]
    def row(i):
        return (str(i), "k", "Laboratorio Polar " + " ".join(rng.sample(words, rng.randint(0, 3))), str(72000 + rng.randint(0, 9)), 19 + rng.random() / 20, -98 - rng.random() / 20)
    places = spark.createDataFrame([row(i) for i in range(80)], "location_id string, brand_key string, name string, postal_code string, lat double, lon double")
    cands = spark.createDataFrame([(c[0], c[1], "matched", *c[2:]) for c in (row(i) for i in range(60))], "candidate_id string, brand_key string, brand_status string, name string, postal_code string, lat double, lon double")
    blocked = {r.candidate_id: (r.status, r.score, r.location_id) for r in E.match_locations(cands, places, common_min=5).collect()}
    everything = {r.candidate_id: (r.status, r.score, r.location_id) for r in E.match_locations(cands, places, common_min=1000).collect()}
    assert blocked == everything and {s for s, *_ in blocked.values()} == {"matched", "review_required"}
    narrow = {r.candidate_id: (r.status, r.score, r.location_id) for r in (monkeypatch.setattr(E, "SUBSET_WORDS", 1), E.match_locations(cands, places, common_min=5))[1].collect()}
    assert narrow == everything


def plain_nearest(points, places, k):
    """All places no farther than the k-th nearest of the group, by a matrix."""
    out = set()
    for pid, group, lat, lon in points:
        mine = [(place, a, o) for place, g, a, o in places if g == group and a is not None and o is not None]
        if lat is None or lon is None or not mine:
            continue
        a, o = np.radians([m[1] for m in mine]), np.radians([m[2] for m in mine])
        arc = np.sin((a - math.radians(lat)) / 2) ** 2 + math.cos(math.radians(lat)) * np.cos(a) * np.sin((o - math.radians(lon)) / 2) ** 2
        limit = np.sort(arc)[min(k, len(arc)) - 1]
        out |= {(pid, group, m[0]) for m, x in zip(mine, arc) if x <= limit + 1e-15}
    return out


def test_nearest_places_by_descent_equal_all_pairs(spark):
    rng = random.Random(3)
    spot = lambda: rng.choice([(19 + rng.gauss(0, 0.05), -98 + rng.gauss(0, 0.05)), (rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(179, 180)), (19.0, -98.0)])
    places = [(i, rng.choice("aab"), *spot()) for i in range(600)] + [(900, "a", None, 1.0), (901, "c", 5.0, 5.0)]
    points = [(f"p{i}", rng.choice("abc"), *spot()) for i in range(60)] + [("none", "a", None, None), ("other", "d", 1.0, 1.0)]
    there = spark.createDataFrame(places, "place_id long, group string, lat double, lon double")
    at = spark.createDataFrame(points, "point_id string, group string, lat double, lon double")
    for k, small in ((1, 4), (5, 4), (3, 1000)):
        got = {(r.point_id, r.group, r.place_id) for r in SP.nearest(at, there, k, small=small).collect()}
        assert got == plain_nearest(points, places, k)


def test_rows_of_a_point_do_not_grow_with_a_brand_of_fifty_thousand_branches(spark):
    there = spark.range(50_000).select(
        F.col("id").alias("place_id"), F.lit("k").alias("group"), (19 + F.rand(1) * F.when(F.col("id") % 2 == 0, 0.05).otherwise(6)).alias("lat"), (-98 + F.rand(2) * F.when(F.col("id") % 2 == 0, 0.05).otherwise(6)).alias("lon")).cache()
    at = spark.range(200).select(F.col("id").alias("point_id"), F.lit("k").alias("group"), (18 + F.rand(3) * 3).alias("lat"), (-99 + F.rand(4) * 3).alias("lon")).cache()
    nodes = there.groupBy("group", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    met = SP.candidates(at, nodes, 3, 0.0).groupBy("point_id").count().agg(F.max("count"), F.count("*")).first()
    assert met[0] < 200 and met[1] == 200
    places, points = [(r.place_id, "k", r.lat, r.lon) for r in there.collect()], [(r.point_id, "k", r.lat, r.lon) for r in at.limit(20).collect()]
    got = {(r.point_id, r.group, r.place_id) for r in SP.nearest(at, there, 3).where("point_id < 20").collect()}
    assert got == plain_nearest([p for p in points if p[0] < 20], places, 3)


def plain_terminology(queries, index, limit):
    """Every query against every row."""
    out = set()
    weights = {"long_common_name": 1.0, "shortname": 0.9, "component": 0.7}
    for nq in {q for q in queries if q}:
        words = [w for w in nq.split() if len(w) > 1 and w not in S.TERMINOLOGY_STOP]
        rows = []
        for r in index:
            held = {}
            for field, weight in weights.items():
                for w in (r[field] or "").split():
                    held[w] = max(held.get(w, 0), weight)
            found = [w for w in words if w in held]
            if not found:
                continue
            phrase = any(nq in (r[f] or "") for f in ("long_common_name", "shortname"))
            score = round(min(1.0, len(found) / len(words) * 0.65 + sum(held[w] for w in found) / len(words) * 0.20 + (0.15 if phrase else 0)), 6)
            rank = r["common_order_rank"] if {"panel", "order"} & set(nq.split()) else r["common_test_rank"]
            rows.append((-score, -round(len(found) / len(words), 6), rank if rank > 0 else 10 ** 9, r["code"]))
        out |= {(nq, code, -s, -c, i) for i, (s, c, _, code) in enumerate(sorted(rows)[:limit], 1)}
    return out


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_terminology_rounds_equal_all_pairs(spark, limit):
    rng = random.Random(limit)
    common, rare = ["blood", "serum", "panel", "test", "iron"], [f"rare{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(common if rng.random() < 0.75 else rare) for _ in range(n))
    index = [{"code": f"c{i:03d}", "long_common_name": text(4), "shortname": None if i % 9 == 0 else text(2), "component": text(2),
              "common_test_rank": rng.randint(0, 4), "common_order_rank": rng.randint(0, 3)} for i in range(250)]
    queries = [text(rng.randint(1, 4)) for _ in range(70)] + ["blood", "erum", "rare3 unknown", "the of", "", "od ser", "blood blood serum"]
    frame = spark.createDataFrame([tuple(r.values()) for r in index], "code string, long_common_name string, shortname string, component string, common_test_rank int, common_order_rank int")
    asked = spark.createDataFrame([(str(i), t) for i, t in enumerate(queries)], "query_id string, query_text string")
    got = {(r.nq, r.code, r.score, r.coverage, r.candidate_rank) for r in S.terminology_candidates(asked, frame, limit).collect()}
    assert got == plain_terminology(queries, index, limit)


def test_offline_resolver_edges(spark):
    terms = spark.createDataFrame([("1", "Biometria Hematica", "Biometria Hematica", "exact", None), ("2", "Glucosa", "Glucosa", "exact", None), ("3", "Glucosa basal", "Azucar", "provider_alias", "p1"),
                                   ("4", "Azul", "Repetido", "alias", None), ("5", "Rojo", "Repetido", "alias", None)], "item_id string, display_name string, term string, term_kind string, term_provider string")
    labels = spark.createDataFrame([("BH", None), ("azucar", "p1"), ("azucar", "p2"), ("repetido", None), ("glucosa posprandial", None), ("", None)], "label string, provider_id string")
    status = {(r.nq, r.provider_id): (r.status, r.item_id) for r in S.resolve_labels(labels, terms)[0].collect()}
    assert status[("bh", None)] == ("ambiguous", None)          # an initialism never resolves
    assert status[("azucar", "p1")] == ("resolved", "3") and status[("azucar", "p2")][0] == "no_match"
    assert status[("repetido", None)] == ("ambiguous", None) and status[("glucosa posprandial", None)][0] == "ambiguous"


def test_ledger_replay_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("s", "r", i, '{"n":%d}' % (i % 3), 1) for i in range(5)], "source_key string, run_id string, seq bigint, payload string, n_observations int")
    gated = V.record_gate(rows)
    good = gated.filter("parse_status = 'parsed'").select("run_id", "record_hash")
    runs = spark.createDataFrame([("r", "quarantined", 3)], "run_id string, status string, records_valid bigint")
    empty = good.limit(0)
    first = RU.publish_run(runs, good, runs.limit(0).select("run_id"), empty)
    assert first["records"].count() == 3 and first["runs"].collect()[0].records_published == 0
    again = RU.publish_run(runs, good, runs.select("run_id"), good)
    assert again["records"].count() == 0 and again["runs"].count() == 0
    status = spark.createDataFrame([("r", "s", "succeeded", None)], "run_id string, source_key string, status string, deviation_percentage double")
    RU.write_run(gated, gated.select("source_key", "run_id", "record_hash"), RU.run_manifest(gated, status), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/manifests").collect()[0].records_rejected == 2


def test_census_csv(spark, tmp_path):
    header = ",".join(CE.CENSUS_COLUMNS)
    (tmp_path / "c.csv").write_text(header + "\n1,x,Lab,,621511,act,21,Puebla,72000,,19.0,-98.0\n1,x, ,,622111,act,21,Puebla,72000,,nan,-98.0\n2,x,Shop,,561000,act,09,Puebla,72000,,19,-98\n", encoding="utf-8")
    out = CE.census_scan(CE.read_census_csv(spark, str(tmp_path / "c.csv"), CE.CENSUS_COLUMNS))
    flags = [r.quality_flags for r in out["records"].orderBy("nom_estab").collect()]
    assert sorted(map(tuple, flags)) == [(), ("missing_business_name", "invalid_coordinates")]
    assert {(r.external_record_id, r.error) for r in out["errors"].collect()} == {("2", "other_state"), ("1", "duplicate_id")}


def test_replayed_application_changes_nothing(spark):
    matches = spark.createDataFrame([(f"r{i}", dt.datetime(2024, 1, 1 + i), "1") for i in range(5)], "run_id string, created_at timestamp_ntz, item_id string")
    decided = spark.createDataFrame([("r1", "old")], "run_id string, request_id string")
    out, counts = Q.apply_exact(matches, decided, 3, "new")
    assert sorted(r.run_id for r in out.collect()) == ["r0", "r2"] and tuple(counts.collect()[0]) == (3, 2, 1, 2)
    out, counts = Q.apply_exact(matches, decided.unionByName(out.select("run_id", "request_id")), 3, "new")
    assert out.count() == 0


def test_census_feed_spec(spark):
    from offerloom.plans.ingest_queries import CENSUS
    rows = spark.createDataFrame([('{"Id":"7","Nombre":"ClÃ­nica Uno","CP":"72000","Latitud":"19.1","Longitud":"","www":null}', dt.datetime(2024, 1, 1)), ('{"Nombre":"x"}', dt.datetime(2024, 1, 1)), ("[", dt.datetime(2024, 1, 1))],
                                 "payload string, observed_at timestamp_ntz")
    records, rejects = M.source_records(rows, CENSUS)
    got = records.collect()[0]
    assert {o.attribute_name: o.observed_value for o in got.observations} == {"name": "Clínica Uno", "postal_code": "72000", "latitude": "19.1"}
    assert sorted(r.reject_reason for r in rejects.collect()) == ["missing_id", "not_json"]


def test_split_hot_group_keeps_every_duplicate_verdict(spark):
    rows = spark.range(3000).select(F.lit("s").alias("source_key"), F.lit("r").alias("run_id"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, '{"n":0}').otherwise(F.concat(F.lit('{"n":'), F.col("id"), F.lit("}"))).alias("payload"), F.lit(1).alias("n_observations"))
    got = V.record_gate(rows).groupBy("parse_status").count().collect()
    assert {r.parse_status: r["count"] for r in got} == {"parsed": 2001, "invalid": 999}


def test_limits_default_to_all_rows(spark):
    from offerloom.operators import identity, normqueue
    urls = [f"https://portal.example.com/{i:02d}" for i in range(60)]
    records = spark.createDataFrame([(str(i), u, "lab") for i, u in enumerate(urls)], "external_record_id string, website_url string, classification string")
    assert identity.host_seeds(records).first().seed_urls == urls and identity.host_seeds(records, 3).first().seed_urls == urls[:3]
    items = spark.createDataFrame([(str(i), "active", f"gear {i}") for i in range(60)], "item_id string, status string, name string")
    lookup = lambda *limit: normqueue.catalog_lookup(items.select("item_id", "status"), items.select("item_id", "name"), "gear", *limit).count()
    assert (lookup(), lookup(50)) == (60, 50)
    queries = spark.createDataFrame([(1, "all", "gear"), (2, "all", "gear")], "query_id int, scope string, query_text string")
    results = spark.createDataFrame([(q, r, f"{r}" if r < 25 else f"{r}-{q}", "ambiguous") for q in (1, 2) for r in range(1, 26)],
                                    "query_id int, result_rank int, item_id string, resolution_status string")
    groups = lambda *limit: normqueue.review_fingerprint(queries, results, "v6", *limit).count()
    assert (groups(), groups(20)) == (2, 1)


def test_page_prices_are_found_however_far_they_stand(spark):
    gap, long_name = "relleno " * 100, "Biometría hemática " + "muy completa " * 20
    far = f"<h1>Examen de orina</h1><p>{gap}</p><p>Precio $120.00</p>"
    script = f'<script>var a = [{{"name": "{long_name.strip()}", "note": "{gap}", "price": "350.00"}}]</script>'
    pages = spark.createDataFrame([(1, "https://one.example.com/", far), (2, "https://two.example.com/", script)], "page_id int, url string, html string")
    rows = lambda **limits: {(r.page_id, r.price_minor, r.method) for r in PG.page_evidence(pages, **limits).collect()}
    assert len(gap) >= 800 and len(long_name) > 180
    assert rows() == {(1, 12000, "price_pattern"), (2, 35000, "embedded_script_pattern")}
    assert rows(price_chars=700) == {(1, None, "heading_pattern"), (2, 35000, "embedded_script_pattern")}
    quoted = """<script>x = [{"title": "Perfil tiroideo", "id": 7, "cost": "$ 1,250.00"}, {'name': 'Glucosa', 'url': 'a', 'price': 90}, {"price": 5}, {"name": "Sin precio"}]</script>"""
    pages = spark.createDataFrame([(3, "https://three.example.com/", quoted)], pages.schema)
    assert {(r.name, r.price_minor) for r in PG.page_evidence(pages, hint="(?i)perfil|glucosa").collect()} == {("Perfil tiroideo", 125000), ("Glucosa", 9000)}


def test_lowest_cost_search_grows_few_sets_among_equals(monkeypatch):
    n, wanted = 90, 4
    grown = []
    offered = P._Search.offer
    monkeypatch.setattr(P._Search, "offer", lambda self, sets, cover: (grown.append(len(sets)), offered(self, sets, cover))[1])
    ids = sorted(f"s{b}" for b in range(n))
    item = np.array([int(name[1:]) % 3 for name in ids])  # one item a branch, the fourth item is offered by none
    rows = {"branch": np.arange(n), "label": np.zeros(n, int), "name": np.arange(n), "offer": np.arange(n), "currency": np.zeros(n, int), "distance": np.arange(n)[::-1] * 10.0,
            "item_index": item, "amount": np.full(n, 100), "quoted": np.zeros(n, bool)}
    got = [s["location_ids"] for s in P._solutions(rows, wanted, ids, P._initial(ids), ids, ["MXN"], "lowest_cost", 3, 3)]
    by_rank = ids[::-1]  # equally many items each, so nearest first
    sets = [s for s in itertools.combinations(by_rank, 3) if len({int(x[1:]) % 3 for x in s}) == 3]
    assert got == sorted("|".join(s) for s in sets)[:3]
    assert sum(grown) < 20_000  # all sets of up to three branches: 121,575
