"""Registered label-resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import norm_text
from ..operators import resolve as R
from . import duck_sql as D
from .tables import duck, view


def catalog(spark: SparkSession, sf: str) -> R.Catalog:
    return R.Catalog(**{n: view(spark, sf, n) for n in (
        "items", "names", "aliases", "descriptions", "disambiguation", "lexicon", "attributes", "identifiers")})


def queries_table(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "queries")


def _texts(spark, sf) -> DataFrame:
    return R.distinct_queries(queries_table(spark, sf)).select("nq").distinct()


def _search_terms(spark, sf):
    return R.search_terms(catalog(spark, sf), "parts").select("item_id", "term", "nt", "term_source", "term_provider", "weight")


def _search_v1(spark, sf):
    return R.search_items_v1(queries_table(spark, sf), catalog(spark, sf), "parts").select(
        "query_id", "item_id", "display_name", "similarity_score", "weighted_score", "result_rank")


def _attributes(spark, sf):
    return R.query_attributes(_texts(spark, sf), view(spark, sf, "lexicon"))


def _disambiguation(spark, sf):
    return R.query_disambiguation(_texts(spark, sf), view(spark, sf, "disambiguation")).select(
        "nq", "nt", F.round(F.col("word_similarity").cast("double"), 6).alias("word_score"))


def _candidates(spark, sf):
    return R.resolve_candidates(queries_table(spark, sf), catalog(spark, sf), "parts").select(
        "nq", F.coalesce("provider_id", F.lit("")).alias("provider_id"), "item_id", "display_name", "term_source",
        "similarity_score", "word_score", "lexical_score")


def _gate(spark, sf):
    rows = R.resolve_candidates(queries_table(spark, sf), catalog(spark, sf), "parts")
    asked = R.query_attributes(_texts(spark, sf), view(spark, sf, "lexicon"))
    return R.attribute_gate(rows, asked, view(spark, sf, "attributes")).select(
        "nq", F.coalesce("provider_id", F.lit("")).alias("provider_id"), "item_id", "attribute_count", "attribute_matches", "hard_conflict")


def _stage(stage):
    def run(spark, sf):
        return R.resolve(queries_table(spark, sf), catalog(spark, sf), "parts", stage=stage).drop("matched_term")
    return run


def _resolved(spark, sf):
    return R.resolve(queries_table(spark, sf), catalog(spark, sf), "parts")


def _status(spark, sf):
    return R.resolution_status(queries_table(spark, sf), _resolved(spark, sf))


def _guard(spark, sf):
    return R.confidence_guard(R.resolve(queries_table(spark, sf), catalog(spark, sf), "parts", stage=2))[1]


QUERIES = {
    "search_terms": _search_terms,
    "search_items_v1": _search_v1,
    "query_attributes": _attributes,
    "query_disambiguation": _disambiguation,
    "resolve_candidates": _candidates,
    "attribute_gate": _gate,
    **{f"resolve_v{n}": _stage(n) for n in range(1, 7)},
    "resolution_status": _status,
    "confidence_guard": _guard,
}

# --- oracles ------------------------------------------------------------------------------------

_VIEWS = ("names", "aliases", "descriptions", "disambiguation", "lexicon", "attributes", "identifiers", "queries")
_TERMS = f"""
search_terms AS (
  SELECT t.*, {D.norm('term')} AS nt FROM (
    SELECT item_id, name AS term, 'name' AS term_source, NULL::VARCHAR AS term_provider, CASE WHEN is_primary THEN 1.0::DOUBLE ELSE 0.98 END AS weight FROM names
    UNION ALL
    SELECT item_id, alias, 'alias', provider_id, confidence::DOUBLE FROM aliases WHERE status = 'approved') t
  WHERE item_id IN (SELECT item_id FROM items WHERE status = 'active' AND domain_code = 'parts')),
display AS (SELECT item_id, name AS primary_name FROM names WHERE is_primary),
qn AS (SELECT query_id, query_text, provider_id, {D.norm('query_text')} AS nq FROM queries),
qd AS (SELECT DISTINCT nq, provider_id FROM qn WHERE nq <> ''),
qg AS (SELECT nq, {D.tri_ordered('nq')} AS qo FROM (SELECT DISTINCT nq FROM qd)),
qgs AS (SELECT nq, qo, list_distinct(qo) AS qs FROM qg)"""

_STAGES = f""",
terms AS (
  SELECT item_id, term, nt, term_source, term_provider, weight FROM search_terms
  UNION ALL
  SELECT item_id, description, {D.norm('description')}, 'description', NULL, 0.90 FROM descriptions
  WHERE status = 'approved' AND item_id IN (SELECT item_id FROM items WHERE status = 'active' AND domain_code = 'parts')),
tg AS (SELECT nt, {D.tri('nt')} AS ts FROM (SELECT DISTINCT nt FROM terms UNION SELECT DISTINCT {D.norm('term')} FROM disambiguation)),
near AS (
  SELECT nq, nt, ts, qo, qs, len(list_intersect(ts, qs)) AS shared FROM qgs CROSS JOIN tg),
measured AS (
  SELECT nq, nt, {D.jaccard('ts', 'qs')} AS sim, {D.word_sim('ts', 'qo')} AS wsim FROM near
  WHERE shared >= 0.35 * len(ts) - 1e-6 OR contains(nq, nt) OR contains(nt, nq)),
pairs AS (SELECT * FROM measured WHERE contains(nq, nt) OR contains(nt, nq) OR sim >= 0.35::DOUBLE OR wsim >= 0.45::DOUBLE),
dis AS (
  SELECT DISTINCT m.nq, m.nt, m.sim, m.wsim FROM measured m
  WHERE m.nt IN (SELECT {D.norm('term')} FROM disambiguation) AND (m.nq = m.nt OR m.wsim >= 0.70::DOUBLE)),
scored AS (
  SELECT q.nq, q.provider_id, t.item_id, t.term, t.nt, t.term_source, t.weight, p.sim, p.wsim
  FROM qd q JOIN pairs p ON p.nq = q.nq JOIN terms t ON t.nt = p.nt AND (t.term_provider IS NULL OR t.term_provider = q.provider_id)
  UNION ALL
  SELECT q.nq, q.provider_id, d.item_id, d.term, x.nt, 'disambiguation', 0.90, x.sim, x.wsim
  FROM qd q JOIN dis x ON x.nq = q.nq JOIN disambiguation d ON {D.norm('d.term')} = x.nt
  WHERE d.item_id IN (SELECT item_id FROM items WHERE status = 'active')),
best AS (
  SELECT *, round(CASE WHEN nt = nq THEN 1.0 WHEN term_source = 'disambiguation' THEN 0.92 WHEN contains(nq, nt) THEN 0.88
                 ELSE greatest(round(sim::DOUBLE, 6) * weight, round(wsim::DOUBLE, 6) * weight) END, 6) AS lexical_score
  FROM scored
  QUALIFY row_number() OVER (PARTITION BY nq, provider_id, item_id ORDER BY nt <> nq, weight DESC, wsim DESC, sim DESC, term_source, nt) = 1),
candidates AS (SELECT b.*, coalesce(d.primary_name, b.term) AS display_name FROM best b LEFT JOIN display d USING (item_id)),
qa AS (SELECT DISTINCT g.nq, l.attribute_type, l.attribute_value FROM qgs g JOIN lexicon l ON contains(g.nq, {D.norm('l.phrase')}) WHERE l.status = 'approved'),
gate AS (
  SELECT c.nq, c.provider_id, c.item_id, count(a.nq) AS attribute_count,
         count(*) FILTER (WHERE h.item_id IS NOT NULL AND a.attribute_type <> 'panel') AS attribute_matches,
         coalesce(bool_or(h.item_id IS NULL AND a.attribute_type IN ('modality', 'component')), FALSE) AS hard_conflict
  FROM candidates c LEFT JOIN qa a ON a.nq = c.nq
  LEFT JOIN (SELECT DISTINCT * FROM attributes) h ON h.item_id = c.item_id AND h.attribute_type = a.attribute_type AND h.attribute_value = a.attribute_value
  GROUP BY c.nq, c.provider_id, c.item_id),
gated AS (
  SELECT c.*, coalesce(g.attribute_count, 0) AS an, coalesce(g.attribute_matches, 0) AS am
  FROM candidates c LEFT JOIN gate g ON g.nq = c.nq AND g.item_id = c.item_id AND g.provider_id IS NOT DISTINCT FROM c.provider_id
  WHERE NOT coalesce(g.hard_conflict, FALSE) AND (c.lexical_score >= 0.45 OR c.term_source <> 'description')),
v1 AS (
  SELECT *, CASE WHEN nq IN (SELECT nq FROM dis) OR coalesce(round(confidence - nxt, 6) < 0.15, FALSE) THEN 'ambiguous' ELSE 'resolved' END AS status,
         CASE WHEN term_source = 'disambiguation' THEN 'disambiguation' WHEN lexical_score >= 0.999 THEN 'exact' WHEN term_source = 'alias' THEN 'alias'
              WHEN round(wsim::DOUBLE, 6) >= round(sim::DOUBLE, 6) THEN 'word_fuzzy' ELSE 'trigram' END AS method
  FROM (SELECT *, lead(confidence) OVER (PARTITION BY nq, provider_id ORDER BY confidence DESC, display_name, item_id) AS nxt
        FROM (SELECT *, round(least(1.0, lexical_score + CASE WHEN an = 0 THEN 0 ELSE am::DOUBLE / an * 0.12 END), 6) AS confidence
              FROM gated WHERE an = 0 OR am::DOUBLE / an >= 0.80))),
counted AS (
  SELECT *, list_filter({D.toks('nq')}, lambda w: length(w) >= 4 AND NOT list_contains({D.string_list(R.GUARD_STOP)}, w)) AS asked, {D.toks('nt')} AS tt FROM v1),
asked_words AS (SELECT DISTINCT nq, nt, tt, unnest(asked) AS w FROM counted),
word_pairs AS (SELECT DISTINCT nq, nt, w, unnest(tt) AS t FROM asked_words),
word_grams AS (SELECT *, {D.tri('t')} AS tset, {D.tri_ordered('w')} AS word_o FROM word_pairs),
supported AS (
  SELECT nq, nt, count(DISTINCT w) AS n_distinct FROM word_grams
  WHERE starts_with(t, w) OR starts_with(w, t) OR {D.word_sim('tset', 'word_o')} >= 0.80::DOUBLE GROUP BY nq, nt),
support AS (
  SELECT c.*, len(asked) AS mc, (SELECT count(*) FROM (SELECT unnest(c.asked) AS w) u WHERE EXISTS (
     SELECT 1 FROM word_grams g WHERE g.nq = c.nq AND g.nt = c.nt AND g.w = u.w
       AND (starts_with(g.t, g.w) OR starts_with(g.w, g.t) OR {D.word_sim('g.tset', 'g.word_o')} >= 0.80::DOUBLE))) AS mm
  FROM counted c),
v2 AS (
  SELECT * REPLACE (CASE WHEN count(*) OVER (PARTITION BY nq, provider_id) > 1 THEN 'ambiguous' ELSE status END AS status)
  FROM support WHERE method IN ('exact', 'alias', 'disambiguation') OR mm >= greatest(1, ceil(mc / 2.0))),
v3a AS (
  SELECT *, NOT EXISTS (SELECT 1 FROM (SELECT unnest({D.toks('nq')}) AS w) u WHERE NOT list_contains({D.string_list(R.REQUIREMENT_STOP)}, u.w) AND NOT list_contains(tt, u.w)) AS literal,
         (term_source IN ('name', 'alias') AND method IN ('exact', 'alias') AND confidence = 1 AND nt = nq) AS identity,
         (regexp_full_match(nq, '[a-z]{{4,40}}') AND NOT list_contains(tt, nq) AND len(list_filter(tt, lambda t: starts_with(t, nq))) > 0) AS discovery
  FROM v2 WHERE method IN ('exact', 'alias', 'disambiguation') OR (mc > 0 AND mm = mc)),
v3b AS (SELECT *, NOT identity AND bool_or(NOT literal) OVER (PARTITION BY nq, provider_id) AS pruned FROM v3a),
v3 AS (
  SELECT * REPLACE (CASE WHEN discovery OR pruned OR count(*) OVER (PARTITION BY nq, provider_id) > 1 THEN 'ambiguous' ELSE status END AS status)
  FROM v3b WHERE literal OR discovery),
v4 AS (
  SELECT * REPLACE (CASE WHEN NOT identity OR pruned OR discovery OR count(*) OVER (PARTITION BY nq, provider_id) > 1 OR term_source = 'disambiguation'
                         THEN 'ambiguous' ELSE 'resolved' END AS status) FROM v3),
v5 AS (SELECT * FROM v4 WHERE method NOT IN ('exact', 'alias') OR nt = nq OR term_source = 'disambiguation'),
v6x AS (SELECT *, count(*) FILTER (WHERE method = 'exact') OVER (PARTITION BY nq, provider_id) AS ec FROM v5),
v6 AS (
  SELECT * REPLACE (CASE WHEN pruned THEN 'ambiguous' WHEN ec > 1 THEN 'ambiguous' WHEN ec = 1 THEN 'resolved' ELSE status END AS status)
  FROM v6x WHERE ec = 0 OR method = 'exact')"""


def _final(stage: int, extra: str = "") -> str:
    return f""",
ranked AS (
  SELECT nq, provider_id, item_id, display_name, term_source, confidence, status AS resolution_status, method AS match_method,
         row_number() OVER (PARTITION BY nq, provider_id ORDER BY confidence DESC, display_name, item_id) AS result_rank FROM v{stage}),
fallback AS (
  SELECT q.query_id, r.item_id, r.display_name, r.term_source, r.confidence, r.resolution_status, r.match_method, r.result_rank
  FROM qn q JOIN ranked r ON r.nq = q.nq AND r.provider_id IS NOT DISTINCT FROM q.provider_id WHERE r.result_rank <= 10){extra}"""


_CODES = """,
codes AS (
  SELECT q.query_id, i.item_id, d.primary_name AS display_name, 'loinc' AS term_source, 1.0::DOUBLE AS confidence,
         CASE WHEN count(*) OVER (PARTITION BY q.query_id) > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution_status, 'loinc_exact' AS match_method,
         row_number() OVER (PARTITION BY q.query_id ORDER BY i.version DESC, i.item_id) AS result_rank
  FROM qn q JOIN identifiers i ON lower(trim(i.code)) = lower(trim(q.query_text)) JOIN display d ON d.item_id = i.item_id
  WHERE i.item_id IN (SELECT item_id FROM items WHERE status = 'active' AND domain_code = 'parts')),
results AS (SELECT * FROM codes UNION ALL SELECT * FROM fallback WHERE query_id NOT IN (SELECT query_id FROM codes))"""

PREFIX = duck(*_VIEWS) + "," + _TERMS
FULL = PREFIX + _STAGES
# a WITH chain ending in ``results``: the stage-6 rows per query
RESULTS = FULL + _final(6, _CODES)

ORACLES = {
    "search_terms": PREFIX + " SELECT item_id, term, nt, term_source, term_provider, weight FROM search_terms",
    "search_items_v1": PREFIX + f""",
      tg AS (SELECT nt, {D.tri('nt')} AS ts FROM (SELECT DISTINCT nt FROM search_terms)),
      pairs AS (SELECT nq, nt, {D.jaccard('ts', 'qs')} AS sim FROM qgs CROSS JOIN tg),
      best AS (
        SELECT q.nq, q.provider_id, t.item_id, t.term, p.sim, round(round(p.sim::DOUBLE, 6) * t.weight, 6) AS w
        FROM qd q JOIN pairs p ON p.nq = q.nq JOIN search_terms t ON t.nt = p.nt AND (t.term_provider IS NULL OR t.term_provider = q.provider_id)
        WHERE p.nt = p.nq OR p.sim >= 0.25::DOUBLE OR contains(p.nt, p.nq)
        QUALIFY row_number() OVER (PARTITION BY q.nq, q.provider_id, t.item_id ORDER BY t.term_provider IS NULL, w DESC, t.term_source, t.term) = 1),
      top AS (
        SELECT b.*, d.primary_name AS display_name, row_number() OVER (PARTITION BY nq, provider_id ORDER BY w DESC, d.primary_name, b.item_id) AS result_rank
        FROM best b JOIN display d USING (item_id))
      SELECT q.query_id, t.item_id, t.display_name, round(t.sim::DOUBLE, 6) AS similarity_score, t.w AS weighted_score, t.result_rank
      FROM qn q JOIN top t ON t.nq = q.nq AND t.provider_id IS NOT DISTINCT FROM q.provider_id WHERE t.result_rank <= 10""",
    "query_attributes": FULL + " SELECT nq, attribute_type, attribute_value FROM qa",
    "query_disambiguation": FULL + " SELECT nq, nt, round(wsim::DOUBLE, 6) AS word_score FROM dis",
    "resolve_candidates": FULL + """ SELECT nq, coalesce(provider_id, '') AS provider_id, item_id, display_name, term_source,
        round(sim::DOUBLE, 6) AS similarity_score, round(wsim::DOUBLE, 6) AS word_score, lexical_score FROM candidates""",
    "attribute_gate": FULL + " SELECT nq, coalesce(provider_id, '') AS provider_id, item_id, attribute_count, attribute_matches, hard_conflict FROM gate",
    **{f"resolve_v{n}": FULL + _final(n) + " SELECT * FROM fallback" for n in range(1, 6)},
    "resolve_v6": RESULTS + " SELECT * FROM results",
    "resolution_status": RESULTS + """
      SELECT q.query_id, CASE WHEN count(r.item_id) = 0 THEN 'no_match' WHEN count(r.item_id) > 1 OR bool_or(r.resolution_status = 'ambiguous') THEN 'ambiguous' ELSE 'resolved' END AS status,
             count(r.item_id) AS candidates,
             CASE WHEN count(r.item_id) = 1 AND bool_and(r.resolution_status = 'resolved') THEN min(r.item_id) END AS item_id
      FROM queries q LEFT JOIN results r ON r.query_id = q.query_id GROUP BY q.query_id""",
    "confidence_guard": FULL + _final(2) + """, w AS (SELECT *, match_method IN ('word_fuzzy', 'trigram') AND confidence < 0.75 AS weak FROM fallback)
      SELECT query_id, CASE WHEN count(*) FILTER (WHERE NOT weak) = 0 THEN 'no_match'
                            WHEN bool_or(NOT weak AND resolution_status = 'ambiguous') OR count(*) FILTER (WHERE NOT weak) > 1 OR count(*) FILTER (WHERE weak) > 0 THEN 'ambiguous' ELSE 'resolved' END AS status,
             count(*) FILTER (WHERE NOT weak) AS safe_count, count(*) FILTER (WHERE weak) AS weak_count
      FROM w GROUP BY query_id""",
}
