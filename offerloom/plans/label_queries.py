"""Registered suggestion, offline resolution, triage and free-text order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..operators import orders as OR, resolve as R, suggest as S
from . import duck_sql as D
from .resolve_queries import PREFIX, catalog, queries_table
from .tables import VIEWS, duck, view

VIEWS["texts"] = """
    SELECT a.p_partkey AS text_id, concat(a.p_name, ' ', b.p_name, CASE WHEN a.p_size % 2 = 0 THEN concat(' ', c.p_name) ELSE '' END, CASE WHEN a.p_size % 9 = 0 THEN ' extra' ELSE '' END) AS text
    FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 JOIN {part} c ON c.p_partkey = a.p_partkey + 2"""
VIEWS["segment_terms"] = """
    SELECT name AS term, item_id, FALSE AS is_ambiguous FROM {names}
    UNION ALL SELECT alias AS term, item_id, FALSE AS is_ambiguous FROM {aliases} WHERE provider_id IS NULL AND status = 'approved'
    UNION ALL SELECT 'old' AS term, CAST(NULL AS STRING) AS item_id, TRUE AS is_ambiguous FROM {items}"""
VIEWS["terminology"] = """
    SELECT CAST(p_partkey AS STRING) AS code, concat(p_name, ' ', lower(p_type)) AS long_common_name, p_brand AS shortname, p_type AS component, CAST(p_size AS STRING) AS system,
           CAST(p_size AS INT) AS common_test_rank, 0 AS common_order_rank FROM {part}"""
VIEWS["label_groups"] = """
    SELECT query_text AS label, provider_id, count(*) AS occurrences, CASE WHEN max(length(query_id)) % 2 = 0 THEN 'provider_official' ELSE 'directory' END AS source_type,
           CASE WHEN min(query_id) < 'p3' THEN 'approved' ELSE 'review' END AS policy, 'https://labels.example.com/x?y=1' AS source_url FROM {queries} GROUP BY query_text, provider_id"""


def _names(spark, sf):
    active = view(spark, sf, "items").filter("status = 'active'").select("item_id")
    return view(spark, sf, "names").join(active, "item_id", "left_semi")


def offline_terms(spark, sf):
    names = _names(spark, sf)
    display = names.filter("is_primary").select("item_id", F.col("name").alias("display_name"))
    aliases = view(spark, sf, "aliases").filter("status = 'approved'").select(
        "item_id", F.col("alias").alias("term"), F.when(F.col("provider_id").isNull(), "alias").otherwise("provider_alias").alias("term_kind"), F.col("provider_id").alias("term_provider"))
    own = names.select("item_id", F.col("name").alias("term"), F.when(F.col("is_primary"), "exact").otherwise("alias").alias("term_kind"), F.lit(None).cast("string").alias("term_provider"))
    return own.unionByName(aliases).join(display, "item_id")


def _spelling(spark, sf):
    return S.spelling_suggestions(queries_table(spark, sf), _names(spark, sf))


def _suggestions(spark, sf):
    names = _names(spark, sf)
    own = names.filter("is_primary").select(F.col("item_id").alias("query_id"), F.col("name").alias("query_text"), F.lit(None).cast("string").alias("provider_id"))
    verified = R.resolve(own, catalog(spark, sf), "parts").filter("resolution_status = 'resolved' AND match_method = 'exact' AND query_id = item_id").select("item_id")
    return S.catalog_suggestions(queries_table(spark, sf), names.select("item_id", "name"), verified)


def _labels(part):
    def run(spark, sf):
        labels = queries_table(spark, sf).select(F.col("query_text").alias("label"), "provider_id")
        status, ranked = S.resolve_labels(labels, offline_terms(spark, sf))
        if part == "status":
            return status.withColumn("provider_id", F.coalesce("provider_id", F.lit("")))
        return ranked.select("nq", F.coalesce("provider_id", F.lit("")).alias("provider_id"), "item_id", "score", "method", "candidate_rank")
    return run


def _triage(spark, sf):
    return S.triage_groups(view(spark, sf, "label_groups"), offline_terms(spark, sf)).withColumn("holds", F.array_join("holds", ","))


def _terminology(spark, sf):
    return S.terminology_candidates(queries_table(spark, sf), view(spark, sf, "terminology"), 10)


def _split(spark, sf):
    rows = view(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), "text")
    return OR.split_orders(rows)


def _segment(spark, sf):
    return OR.segment_text(view(spark, sf, "texts"), view(spark, sf, "segment_terms")).select("text_id", "status", F.col("partitions").cast("bigint").alias("partitions"), F.array_join("segments", "|").alias("segments"))


def _edges(spark, sf):
    return OR.segment_edges(view(spark, sf, "texts"), view(spark, sf, "segment_terms")).select("text_id", F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"), "nt")


def _ocr(spark, sf):
    rules = view(spark, sf, "names").filter("NOT is_primary").select(
        F.col("item_id").alias("rule_id"), F.replace("name", F.lit(" "), F.lit("-")).alias("rule_input"), F.initcap("name").alias("suggested_text"), F.lit("approved").alias("status"))
    inputs = view(spark, sf, "part").select("p_partkey", F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" / "), F.split_part("p_name", F.lit(" "), F.when(F.col("p_size") % 2 == 0, 1).otherwise(2))).alias("input"))
    return OR.ocr_corrections(inputs, rules)


def _lines(spark, sf):
    rows = view(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).select(
        "doc_id", "line_no", "text", (F.lit(1.0) - F.col("line_no") % 5 / 20).alias("confidence"), (F.col("line_no") % 2 * 100.0).alias("x"),
        (F.floor(F.col("line_no") / 2) * 10.0).alias("top"), (F.floor(F.col("line_no") / 2) * 10.0 + 8).alias("bottom"))
    return OR.order_lines(rows)


QUERIES = {
    "spelling_suggestions": _spelling,
    "catalog_suggestions": _suggestions,
    "resolve_labels": _labels("status"),
    "label_candidates": _labels("ranked"),
    "triage_groups": _triage,
    "terminology_candidates": _terminology,
    "split_orders": _split,
    "segment_text": _segment,
    "segment_edges": _edges,
    "ocr_corrections": _ocr,
    "order_lines": _lines,
}

_ALIVE = "(SELECT item_id FROM items WHERE status = 'active')"
_STOP = D.string_list(STOPWORDS)
_LONG = f"list_distinct(list_filter({{x}}, lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w)))"
_OFFLINE = duck("queries", "names", "aliases", "items") + f""",
  t AS (
    SELECT n.item_id, {D.norm('n.name')} AS nt, n.name AS term, CASE WHEN n.is_primary THEN 'exact' ELSE 'alias' END AS kind, NULL::VARCHAR AS tp FROM names n WHERE n.item_id IN {_ALIVE}
    UNION ALL SELECT a.item_id, {D.norm('a.alias')}, a.alias, CASE WHEN a.provider_id IS NULL THEN 'alias' ELSE 'provider_alias' END, a.provider_id FROM aliases a WHERE a.status = 'approved' AND a.item_id IN {_ALIVE}),
  q AS (SELECT DISTINCT {D.norm('query_text')} AS nq, provider_id FROM queries),
  tx AS (SELECT nt, {D.char3('nt')} AS ts, {_LONG.format(x=D.toks('nt'))} AS tw, list_filter({D.toks('nt')}, lambda w: length(w) >= 3 AND regexp_full_match(w, '[a-z]+') AND NOT list_contains({_STOP}, w)) AS ti FROM (SELECT DISTINCT nt FROM t)),
  qx AS (SELECT nq, {D.char3('nq')} AS qs, {_LONG.format(x=D.toks('nq'))} AS qw FROM (SELECT DISTINCT nq FROM q)),
  px AS (
    SELECT nq, nt, CASE WHEN nq = nt THEN 1.0::DOUBLE ELSE round(len(list_intersect(qs, ts))::DOUBLE / (len(qs) + len(ts) - len(list_intersect(qs, ts))), 6) END AS score,
           CASE WHEN nq = nt THEN 'same' ELSE 'trigram' END AS how, qw, tw FROM qx CROSS JOIN tx WHERE nq = nt OR len(list_intersect(qs, ts)) > 0
    UNION ALL SELECT nq, nt, 0.95, 'rules', NULL, NULL FROM qx JOIN tx ON len(ti) BETWEEN 2 AND 8 AND array_to_string(list_transform(ti, lambda w: left(w, 1)), '') = nq AND regexp_full_match(nq, '[a-z]{{2,8}}')),
  p AS (SELECT nq, nt, score, how FROM px WHERE how <> 'trigram' OR (score >= 0.25 AND (len(qw) = 0 OR len(tw) = 0 OR len(list_filter(qw, lambda x: len(list_filter(tw, lambda y: starts_with(x, y) OR starts_with(y, x))) > 0)) > 0))),
  r AS (SELECT q.nq, q.provider_id, t.item_id, t.term, p.score, CASE WHEN p.how = 'same' THEN t.kind ELSE p.how END AS method FROM q JOIN p ON p.nq = q.nq JOIN t ON t.nt = p.nt AND (t.tp IS NULL OR t.tp = q.provider_id)),
  b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY nq, provider_id, item_id ORDER BY score DESC, CASE method WHEN 'exact' THEN 4 WHEN 'provider_alias' THEN 3 WHEN 'trigram' THEN 1 ELSE 2 END DESC, term) = 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY nq, provider_id ORDER BY score DESC, item_id) AS rk FROM b)"""
_WINDOWS = duck("texts", "segment_terms") + f""",
  st AS (SELECT {D.norm('term')} AS nt, bool_or(is_ambiguous) AS amb FROM segment_terms GROUP BY 1 HAVING count(DISTINCT item_id) = 1 OR bool_or(is_ambiguous)),
  tk AS (SELECT text_id, {D.toks(D.norm('text'))} AS w FROM texts),
  sp AS (SELECT text_id, w, unnest(range(0, len(w))) AS s FROM tk),
  wn AS (SELECT text_id, s, l, array_to_string(list_slice(w, s + 1, s + l), ' ') AS nt FROM (SELECT *, unnest(range(1, len(w) - s + 1)) AS l FROM sp)),
  ed AS (SELECT text_id, s, l, wn.nt, amb FROM wn JOIN st USING (nt))"""

ORACLES = {
    "spelling_suggestions": duck("queries", "names", "items") + f""",
      n AS (SELECT item_id, name, is_primary, {D.norm('name')} AS nt FROM names WHERE item_id IN {_ALIVE}),
      tg AS (SELECT nt, {D.tri('nt')} AS ts, array_to_string(list_transform(list_filter({D.toks('nt')}, lambda w: length(w) >= 3 AND regexp_full_match(w, '[a-z]+') AND NOT list_contains({_STOP}, w)), lambda w: left(w, 1)), '') AS ini FROM (SELECT DISTINCT nt FROM n)),
      q AS (SELECT query_id, {D.norm('query_text')} AS nq FROM queries), qg AS (SELECT nq, {D.tri('nq')} AS qs FROM (SELECT DISTINCT nq FROM q)),
      sc AS (SELECT nq, nt, CASE WHEN length(nq) BETWEEN 2 AND 8 AND regexp_full_match(nq, '[a-z]+') AND ini = nq THEN 0.95::DOUBLE WHEN length(nq) >= 4 AND {D.jaccard('ts', 'qs')} >= 0.55::DOUBLE THEN {D.jaccard('ts', 'qs')}::DOUBLE END AS score FROM qg CROSS JOIN tg),
      it AS (SELECT nq, item_id, max(score) AS score FROM sc JOIN n USING (nt) WHERE score IS NOT NULL GROUP BY nq, item_id),
      rk AS (SELECT it.*, d.name AS display_name, row_number() OVER (PARTITION BY nq ORDER BY score DESC, it.item_id) AS suggestion_rank FROM it JOIN n d ON d.item_id = it.item_id AND d.is_primary)
      SELECT q.query_id, item_id, display_name, round(score, 6) AS score, suggestion_rank FROM q JOIN rk USING (nq) WHERE suggestion_rank <= 5""",
    "resolve_labels": _OFFLINE + """,
      f AS (SELECT nq, provider_id, count(*) FILTER (WHERE score = 1 AND method IN ('exact', 'alias', 'provider_alias')) AS e, min_by(item_id, rk) AS item_id, min_by(method, rk) AS m FROM k GROUP BY ALL),
      s AS (SELECT q.nq, coalesce(q.provider_id, '') AS provider_id, CASE WHEN f.nq IS NULL THEN 'no_match' WHEN e > 1 THEN 'ambiguous' WHEN e = 1 AND m IN ('exact', 'alias', 'provider_alias') THEN 'resolved' ELSE 'ambiguous' END AS status, f.item_id AS i
            FROM q LEFT JOIN f ON f.nq = q.nq AND f.provider_id IS NOT DISTINCT FROM q.provider_id)
      SELECT nq, provider_id, status, CASE WHEN status = 'resolved' THEN i END AS item_id FROM s""",
    "label_candidates": _OFFLINE + " SELECT nq, coalesce(provider_id, '') AS provider_id, item_id, score, method, rk AS candidate_rank FROM k WHERE rk <= 5",
    "terminology_candidates": duck("queries", "terminology") + f""",
      q AS (SELECT nq, list_filter({D.toks('nq')}, lambda w: length(w) > 1 AND NOT list_contains({D.string_list(S.TERMINOLOGY_STOP)}, w)) AS ws FROM (SELECT DISTINCT {D.norm('query_text')} AS nq FROM queries)),
      h AS (SELECT code, w, max(g) AS g FROM (SELECT code, unnest({D.toks(D.norm('long_common_name'))}) AS w, 1.0 AS g FROM terminology UNION ALL SELECT code, unnest({D.toks(D.norm('shortname'))}), 0.9 FROM terminology
            UNION ALL SELECT code, unnest({D.toks(D.norm('component'))}), 0.7 FROM terminology UNION ALL SELECT code, unnest({D.toks(D.norm('system'))}), 0.45 FROM terminology) GROUP BY code, w),
      a AS (SELECT nq, len(ws) AS n, unnest(ws) AS w FROM q WHERE len(ws) > 0),
      m AS (SELECT nq, n, code, count(*) AS k, sum(g)::DOUBLE AS g FROM a JOIN h USING (w) GROUP BY nq, n, code),
      s AS (SELECT m.nq, m.code, round(least(1.0, k::DOUBLE / n * 0.65 + g / n * 0.20 + CASE WHEN contains({D.norm('t.long_common_name')}, nq) OR contains({D.norm('t.shortname')}, nq) THEN 0.15 ELSE 0 END), 6) AS score, round(k::DOUBLE / n, 6) AS coverage,
                   CASE WHEN list_contains(string_split(nq, ' '), 'panel') OR list_contains(string_split(nq, ' '), 'order') OR common_test_rank <= 0 THEN 1000000000 ELSE common_test_rank END AS pop FROM m JOIN terminology t USING (code))
      SELECT nq, code, score, coverage, candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY nq ORDER BY score DESC, coverage DESC, pop, code) AS candidate_rank FROM s) WHERE candidate_rank <= 10""",
    "segment_edges": _WINDOWS + " SELECT text_id, s AS start, l AS length, nt FROM ed",
    "segment_text": _WINDOWS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
      paths AS (SELECT text_id, 0::BIGINT AS pos, ''::VARCHAR AS segs FROM tk UNION ALL SELECT p.text_id, p.pos + e.l, CASE WHEN p.segs = '' THEN e.nt ELSE p.segs || '|' || e.nt END FROM paths p JOIN ed e ON e.text_id = p.text_id AND e.s = p.pos),
      full_paths AS (SELECT p.text_id, p.segs FROM paths p JOIN tk ON tk.text_id = p.text_id AND p.pos = len(tk.w)),
      c AS (SELECT text_id, count(*) AS partitions, min(segs) AS segs FROM full_paths GROUP BY text_id),
      whole AS (SELECT e.text_id, e.nt, e.amb FROM ed e JOIN tk ON tk.text_id = e.text_id AND e.s = 0 AND e.l = len(tk.w))
      SELECT tk.text_id, CASE WHEN w.text_id IS NOT NULL THEN CASE WHEN w.amb THEN 'whole_match_ambiguous' ELSE 'whole_match' END WHEN c.text_id IS NULL THEN 'no_match' WHEN c.partitions > 1 THEN 'ambiguous' ELSE 'segmented' END AS status,
             coalesce(c.partitions, 0) AS partitions, CASE WHEN w.text_id IS NOT NULL THEN w.nt WHEN c.partitions = 1 THEN c.segs ELSE '' END AS segments
      FROM tk LEFT JOIN c USING (text_id) LEFT JOIN whole w USING (text_id)""",
    "ocr_corrections": duck("names") + """, i AS (SELECT p_partkey, split_part(p_name, ' ', 2) || ' / ' || split_part(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END) AS input FROM part),
      r AS (SELECT item_id AS rule_id, name, upper(left(split_part(name, ' ', 1), 1)) || substr(split_part(name, ' ', 1), 2) || ' ' || upper(left(split_part(name, ' ', 2), 1)) || substr(split_part(name, ' ', 2), 2) AS suggested_text FROM names WHERE NOT is_primary)
      SELECT i.p_partkey, i.input, r.suggested_text, r.rule_id, coalesce(r.suggested_text, i.input) AS resolver_input FROM i LEFT JOIN r ON r.name = replace(i.input, ' / ', ' ')""",
    "split_orders": """WITH l AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS request_id, trim(x) AS t, row_number() OVER () AS o FROM (SELECT conv_id, turn, unnest(string_split(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), ';', chr(10)), chr(10))) AS x FROM conversations)),
      c AS (SELECT request_id, o, trim(regexp_replace(regexp_replace(t, '^\\s*(?:[-*•]\\s*)?(?:\\d+\\s*[:.)-]\\s*)?', ''), '[;,]\\s*$', '')) AS input FROM l WHERE t <> '')
      SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY o) AS item_index, input, NULL::VARCHAR AS preparation_note FROM c WHERE input <> ''""",
}
