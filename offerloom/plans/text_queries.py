"""Registered scalar functions, run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hygiene as H, labels as L, numbers as N, scoring as S, text as T
from ..session import spread
from . import duck_sql as D
from .tables import VIEWS, duck, view

# pairs of labels: what was asked and the part name behind it
VIEWS["label_pairs"] = """
    SELECT q.query_id, q.query_text AS l, p.p_name AS r FROM {queries} q JOIN {part} p ON q.query_id = concat('p', CAST(p.p_partkey AS STRING))"""
# labels that hold clinical words, one per part and line number
VIEWS["clinical_labels"] = """
    SELECT p_partkey AS id, concat(
        CASE p_partkey % 6 WHEN 0 THEN 'Ultrasonido ' WHEN 1 THEN 'TAC simple ' WHEN 2 THEN 'Resonancia con contraste ' WHEN 3 THEN 'Rayos X ' WHEN 4 THEN 'Factor VIII ' ELSE 'Biometria hematica completa ' END,
        CASE p_size % 7 WHEN 0 THEN 'abdomen de pie ' WHEN 1 THEN 'rodilla derecha ' WHEN 2 THEN 'mano izquierda ' WHEN 3 THEN 'pie bilateral ' WHEN 4 THEN 'trimestre II y III ' WHEN 5 THEN 'suero IgG ' ELSE '' END, p_name) AS q,
        concat(CASE p_size % 5 WHEN 0 THEN 'Tomografia ' WHEN 1 THEN 'Ultrasonido ' WHEN 2 THEN 'Resonancia simple ' WHEN 3 THEN 'Factor IX ' ELSE '' END,
        CASE p_partkey % 4 WHEN 0 THEN 'de abdomen' WHEN 1 THEN 'rodilla izquierda' WHEN 2 THEN 'orina trimestre 2' ELSE p_name END) AS t
    FROM {part}"""


def _pairs(spark, sf):
    # small rows with expensive work: a file of a few megabytes would be one task
    rows = spread(view(spark, sf, "label_pairs"), "query_id")
    return T.evaluated(rows.select("query_id", F.col("l").alias("left"), F.col("r").alias("right")), l=T.norm_text("left"), r=T.norm_text("right"))


def _pair_query(**columns):
    def run(spark, sf):
        return _pairs(spark, sf).select("query_id", *[f().alias(n) for n, f in columns.items()])
    return run


def _double(col):
    return F.round(col.cast("double"), 6)


def _word_similarity(spark, sf):
    return T.word_similarities(_pairs(spark, sf), "r", "l", "similarity").select("query_id", _double(F.col("similarity")).alias("similarity"))


def _norm(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(T.norm_text("text")).alias("normalized_md5"))


def _repair(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.expr("encode(text, 'UTF-8')").alias("raw"))
    broken = docs.withColumn("broken", F.decode("raw", "ISO-8859-1"))
    return broken.select("doc_id", (T.repair_text("broken") == F.col("text")).alias("restored"), (T.repair_text("text") == F.col("text")).alias("kept"))


def _initialism(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(F.coalesce(T.initialism(T.norm_text("text")), F.lit(""))).alias("initials_md5"))


def _article(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(T.article_fold(T.norm_text("text"))).alias("folded_md5"))


def _price(spark, sf):
    text = F.concat(F.lit("MXN "), F.format_number("l_extendedprice", 2))
    plain = F.concat(F.lit("$ "), F.expr("cast(cast(l_extendedprice as decimal(14,1)) as string)"), F.lit(" y $"), F.format_number("l_tax", 2))
    d = N.dollar_prices(plain)
    return view(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", N.price_minor(text).alias("minor"), d["regular"].alias("regular"), d["online"].alias("online"),
        N.decimal_minor(F.col("l_extendedprice").cast("string")).alias("decimal_minor"))


def _coords(spark, sf):
    t = F.concat(F.expr("cast(c_acctbal / 50 as decimal(12,4))").cast("string"), F.lit(", "), F.expr("cast(c_custkey % 360 - 180 as string)"))
    p = N.parse_coords(t)
    return view(spark, sf, "customer").select("c_custkey", p["lat"].alias("lat"), p["lon"].alias("lon"))


def _haversine(spark, sf):
    loc = view(spark, sf, "locations")
    return loc.select("location_id", F.round(N.haversine_m("lat", "lon", F.lit(19.04), F.lit(-98.2)), 3).alias("meters"))


def _address(spark, sf):
    return view(spark, sf, "locations").select("location_id", T.display_address("line1", "line2", "locality", "postal_code").alias("address"))


def _slug(spark, sf):
    return view(spark, sf, "pages").select("page_id", T.slugify("url").alias("slug"), T.host_source_key(F.try_parse_url("url", F.lit("HOST"))).alias("source_key"))


def _stable(spark, sf):
    return view(spark, sf, "pages").select("page_id", T.stable_id(F.lit("page"), "url", "html").alias("stable_id"))


def _safe_url(spark, sf):
    return view(spark, sf, "pages").select(
        "page_id", H.safe_url("url").alias("clean"), H.safe_url("url", https_only=True).alias("https_clean"),
        H.safe_url(F.concat(F.lit("https://u:p@"), F.substring("url", 8, 2**31 - 1))).alias("with_login"))


def _site_host(spark, sf):
    return view(spark, sf, "pages").select(
        "page_id", H.site_host("url").alias("host"), H.site_host(F.concat(F.lit("<www."), F.regexp_replace("url", "^https?://(www\\.)?", ""), F.lit(">"))).alias("bare_host"))


def _redact(spark, sf):
    return view(spark, sf, "pages").select("page_id", F.md5(H.redact_text("html")).alias("redacted_md5"), H.redact_text(F.concat(F.col("url"), F.lit(" Bearer abc ?token=x y"))).alias("redacted_url"))


def _content_hash(spark, sf):
    return view(spark, sf, "events").select("event_id", H.content_hash("props").alias("record_hash"))


def _redact_json(spark, sf):
    wrapped = view(spark, sf, "events").select(
        "event_id", F.concat(F.lit('{"apiKey":"s","list":[{"token":1,"p":'), F.col("props"), F.lit("}]}")).alias("payload"))
    return H.redact_json(wrapped, "payload")


def _digest(spark, sf):
    return H.table_digest(view(spark, sf, "lineitem")).select("row_count")


def _label_attributes(spark, sf):
    return L.label_attributes(view(spark, sf, "clinical_labels"), "q")


def _evidence(spark, sf):
    rows = view(spark, sf, "clinical_labels").select("id", T.norm_text("q").alias("query_label"), T.norm_text("t").alias("term_label"))
    facts = L.label_attributes(rows.select(F.col("query_label").alias("x")).union(rows.select("term_label")), "x")
    return L.attribute_evidence(rows, facts).select("id", F.array_join("conflicts", ",").alias("conflicts"), F.array_join("missing", ",").alias("missing"))


def _lexical(spark, sf):
    rows = _pairs(spark, sf)
    cov, un = T.lexical_evidence("l", "r")
    core, core_un = T.lexical_evidence("l", "r", L.CORE_STOP)
    return rows.select("query_id", cov.alias("coverage"), F.array_join(un, " ").alias("unmatched"), core.alias("core_coverage"), F.array_join(core_un, " ").alias("core_unmatched"))


def _specimen(spark, sf):
    text = F.concat(F.lit("Examen de "), F.when(F.col("p_size") % 3 == 0, "sangre").when(F.col("p_size") % 3 == 1, "orina").otherwise(F.col("p_name")))
    return view(spark, sf, "part").select("p_partkey", S.specimen_intent(T.norm_text(text)).alias("intent"))


# Department slugs per record class.
IMAGING = ["resonancia-magnetica", "rayos-x", "tomografia", "ultrasonido", "mastografia", "densitometria"]


def service_type(department, title):
    text = T.norm_text(title)
    panel = text.rlike("^(perfil|paquete|check up|chequeo) ")
    return (
        F.when(department.isin(*IMAGING), "imaging").when(department == "cardiologia", "cardiology")
        .when(department.isin("audiometria", "espirometria"), "functional_test").when(department.isin("colposcopia", "servicios-medicos"), "other")
        .when(panel, "lab_panel").otherwise("lab_test"))


_DEPARTMENT = "CASE p_size % 6 WHEN 0 THEN 'rayos-x' WHEN 1 THEN 'cardiologia' WHEN 2 THEN 'audiometria' WHEN 3 THEN 'colposcopia' ELSE 'laboratorio' END"
_TITLE = "CASE WHEN p_partkey % 2 = 0 THEN concat('Perfil ', p_name) ELSE p_name END"


def _service_type(spark, sf):
    return view(spark, sf, "part").select("p_partkey", service_type(F.expr(_DEPARTMENT), F.expr(_TITLE)).alias("record_class"))


QUERIES = {
    "norm_text": _norm,
    "repair_text": _repair,
    "trgm_similarity": _pair_query(similarity=lambda: _double(T.trgm_similarity("l", "r"))),
    "trgm_word_similarity": _word_similarity,
    "char3_jaccard": _pair_query(similarity=lambda: T.char3_jaccard("l", "r")),
    "token_overlap": _pair_query(overlap=lambda: T.token_overlap("l", "r")),
    "initialism": _initialism,
    "article_fold": _article,
    "token_score": _pair_query(
        first_score=lambda: S.token_score(F.coalesce(F.get(T.tokens("l"), 0), F.lit("")), F.get(T.tokens("r"), 0)).cast("bigint"),
        joined_score=lambda: S.token_score(F.replace(F.col("l"), F.lit(" "), F.lit("")), F.replace(F.col("r"), F.lit(" "), F.lit(""))).cast("bigint")),
    "assignment_score": _pair_query(score=lambda: F.round(S.assignment_score(S.search_tokens("l"), S.search_tokens("r")), 6)),
    "price_minor": _price,
    "parse_coords": _coords,
    "haversine_m": _haversine,
    "display_address": _address,
    "slugify": _slug,
    "stable_id": _stable,
    "branch_similarity": _pair_query(similarity=lambda: F.round(T.branch_similarity("l", "r"), 6)),
    "lexical_evidence": _lexical,
    "label_attributes": _label_attributes,
    "attribute_evidence": _evidence,
    "preserves_qualifiers": _pair_query(
        kept=lambda: S.preserves_qualifiers("l", "r"), swapped=lambda: S.preserves_qualifiers(F.concat("r", F.lit(" igg total")), F.concat("r", F.lit(" igg libre total")))),
    "specimen_intent": _specimen,
    "service_type": _service_type,
    "content_hash": _content_hash,
    "safe_url": _safe_url,
    "site_host": _site_host,
    "redact_text": _redact,
    "redact_json": _redact_json,
    "table_digest": _digest,
}

_P = duck("label_pairs") + f", n AS (SELECT query_id, {D.norm('l')} AS l, {D.norm('r')} AS r FROM label_pairs)"
_G = _P + f", g AS (SELECT query_id, l, r, {D.tri('l')} AS ls, {D.tri_ordered('l')} AS lo, {D.tri('r')} AS rs FROM n)"
_STOP = D.string_list(T.STOPWORDS)


def _mean(x: str, low: int = 3, stop: str = _STOP) -> str:
    return f"list_distinct(list_filter({D.toks(x)}, lambda w: length(w) >= {low} AND NOT list_contains({stop}, w)))"


def _tok_score(q: str, t: str) -> str:
    lit = D.string_list(S.LITERAL)
    swap = (f"len(list_filter(range(1, length({q})), lambda i: {q} <> left({t}, length({q})) AND {q} = substr({t}, 1, i - 1) || substr({t}, i + 1, 1) || substr({t}, i, 1) || substr(left({t}, length({q})), i + 2))) > 0")
    cap = f"CASE WHEN least(length({q}), length({t})) >= 12 THEN 3 ELSE 2 END"
    return (f"CASE WHEN {q} = {t} THEN 100 WHEN length({q}) < 5 OR length({t}) < 5 OR list_contains({lit}, {q}) OR list_contains({lit}, {t}) OR regexp_matches({q} || {t}, '[0-9]') THEN 0 "
            f"WHEN starts_with({t}, {q}) AND length({q})::DOUBLE / length({t}) >= 0.55 THEN 80 WHEN length({q}) < 7 OR length({t}) < 7 THEN 0 "
            f"WHEN length({t}) > length({q}) AND length({q})::DOUBLE / length({t}) >= 1.0 / 3 AND {swap} THEN 50 "
            f"WHEN levenshtein({q}, {t}) <= {cap} AND levenshtein({q}, {t})::DOUBLE / greatest(length({q}), length({t})) <= 0.24 THEN 70 - levenshtein({q}, {t}) * 8 ELSE 0 END")


_DICT_VALUES = ", ".join(f"('{word}', '{dimension}', '{value}')" for word, dimension, value in L.LABEL_WORDS)
_SITES, _NUMERALS = "|".join(L.POSTURAL_SITES), "|".join(L.FACTOR_NUMERALS)


def _facts(source: str) -> str:
    marks = "i|1|primero|ii|2|segundo|iii|3|tercero|iv|4|cuarto"
    return f"""
  words AS (SELECT DISTINCT nl, unnest({D.toks("regexp_replace(' ' || nl || ' ', '( (?:" + _SITES + ") de )pie ', '\\1 ', 'g')")}) AS token FROM {source}),
  facts AS (
    SELECT DISTINCT w.nl, d.dimension, d.value FROM words w JOIN (VALUES {_DICT_VALUES}) d(token, dimension, value) USING (token)
    UNION SELECT nl, 'contrast', 'without' FROM {source} WHERE list_contains({D.toks('nl')}, 'simple') OR (list_contains({D.toks('nl')}, 'sin') AND list_contains({D.toks('nl')}, 'contraste'))
    UNION SELECT nl, 'contrast', 'with' FROM {source} WHERE list_contains({D.toks('nl')}, 'contraste') AND (NOT list_contains({D.toks('nl')}, 'sin') OR list_contains({D.toks('nl')}, 'con'))
    UNION SELECT nl, 'coagulation_factor_literal', regexp_extract(' ' || nl || ' ', ' factor ({_NUMERALS}) ', 1) FROM {source} WHERE regexp_matches(' ' || nl || ' ', ' factor ({_NUMERALS}) ')
    UNION SELECT nl, 'trimester', CASE WHEN m IN ('i', '1', 'primero') THEN '1' WHEN m IN ('ii', '2', 'segundo') THEN '2' WHEN m IN ('iii', '3', 'tercero') THEN '3' ELSE '4' END
      FROM (SELECT nl, unnest(string_split(trim(regexp_extract(' ' || nl || ' ', ' trimestre ((?:(?:{marks}|y) )+)', 1)), ' ')) AS m FROM {source}) WHERE m NOT IN ('y', ''))"""


def _evidence_sql() -> str:
    return duck("clinical_labels") + f""",
  rows AS (SELECT id, {D.norm('q')} AS ql, {D.norm('t')} AS tl FROM clinical_labels),
  src AS (SELECT DISTINCT nl FROM (SELECT ql AS nl FROM rows UNION SELECT tl FROM rows) WHERE nl <> ''), {_facts('src')},
  dims AS (SELECT DISTINCT dimension FROM facts),
  sets AS (SELECT nl, dimension, list_sort(list(DISTINCT value)) AS vs FROM facts GROUP BY nl, dimension),
  both_sides AS (
    SELECT r.id, d.dimension, coalesce(a.vs, []) AS raw, coalesce(b.vs, []) AS t,
           CASE WHEN d.dimension = 'panel_scope' AND coalesce(a.vs, []) = ['complete'] AND len(coalesce(b.vs, [])) = 0
                     AND list_contains({D.toks('r.ql')}, 'biometria') AND list_contains({D.toks('r.ql')}, 'hematica') THEN [] ELSE coalesce(a.vs, []) END AS q
    FROM rows r CROSS JOIN dims d LEFT JOIN sets a ON a.nl = r.ql AND a.dimension = d.dimension LEFT JOIN sets b ON b.nl = r.tl AND b.dimension = d.dimension),
  judged AS (
    SELECT id, CASE
        WHEN dimension IN ('modality', 'anatomy', 'trimester') THEN CASE WHEN len(t) > 0 THEN list_transform(list_filter(q, lambda v: NOT list_contains(t, v)), lambda v: dimension || ':' || v || '!=' || array_to_string(t, '|')) ELSE [] END
        WHEN dimension LIKE '%_literal' THEN CASE WHEN len(q) > 0 AND len(t) > 0 AND q <> t THEN [dimension || ':' || array_to_string(q, '|') || '!=' || array_to_string(t, '|')] ELSE [] END
        WHEN len(q) > 0 AND len(t) > 0 AND NOT list_has_any(q, t) THEN
          CASE WHEN dimension = 'contrast' THEN [dimension || ':' || array_to_string(q, '|') || '!=' || array_to_string(t, '|')]
               ELSE list_transform(q, lambda v: dimension || ':' || v || '!=' || array_to_string(t, '|')) END
        ELSE [] END AS conflicts,
      CASE WHEN dimension IN ('modality', 'anatomy', 'trimester') OR dimension LIKE '%_literal' THEN CASE WHEN len(t) = 0 THEN list_transform(q, lambda v: dimension || ':' || v) ELSE [] END
        WHEN len(q) > 0 AND len(t) > 0 AND NOT list_has_any(q, t) THEN []
        ELSE list_transform(list_filter(q, lambda v: NOT list_contains(t, v)), lambda v: dimension || ':' || v) END AS missing
    FROM both_sides)
  SELECT id, array_to_string(list_sort(flatten(list(conflicts))), ',') AS conflicts, array_to_string(list_sort(flatten(list(missing))), ',') AS missing FROM judged GROUP BY id"""


_DOCN = f"SELECT doc_id, {D.norm('text')} AS n FROM documents"

ORACLES = {
    "norm_text": f"SELECT doc_id, md5(n) AS normalized_md5 FROM ({_DOCN})",
    "trgm_similarity": _G + f" SELECT query_id, round({D.jaccard('ls', 'rs')}::DOUBLE, 6) AS similarity FROM g",
    "trgm_word_similarity": _G + f" SELECT query_id, round({D.word_sim('rs', 'lo')}::DOUBLE, 6) AS similarity FROM g",
    "char3_jaccard": _P + f", h AS (SELECT query_id, {D.char3('l')} AS a, {D.char3('r')} AS b FROM n) SELECT query_id, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM h",
    "token_overlap": _P + f", h AS (SELECT query_id, {_mean('l')} AS a, {_mean('r')} AS b FROM n) SELECT query_id, len(a) = 0 OR len(b) = 0 OR len(list_filter(a, lambda x: len(list_filter(b, lambda y: starts_with(x, y) OR starts_with(y, x))) > 0)) > 0 AS overlap FROM h",
    "initialism": f"SELECT doc_id, md5(array_to_string(list_transform(list_filter({D.toks('n')}, lambda w: length(w) >= 3 AND regexp_full_match(w, '[a-z]+') AND NOT list_contains({_STOP}, w)), lambda w: left(w, 1)), '')) AS initials_md5 FROM ({_DOCN})",
    "article_fold": f"SELECT doc_id, md5(array_to_string(list_filter({D.toks('n')}, lambda w: NOT list_contains({D.string_list(T.ARTICLES)}, w)), ' ')) AS folded_md5 FROM ({_DOCN})",
    "repair_text": "SELECT doc_id, TRUE AS restored, TRUE AS kept FROM documents",
    "token_score": _P + f", h AS (SELECT query_id, string_split(l, ' ')[1] AS a, string_split(r, ' ')[1] AS b, replace(l, ' ', '') AS x, replace(r, ' ', '') AS y FROM n) SELECT query_id, ({_tok_score('a', 'b')})::BIGINT AS first_score, ({_tok_score('x', 'y')})::BIGINT AS joined_score FROM h",
    "price_minor": """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice::DECIMAL(14,2) * 100)::BIGINT AS minor,
        (l_extendedprice::DECIMAL(14,1) * 100)::BIGINT AS regular, CASE WHEN l_tax > 0 THEN round(l_tax::DECIMAL(14,2) * 100)::BIGINT END AS online, round(l_extendedprice::DECIMAL(14,2) * 100)::BIGINT AS decimal_minor FROM lineitem""",
    "parse_coords": "SELECT c_custkey, CASE WHEN a BETWEEN -90 AND 90 THEN a END AS lat, CASE WHEN a BETWEEN -90 AND 90 THEN b END AS lon FROM (SELECT c_custkey, (c_acctbal / 50)::DECIMAL(12,4)::DOUBLE AS a, (c_custkey % 360 - 180)::DOUBLE AS b FROM customer)",
    "haversine_m": duck("locations") + f" SELECT location_id, round({D.haversine('lat', 'lon', '19.04', '(-98.2)')}, 3) AS meters FROM locations",
    "display_address": duck("locations") + " SELECT location_id, CASE WHEN trim(line1) <> '' THEN concat_ws(', ', trim(line1), nullif(trim(line2), ''), nullif(trim(locality), ''), 'C.P. ' || trim(postal_code)) END AS address FROM locations",
    "slugify": """SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
        'generic_' || regexp_replace(replace(replace(h, '-', '_'), '.', '_'), '[^a-z0-9_]', '', 'g') AS source_key FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages)""",
    "stable_id": f"SELECT page_id, left(sha256('page|' || url || '|' || {D.norm('html')}), 32) AS stable_id FROM pages",
    "branch_similarity": _P + f", h AS (SELECT query_id, {_mean('l', 1, D.string_list(T.VENUE_WORDS))} AS a, {_mean('r', 1, D.string_list(T.VENUE_WORDS))} AS b FROM n) SELECT query_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)) END, 6) AS similarity FROM h",
    "lexical_evidence": _P + f", h AS (SELECT query_id, {_mean('l')} AS a, {_mean('r')} AS b, {_mean('l', 3, D.string_list(L.CORE_STOP))} AS ca, {_mean('r', 3, D.string_list(L.CORE_STOP))} AS cb FROM n) "
        "SELECT query_id, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / len(a), 3) END AS coverage, array_to_string(list_sort(list_filter(a, lambda w: NOT list_contains(b, w))), ' ') AS unmatched, "
        "CASE WHEN len(ca) > 0 THEN round(len(list_intersect(ca, cb))::DOUBLE / len(ca), 3) END AS core_coverage, array_to_string(list_sort(list_filter(ca, lambda w: NOT list_contains(cb, w))), ' ') AS core_unmatched FROM h",
    "label_attributes": duck("clinical_labels") + f", src AS (SELECT DISTINCT {D.norm('q')} AS nl FROM clinical_labels), {_facts('src')} SELECT * FROM facts",
    "attribute_evidence": _evidence_sql(),
    "preserves_qualifiers": _P + f", h AS (SELECT query_id, list_filter({D.toks('l')}, lambda w: NOT list_contains({D.string_list(S.SEARCH_STOP)}, w)) AS a, {D.toks('r')} AS b FROM n) "
        f"SELECT query_id, len(list_filter(a, lambda w: (regexp_matches(w, '[0-9]') OR length(w) = 1 OR list_contains({D.string_list(S.LITERAL)}, w)) AND NOT list_contains(b, w))) = 0 AS kept, FALSE AS swapped FROM h",
    "assignment_score": _P + f""", h AS (SELECT query_id, {D.toks('l')} AS a, {D.toks('r')} AS b FROM n),
      s AS (SELECT query_id, len(a) AS k, {_tok_score('a[1]', 'b[1]')} AS s11, {_tok_score('a[1]', 'b[2]')} AS s12, coalesce({_tok_score('a[2]', 'b[1]')}, 0) AS s21, coalesce({_tok_score('a[2]', 'b[2]')}, 0) AS s22 FROM h)
      SELECT query_id, CASE WHEN k = 1 AND greatest(s11, s12) > 0 THEN greatest(s11, s12) - 1.0::DOUBLE WHEN k = 2 AND s12 > s11 AND s21 > 0 THEN (s12 + s21) / 2.0::DOUBLE WHEN k = 2 AND s11 >= s12 AND s11 > 0 AND s22 > 0 THEN (s11 + s22) / 2.0::DOUBLE ELSE 0 END AS score FROM s""",
    "specimen_intent": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'blood' WHEN 1 THEN 'urine' END AS intent FROM part",
    "service_type": f"SELECT p_partkey, CASE d WHEN 'rayos-x' THEN 'imaging' WHEN 'cardiologia' THEN 'cardiology' WHEN 'audiometria' THEN 'functional_test' WHEN 'colposcopia' THEN 'other' ELSE CASE WHEN t LIKE 'Perfil %' THEN 'lab_panel' ELSE 'lab_test' END END AS record_class FROM (SELECT p_partkey, {_DEPARTMENT} AS d, {_TITLE} AS t FROM part)",
    "content_hash": "SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS record_hash FROM events",
    "safe_url": "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_replace(url, '[?#].*$', '') END AS clean, CASE WHEN starts_with(url, 'https://') THEN regexp_replace(url, '[?#].*$', '') END AS https_clean, NULL::VARCHAR AS with_login FROM pages",
    "site_host": "SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\\.', '') AS host, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\\.', '') AS bare_host FROM pages",
    "redact_json": "SELECT event_id, '{\"apiKey\":\"[REDACTED]\",\"list\":[{\"p\":{\"k\":' || json_extract_string(props, '$.k') || '},\"token\":\"[REDACTED]\"}]}' AS payload FROM events",
    "redact_text": """SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(translate(html, chr(13) || chr(10), '  '), '\\bhttps?://[^\\s<>"'']+', '[REDACTED]', 'gi'),
        '([?&](?:token|api[_-]?key|access[_-]?token|refresh[_-]?token|signature|sig|key)=)[^&#\\s]+', '\\1[REDACTED]', 'gi'), '(bearer\\s+)[^\\s]+', '\\1[REDACTED]', 'gi')) AS redacted_md5, '[REDACTED] Bearer [REDACTED] ?token=[REDACTED] y' AS redacted_url FROM pages""",
    "table_digest": "SELECT count(*) AS row_count FROM lineitem",
}
