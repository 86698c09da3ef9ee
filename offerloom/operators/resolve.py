"""Bulk label resolution: a table of queries against the governed catalog.

Queries are de-duplicated to (normalized text, provider) first; every stage is a join, a grouped
aggregate or a window over that key, and results go back to query ids at the end. A window group
holds the accepted items of one distinct query, so it is bounded by the catalog.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import (
    evaluated, extent_similarity, ordered_trigrams, norm_text, set_similarity, shared_positions, tokens, trigrams, words_array,
)
from ..session import by_shuffle, cut_lineage, spread
from .blocking import candidate_pairs, contained_terms, containing_terms, overlap_candidates

# Acceptance thresholds of the resolver.
SIMILARITY_MIN, WORD_MIN, DISAMBIGUATION_MIN, SEARCH_MIN = 0.35, 0.45, 0.70, 0.25
ACCEPT_MIN, ATTRIBUTE_RATIO_MIN, ATTRIBUTE_BONUS, RANK_GAP, TOKEN_MIN, FUZZY_MIN = 0.45, 0.80, 0.12, 0.15, 0.80, 0.75
# Attribute types that can contradict an item; specimen only ever supports it.
CONFLICT_TYPES = ["service_type", "component", "method", "modality", "anatomical_site", "laterality", "contrast_mode"]
MATCH_TYPES = CONFLICT_TYPES + ["specimen"]
# Query words that carry no requirement of their own.
GUARD_STOP = [
    "para", "como", "desde", "entre", "sobre", "este", "esta", "estos", "estas", "con", "sin", "del", "las", "los",
    "una", "uno", "por", "que", "sus", "en", "de", "el", "la", "y",
]
REQUIREMENT_STOP = ["de", "del", "el", "la", "los", "las", "en"]
TERMINOLOGY_SYSTEM = "http://loinc.org"


@dataclass
class Catalog:
    """Catalog tables. Names: item_id, locale, name, is_primary, created_at. Aliases: item_id, alias,
    provider_id, confidence, status. Descriptions: item_id, description, status. Disambiguation:
    term, item_id, status. Lexicon: phrase, attribute_type, attribute_value, status. Attributes:
    item_id, attribute_type, attribute_value. Identifiers: item_id, system, code, version,
    mapping_type, status, verified, approved_at, created_at."""

    items: DataFrame
    names: DataFrame
    aliases: DataFrame
    descriptions: DataFrame | None = None
    disambiguation: DataFrame | None = None
    lexicon: DataFrame | None = None
    attributes: DataFrame | None = None
    identifiers: DataFrame | None = None

    def active_items(self, domain: str | None = None) -> DataFrame:
        rows = self.items.filter("status = 'active'")
        if domain is not None:
            rows = rows.filter(F.col("domain_code") == domain)
        return rows.select("item_id")

    def display_names(self) -> DataFrame:
        primary = self.names.filter("is_primary")
        best = F.min(F.struct((F.col("locale") != "es-MX").alias("other"), "name"))
        return primary.groupBy("item_id").agg(best["name"].alias("primary_name"))


def clamp(limit: int | None, default: int = 10) -> int:
    """The caller's limit, at least one row; a missing one is the default."""
    return max(1, default if limit is None else limit)


def search_terms(catalog: Catalog, domain: str | None = None, descriptions: bool = False) -> DataFrame:
    """Names and approved aliases (optionally descriptions) of active items, with their weight."""
    active = catalog.active_items(domain)
    no_provider = F.lit(None).cast("string").alias("term_provider")
    parts = [
        catalog.names.select(
            "item_id", F.col("name").alias("term"), F.lit("name").alias("term_source"), no_provider,
            F.when(F.col("is_primary"), 1.0).otherwise(0.98).alias("weight")),
        catalog.aliases.filter("status = 'approved'").select(
            "item_id", F.col("alias").alias("term"), F.lit("alias").alias("term_source"),
            F.col("provider_id").cast("string").alias("term_provider"), F.col("confidence").cast("double").alias("weight")),
    ]
    if descriptions and catalog.descriptions is not None:
        parts.append(catalog.descriptions.filter("status = 'approved'").select(
            "item_id", F.col("description").alias("term"), F.lit("description").alias("term_source"), no_provider,
            F.lit(0.90).alias("weight")))
    terms = parts[0]
    for part in parts[1:]:
        terms = terms.unionByName(part)
    return terms.join(active, "item_id", "left_semi").withColumn("nt", norm_text("term")).filter("nt <> ''")


def distinct_queries(queries: DataFrame) -> DataFrame:
    """Distinct (nq, provider_id) of a queries table (query_id, query_text, provider_id)."""
    return (
        queries.select(norm_text("query_text").alias("nq"), F.col("provider_id").cast("string").alias("provider_id"))
        .filter("nq <> ''")
        .distinct()
    )


def with_features(pairs: DataFrame) -> DataFrame:
    """similarity (FLOAT), word_similarity of the term in the query (FLOAT), containment flags."""
    grams = evaluated(spread(pairs), qo=ordered_trigrams("nq"), tg=trigrams("nt"))
    placed = evaluated(grams, at=shared_positions(F.col("tg"), F.col("qo")))
    return evaluated(
        placed,
        similarity=set_similarity(F.array_distinct("qo"), F.col("tg")),
        word_similarity=extent_similarity(F.col("tg"), F.col("qo"), F.col("at")),
        query_has_term=F.contains("nq", "nt"),
        term_has_query=F.contains("nt", "nq"),
    ).drop("qo", "tg", "at")


def _numeric(value) -> Column:
    return F.round(F.col(value).cast("double"), 6) if isinstance(value, str) else F.round(value.cast("double"), 6)


def scope_terms(query_pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Attach terms to (nq, provider_id, nt) rows: global terms by text, own ones by text and provider."""
    shared = terms.filter("term_provider is null")
    own = terms.filter("term_provider is not null")
    return query_pairs.join(shared, "nt").unionByName(
        query_pairs.join(own.withColumn("provider_id", F.col("term_provider")), ["nt", "provider_id"])
        .select(*query_pairs.columns, *[n for n in shared.columns if n != "nt"])
    )


# --- smallest complete search -------------------------------------------------------------------

def search_items_v1(queries: DataFrame, catalog: Catalog, domain: str | None = None, limit: int = 10) -> DataFrame:
    """Weighted trigram search: best term per item (own provider first), top items per query."""
    terms = cut_lineage(search_terms(catalog, domain))
    q = cut_lineage(spread(distinct_queries(queries)))
    texts = terms.select("nt").distinct()
    asked = q.select("nq").distinct()
    inside = evaluated(containing_terms(asked, texts), similarity=set_similarity(trigrams("nt"), trigrams("nq")))
    pairs = (
        overlap_candidates(asked, texts, SEARCH_MIN, similar=True)
        .filter((F.col("nt") == F.col("nq")) | (F.col("similarity") >= SEARCH_MIN) | F.contains("nt", "nq"))
        .unionByName(inside).distinct()
    )
    scored = scope_terms(q.join(by_shuffle(pairs), "nq"), terms).withColumn(
        "weighted_score", F.round(_numeric("similarity") * F.col("weight"), 6))
    best = scored.groupBy("nq", "provider_id", "item_id").agg(
        F.min(F.struct(
            F.col("term_provider").isNull().alias("shared"), (-F.col("weighted_score")).alias("neg"),
            "term_source", "term", "similarity", "weighted_score", "term_provider")).alias("b"))
    named = best.join(catalog.display_names(), "item_id", "left").select(
        "nq", "provider_id", "item_id", F.coalesce("primary_name", "b.term").alias("display_name"),
        F.col("b.term").alias("matched_term"), F.col("b.term_source").alias("term_source"),
        F.col("b.term_provider").alias("term_provider"),
        _numeric("b.similarity").alias("similarity_score"), F.col("b.weighted_score").alias("weighted_score"))
    order = W.partitionBy("nq", "provider_id").orderBy(F.desc("weighted_score"), "display_name", "item_id")
    top = named.withColumn("result_rank", F.row_number().over(order)).filter(F.col("result_rank") <= clamp(limit))
    return to_query_ids(queries, top)


def to_query_ids(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Bring (nq, provider_id) results back to every query id that asked for them."""
    keyed = queries.select(
        "query_id", norm_text("query_text").alias("nq"), F.coalesce(F.col("provider_id").cast("string"), F.lit("")).alias("pk"))
    return keyed.join(by_shuffle(rows.withColumn("pk", F.coalesce("provider_id", F.lit("")))), ["nq", "pk"]).drop("pk", "provider_id")


# --- query evidence -----------------------------------------------------------------------------

def query_attributes(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(nq, attribute_type, attribute_value) of the approved phrases a query text contains."""
    phrases = lexicon.filter("status = 'approved'").withColumn("nt", norm_text("phrase")).filter("nt <> ''")
    return (
        contained_terms(texts, phrases.select("nt").distinct()).distinct()
        .join(phrases, "nt").select("nq", "attribute_type", "attribute_value").distinct()
    )


def query_disambiguation(texts: DataFrame, disambiguation: DataFrame) -> DataFrame:
    """(nq, nt, features) of approved ambiguous terms equal to, or similar to an extent of, the query."""
    terms = disambiguation.filter("status = 'approved'").select(norm_text("term").alias("nt")).filter("nt <> ''").distinct()
    pairs = overlap_candidates(texts, terms, DISAMBIGUATION_MIN)
    return with_features(pairs).filter((F.col("nq") == F.col("nt")) | (F.col("word_similarity") >= DISAMBIGUATION_MIN))


# --- stage 1 ------------------------------------------------------------------------------------

def resolve_candidates(queries: DataFrame, catalog: Catalog, domain: str | None = None) -> DataFrame:
    """Best scored term per (query, item), before the attribute gate.

    Ambiguous terms take part in the same candidate pass as the catalog terms; ``has_disambiguation``
    marks every row of a query that met one, whatever became of the items behind it.
    """
    # both sides feed several candidate passes and the scoring joins: computed once
    q = cut_lineage(spread(distinct_queries(queries)))
    terms = cut_lineage(search_terms(catalog, domain, descriptions=True))
    texts = terms.select("nt")
    if catalog.disambiguation is not None:
        flagged = disambiguation_terms(catalog)
        texts = texts.unionByName(flagged.select("nt"))
    pairs = with_features(candidate_pairs(q.select("nq").distinct(), texts.distinct(), SIMILARITY_MIN)).filter(
        F.col("query_has_term") | F.col("term_has_query")
        | (F.col("similarity") >= SIMILARITY_MIN) | (F.col("word_similarity") >= WORD_MIN))
    rows = q.join(by_shuffle(pairs), "nq")
    if catalog.disambiguation is not None:
        met = (F.col("nq") == F.col("nt")) | (F.col("word_similarity") >= DISAMBIGUATION_MIN)
        rows = scope_terms(rows, terms.withColumn("usable", F.lit(True)).unionByName(flagged)).filter(
            (F.col("term_source") != "disambiguation") | met)
    else:
        rows = scope_terms(rows, terms.withColumn("usable", F.lit(True)))
    exact = F.col("nt") == F.col("nq")
    fuzzy = F.greatest(_numeric("similarity") * F.col("weight"), _numeric("word_similarity") * F.col("weight"))
    lexical = (
        F.when(exact, 1.0).when(F.col("term_source") == "disambiguation", 0.92)
        .when(F.col("query_has_term"), 0.88).otherwise(F.round(fuzzy, 6))
    )
    best = rows.groupBy("nq", "provider_id", "item_id").agg(
        F.min(F.struct(
            (~exact).alias("inexact"), (-F.col("weight")).alias("w"), (-F.col("word_similarity")).alias("ws"),
            (-F.col("similarity")).alias("s"), "term_source", "nt", "term", "term_provider",
            _numeric("similarity").alias("similarity_score"), _numeric("word_similarity").alias("word_score"),
            lexical.alias("lexical_score"))).alias("b"),
        F.bool_or(F.col("term_source") == "disambiguation").alias("met"), F.bool_or("usable").alias("usable"))
    best = best.withColumn("has_disambiguation", F.bool_or("met").over(_per_query())).filter("usable")
    return best.join(catalog.display_names(), "item_id", "left").select(
        "nq", "provider_id", "item_id", F.coalesce("primary_name", "b.term").alias("display_name"),
        F.col("b.term").alias("matched_term"), F.col("b.nt").alias("nt"), F.col("b.term_source").alias("term_source"),
        F.col("b.term_provider").alias("term_provider"), "b.similarity_score", "b.word_score", "b.lexical_score",
        "has_disambiguation")


def disambiguation_terms(catalog: Catalog) -> DataFrame:
    """Approved ambiguous terms as term rows; those of inactive items only flag the query."""
    active = catalog.active_items().withColumn("usable", F.lit(True))
    return (
        catalog.disambiguation.filter("status = 'approved'").join(active, "item_id", "left")
        .select(
            "item_id", "term", F.lit("disambiguation").alias("term_source"), F.lit(None).cast("string").alias("term_provider"),
            F.lit(0.90).alias("weight"), norm_text("term").alias("nt"), F.coalesce("usable", F.lit(False)).alias("usable"))
        .filter("nt <> ''")
    )


def attribute_gate(candidates: DataFrame, attributes: DataFrame, item_attributes: DataFrame) -> DataFrame:
    """Per candidate: attributes asked for, attributes the item has, and whether one contradicts it.

    Types no item attribute can match stay in the count on purpose: they lower the ratio. The two
    collected sets are bounded by the phrases of one query and the attributes of one item.
    """
    fact = F.concat_ws("\u001f", "attribute_type", "attribute_value")
    asked = attributes.groupBy("nq").agg(F.collect_set(F.struct("attribute_type", fact.alias("fact"))).alias("asked"))
    held = item_attributes.groupBy("item_id").agg(F.collect_set(fact).alias("held"))
    none = F.array().cast("array<string>")
    joined = candidates.join(by_shuffle(asked), "nq", "left").join(held, "item_id", "left")

    def count(types, wanted: bool) -> Column:
        return F.size(F.filter(
            F.coalesce("asked", F.array().cast("array<struct<attribute_type:string,fact:string>>")),
            lambda a: a["attribute_type"].isin(*types) & (F.array_contains(F.coalesce("held", none), a["fact"]) == wanted)))

    return joined.withColumns({
        "attribute_count": F.when(F.col("asked").isNull(), 0).otherwise(F.size("asked")).cast("bigint"),
        "attribute_matches": count(MATCH_TYPES, True).cast("bigint"),
        "hard_conflict": count(CONFLICT_TYPES, False) > 0,
    }).drop("asked", "held")


def _per_query() -> object:
    return W.partitionBy("nq", "provider_id")


def _ranked(confidence: str = "confidence"):
    return _per_query().orderBy(F.desc(confidence), "display_name", "item_id")


def accepted_v1(queries: DataFrame, catalog: Catalog, domain: str | None = None) -> DataFrame:
    """Stage-1 rows with confidence, status, method and evidence columns, keyed by (nq, provider_id)."""
    rows = resolve_candidates(queries, catalog, domain)
    if catalog.lexicon is not None and catalog.attributes is not None:
        texts = distinct_queries(queries).select("nq").distinct()
        rows = attribute_gate(rows, query_attributes(texts, catalog.lexicon), catalog.attributes)
    else:
        rows = rows.withColumns({"attribute_count": F.lit(0), "attribute_matches": F.lit(0), "hard_conflict": F.lit(False)})
    ratio = F.when(F.col("attribute_count") == 0, 0.0).otherwise(F.col("attribute_matches") / F.col("attribute_count"))
    rows = rows.filter(
        ~F.col("hard_conflict")
        & ((F.col("lexical_score") >= ACCEPT_MIN) | F.col("term_source").isin("name", "alias", "disambiguation"))
        & ((F.col("attribute_count") == 0) | (ratio >= ATTRIBUTE_RATIO_MIN))
    ).withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("lexical_score") + ratio * ATTRIBUTE_BONUS), 6))
    rows = rows.withColumn("next_score", F.lead("confidence").over(_ranked()))
    close = F.coalesce(F.round(F.col("confidence") - F.col("next_score"), 6) < RANK_GAP, F.lit(False))
    method = (
        F.when(F.col("term_source") == "disambiguation", "disambiguation").when(F.col("lexical_score") >= 0.999, "exact")
        .when(F.col("term_source") == "alias", "alias").when(F.col("word_score") >= F.col("similarity_score"), "word_fuzzy")
        .otherwise("trigram"))
    return rows.withColumns({
        "resolution_status": F.when(F.col("has_disambiguation") | close, "ambiguous").otherwise("resolved"),
        "match_method": method,
    })


# --- guards -------------------------------------------------------------------------------------

def with_token_support(rows: DataFrame) -> DataFrame:
    """meaningful_matches of meaningful_count query words have an equal, prefix or close term word."""
    stop = words_array(GUARD_STOP)
    asked = F.filter(tokens("nq"), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))

    def grams(words: Column) -> Column:
        return F.transform(words, lambda w: F.struct(w.alias("w"), ordered_trigrams(w).alias("o"), trigrams(w).alias("s")))

    words = evaluated(rows, asked=grams(asked), offered=grams(tokens("nt")))

    def supported(word: Column) -> Column:
        return F.exists(
            "offered",
            lambda t: F.startswith(t["w"], word["w"]) | F.startswith(word["w"], t["w"])
            | ((F.size(F.array_intersect(t["s"], word["s"])) >= TOKEN_MIN * F.size(t["s"]))
               & (extent_similarity(t["s"], word["o"]) >= TOKEN_MIN)))

    return evaluated(
        words, meaningful_matches=F.size(F.filter("asked", supported)), meaningful_count=F.size("asked")
    ).drop("asked", "offered")


def guard_v2(rows: DataFrame) -> DataFrame:
    """At least half of the meaningful query words are supported; several candidates are ambiguous."""
    reviewed = F.col("match_method").isin("exact", "alias", "disambiguation")
    rows = with_token_support(rows).filter(
        reviewed | (F.col("meaningful_matches") >= F.greatest(F.lit(1), F.ceil(F.col("meaningful_count") / 2))))
    many = F.count(F.lit(1)).over(_per_query()) > 1
    return rows.withColumn("resolution_status", F.when(many, "ambiguous").otherwise(F.col("resolution_status")))


def guard_v3(rows: DataFrame) -> DataFrame:
    """Every meaningful word and every literal requirement must be met, or the hit is discovery only."""
    reviewed = F.col("match_method").isin("exact", "alias", "disambiguation")
    kept = rows.filter(
        reviewed | ((F.col("meaningful_count") > 0) & (F.col("meaningful_matches") == F.col("meaningful_count"))))
    qt, tt = tokens("nq"), tokens("nt")
    literal = F.forall(qt, lambda w: w.isin(*REQUIREMENT_STOP) | F.array_contains(tt, w))
    identity = (
        F.col("term_source").isin("name", "alias") & F.col("match_method").isin("exact", "alias")
        & (F.col("confidence") == 1) & (F.col("nt") == F.col("nq")))
    prefix = (
        F.col("nq").rlike("^[a-z]{4,40}$") & ~F.array_contains(tt, F.col("nq"))
        & F.exists(tt, lambda t: F.startswith(t, F.col("nq"))))
    kept = kept.withColumns({"literal_present": literal, "exact_identity": identity, "prefix_discovery": prefix})
    kept = kept.withColumn("any_pruned", F.bool_or(~F.col("literal_present")).over(_per_query()))
    kept = kept.withColumn("requirements_pruned", ~F.col("exact_identity") & F.col("any_pruned")).filter(
        F.col("literal_present") | F.col("prefix_discovery"))
    many = F.count(F.lit(1)).over(_per_query()) > 1
    unsafe = F.col("prefix_discovery") | F.col("requirements_pruned") | many
    return kept.withColumn("resolution_status", F.when(unsafe, "ambiguous").otherwise(F.col("resolution_status"))).drop("any_pruned")


def guard_v4(rows: DataFrame) -> DataFrame:
    """Only a single, exact, reviewed identity resolves."""
    many = F.count(F.lit(1)).over(_per_query()) > 1
    unsafe = (
        ~F.col("exact_identity") | F.col("requirements_pruned") | F.col("prefix_discovery") | many
        | (F.col("term_source") == "disambiguation"))
    return rows.withColumn("resolution_status", F.when(unsafe, "ambiguous").otherwise("resolved"))


def guard_v5(rows: DataFrame) -> DataFrame:
    """Exact and alias rows must equal the whole query."""
    return rows.filter(
        ~F.col("match_method").isin("exact", "alias") | (F.col("nt") == F.col("nq")) | (F.col("term_source") == "disambiguation"))


def exact_dominance(rows: DataFrame) -> DataFrame:
    """Exact rows push the fuzzy rows of their query out; a single one resolves unless pruned."""
    exact = F.col("match_method") == "exact"
    rows = rows.withColumn("exact_count", F.count_if(exact).over(_per_query())).filter((F.col("exact_count") == 0) | exact)
    status = (
        F.when(F.col("requirements_pruned"), "ambiguous").when(F.col("exact_count") > 1, "ambiguous")
        .when(F.col("exact_count") == 1, "resolved").otherwise(F.col("resolution_status")))
    return rows.withColumn("resolution_status", status).drop("exact_count")


def identifier_matches(queries: DataFrame, catalog: Catalog, domain: str | None = None) -> DataFrame:
    """Queries that equal a verified terminology code: latest version per item, several items ambiguous."""
    codes = catalog.identifiers.filter(
        (F.lower(F.trim("system")) == TERMINOLOGY_SYSTEM) & (F.col("mapping_type") == "exact") & (F.col("status") == "active")
        & F.col("verified") & F.col("approved_at").isNotNull()
    ).join(catalog.active_items(domain), "item_id", "left_semi")
    latest = codes.withColumn("code_key", F.lower(F.trim("code"))).groupBy("code_key", "item_id").agg(
        F.max(F.struct("created_at", "version", "code")).alias("m"))
    latest = latest.join(catalog.display_names(), "item_id", "left")
    keys = queries.select("query_id", F.lower(F.trim(F.coalesce("query_text", F.lit("")))).alias("code_key"))
    order = W.partitionBy("code_key").orderBy(F.desc("m.version"), "item_id")
    ranked = latest.select(
        "code_key", "item_id", F.coalesce("primary_name", F.col("item_id").cast("string")).alias("display_name"),
        F.col("m.code").alias("matched_term"), F.lit("loinc").alias("term_source"), F.lit(1.0).alias("confidence"),
        F.when(F.count(F.lit(1)).over(W.partitionBy("code_key")) > 1, "ambiguous").otherwise("resolved").alias("resolution_status"),
        F.lit("loinc_exact").alias("match_method"), F.row_number().over(order).alias("result_rank"))
    return keys.join(by_shuffle(ranked), "code_key").drop("code_key")


RESULT = ["query_id", "item_id", "display_name", "matched_term", "term_source", "confidence", "resolution_status",
          "match_method", "result_rank"]


def guarded_v2(queries: DataFrame, catalog: Catalog, domain: str | None = None) -> DataFrame:
    """Stage-2 rows, for callers that write them once and resolve several stages from them."""
    return guard_v2(accepted_v1(queries, catalog, domain))


def resolve(queries: DataFrame, catalog: Catalog, domain: str | None = None, *, stage: int = 6, limit: int = 10,
            evidence: bool = False, guarded: DataFrame | None = None) -> DataFrame:
    """Resolve a queries table (query_id, query_text, provider_id) up to the given stage (1-6).

    Stages see all candidates of a query; the limit is applied once, at the end. ``guarded``: the stage-2 rows of the
    same queries (``guarded_v2``), for stages from 2 on.
    """
    if guarded is not None and stage < 2:
        raise ValueError("stage 1 cannot start from stage-2 rows")
    rows = accepted_v1(queries, catalog, domain) if guarded is None else guarded
    for step, guard in ((2, guard_v2), (3, guard_v3), (4, guard_v4), (5, guard_v5), (6, exact_dominance)):
        if stage >= step and (guarded is None or step > 2):
            rows = guard(rows)
    rows = rows.withColumn("result_rank", F.row_number().over(_ranked())).filter(F.col("result_rank") <= clamp(limit))
    out = to_query_ids(queries, rows)
    columns = RESULT + (["lexical_score", "similarity_score", "word_score", "attribute_count", "attribute_matches"] if evidence else [])
    out = out.select(*columns)
    if stage >= 6 and catalog.identifiers is not None:
        coded = identifier_matches(queries, catalog, domain)
        out = out.join(by_shuffle(coded.select("query_id").distinct()), "query_id", "left_anti").unionByName(
            coded.select(*RESULT), allowMissingColumns=True)
    return out


# --- per query ----------------------------------------------------------------------------------

def resolution_status(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One row per query: no_match, ambiguous or resolved, and the item when it resolved."""
    per = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.bool_or(F.col("resolution_status") == "ambiguous").alias("unclear"),
        F.min_by("item_id", "result_rank").alias("item_id"))
    status = (
        F.when(F.col("candidates").isNull(), "no_match")
        .when((F.col("candidates") > 1) | F.col("unclear"), "ambiguous").otherwise("resolved"))
    return queries.select("query_id").join(by_shuffle(per), "query_id", "left").select(
        "query_id", status.alias("status"), F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"),
        F.when(status == "resolved", F.col("item_id")).alias("item_id"))


def confidence_guard(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate rows with weak fuzzy hits marked, per-query status that a weak hit keeps ambiguous)."""
    weak = F.col("match_method").isin("word_fuzzy", "trigram") & (F.coalesce("confidence", F.lit(0.0)) < FUZZY_MIN)
    marked = results.withColumn("requires_confirmation", weak).withColumn(
        "resolution_status", F.when(weak, "ambiguous").otherwise(F.col("resolution_status")))
    strong = ~F.col("requires_confirmation")
    per = marked.groupBy("query_id").agg(
        F.count_if(strong).alias("safe_count"), F.count_if(~strong).alias("weak_count"),
        F.bool_or(strong & (F.col("resolution_status") == "ambiguous")).alias("safe_ambiguous"))
    status = (
        F.when(F.col("safe_count") == 0, "no_match")
        .when(F.col("safe_ambiguous") | (F.col("safe_count") > 1) | (F.col("weak_count") > 0), "ambiguous").otherwise("resolved"))
    return marked, per.withColumn("status", status).select("query_id", "status", "safe_count", "weak_count")
