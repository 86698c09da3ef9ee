"""Suggestions, offline label resolution, triage of label groups and terminology ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import labels as L
from ..functions.hygiene import safe_url
from ..functions.scoring import assignment_score, preserves_qualifiers, search_tokens, token_score
from ..functions.text import (
    article_fold, char3_set, evaluated, initialism, lexical_evidence, norm_text, set_similarity, token_overlap, tokens, trigrams,
)
from ..session import by_shuffle, cut_lineage, spread
from .blocking import containing_terms, overlap_candidates
from .offers import best_by

# Thresholds of the suggestion and triage rules.
SPELLING_MIN, INITIALISM_SCORE, OFFLINE_MIN, TRIAGE_MIN = 0.55, 0.95, 0.25, 0.55
METHOD_RANK = {"exact": 4, "provider_alias": 3, "alias": 2, "rules": 2, "trigram": 1}
# Terminology field weights and words skipped in its search.
FIELD_WEIGHTS = {
    "long_common_name": 1.00, "shortname": 0.90, "consumer_name": 0.80, "component": 0.70, "property": 0.55, "system": 0.45, "method_typ": 0.40,
}
TERMINOLOGY_STOP = ["a", "and", "con", "de", "del", "el", "en", "in", "la", "of", "on", "para", "por", "the", "y"]


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """First k rows per key; Spark cuts every map partition to k rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def spelling_suggestions(queries: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """Close names (similarity) and generated initialisms per query; navigation only.

    ``names``: item_id, name, is_primary of active items in the search locale.
    """
    q = queries.select("query_id", norm_text("query_text").alias("nq")).filter("nq <> ''")
    n = names.select("item_id", norm_text("name").alias("nt")).filter("nt <> ''")
    texts = q.filter(F.length("nq") >= 4).select("nq").distinct()
    close = evaluated(overlap_candidates(texts, n.select("nt").distinct(), SPELLING_MIN), similarity=set_similarity(trigrams("nt"), trigrams("nq"))).filter(
        F.col("similarity") >= SPELLING_MIN).select("nq", "nt", F.col("similarity").cast("double").alias("score"))
    short = q.filter(F.length("nq").between(2, 8) & F.col("nq").rlike("^[a-z]+$")).select("nq").distinct()
    coined = short.join(n.select(F.col("nt"), initialism("nt").alias("nq")).distinct(), "nq").select(
        "nq", "nt", F.lit(INITIALISM_SCORE).alias("score"))
    scored = close.unionByName(coined).groupBy("nq", "nt").agg(F.max(F.struct((F.col("score") == INITIALISM_SCORE).alias("c"), "score"))["score"].alias("score"))
    per_item = scored.join(n, "nt").groupBy("nq", "item_id").agg(F.max("score").alias("score"))
    primary = names.filter("is_primary").groupBy("item_id").agg(F.min("name").alias("display_name"))
    top = top_k(per_item.join(primary, "item_id"), ["nq"], [F.desc("score"), F.col("item_id")], max(limit, 1), "suggestion_rank")
    return q.join(top, "nq").select("query_id", "item_id", "display_name", F.round("score", 6).alias("score"), "suggestion_rank")


def catalog_suggestions(queries: DataFrame, terms: DataFrame, verified: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """Token-assignment suggestions: top items per query that keep its qualifiers.

    ``terms``: item_id, name. Tokens are matched once as a dictionary join over shared trigrams (any
    positive token score shares one), then each query is blocked on its most selective token only.
    ``verified``: item_id whose own name resolves to it exactly.
    """
    q = queries.select("query_id", norm_text("query_text").alias("nq"))
    texts = evaluated(q.select("nq").distinct(), qt=search_tokens("nq")).filter(
        (F.size("qt") >= 1) & F.exists("qt", lambda w: F.length(w) >= 5))
    t = evaluated(terms.select("item_id", "name", norm_text("name").alias("nt")).distinct(), tt=search_tokens("nt"))
    postings = t.select("item_id", "name", "nt", "tt", F.explode(F.array_distinct("tt")).alias("t_word"))
    frequency = postings.groupBy("t_word").agg(F.count(F.lit(1)).alias("df"))
    asked = texts.select("nq", "qt", F.explode(F.array_distinct("qt")).alias("q_word"))
    words = overlap_words(asked.select("q_word").distinct(), frequency.select("t_word"))
    cost = words.join(frequency, "t_word").groupBy("q_word").agg(F.sum("df").alias("cost"))
    lead = asked.join(cost, "q_word").groupBy("nq", "qt").agg(
        F.count(F.lit(1)).alias("known"), F.min(F.struct("cost", "q_word"))["q_word"].alias("q_word")).filter(
        F.col("known") == F.size(F.array_distinct("qt")))
    pairs = lead.join(words, "q_word").join(postings, "t_word").select("nq", "qt", "item_id", "name", "nt", "tt").distinct()
    scored = evaluated(pairs, score=assignment_score(F.col("qt"), F.col("tt"))).filter("score > 0")
    best = best_by(scored, ["nq", "item_id"], [-F.col("score"), F.col("name")], ["name", "nt", "score"])
    top = top_k(best, ["nq"], [F.desc("score"), F.col("item_id")], limit, "suggestion_rank").filter(preserves_qualifiers("nq", "nt"))
    if verified is not None:
        top = top.join(verified.select("item_id"), "item_id", "left_semi")
    return q.join(top, "nq").select("query_id", "item_id", F.col("name").alias("display_name"), F.round("score", 6).alias("score"), "suggestion_rank")


def overlap_words(query_words: DataFrame, term_words: DataFrame) -> DataFrame:
    """(q_word, t_word) with a positive token score."""
    left = query_words.select("q_word", F.explode(trigrams("q_word")).alias("gram"))
    right = term_words.select("t_word", F.explode(trigrams("t_word")).alias("gram"))
    return left.join(right, "gram").select("q_word", "t_word").distinct().filter(token_score("q_word", "t_word") > 0)


# --- offline resolver ---------------------------------------------------------------------------

def offline_candidates(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """Best candidate per (nq, provider_id, item): exact, alias, initialism or trigram evidence.

    ``labels``: label, provider_id. ``terms``: item_id, display_name, term, term_kind
    ('exact', 'alias', 'provider_alias'), term_provider. Fuzzy candidates below the threshold are not
    listed: they can neither resolve nor change a verdict.
    """
    q = labels.select(norm_text("label").alias("nq"), F.col("provider_id").cast("string").alias("provider_id")).filter("nq <> ''").distinct()
    t = cut_lineage(terms.withColumn("nt", norm_text("term")).filter("nt <> ''"))
    q = cut_lineage(spread(q))
    texts, names = q.select("nq").distinct(), t.select("nt").distinct()
    equal = texts.join(names, texts["nq"] == names["nt"]).select("nq", "nt", F.lit(1.0).alias("score"), F.lit("same").alias("how"))
    coined = names.select("nt", initialism("nt", 2, 8).alias("nq")).join(
        texts.filter(F.length("nq").between(2, 8) & F.col("nq").rlike("^[a-z]+$")), "nq").select("nq", "nt", F.lit(INITIALISM_SCORE).alias("score"), F.lit("rules").alias("how"))
    fuzzy = evaluated(
        overlap_candidates(texts, names, OFFLINE_MIN, char3_set).filter("nq <> nt"),
        overlap=token_overlap("nq", "nt"), a=char3_set("nq"), b=char3_set("nt"))
    common = F.size(F.array_intersect("a", "b"))
    fuzzy = fuzzy.withColumn("score", F.round(common / (F.size("a") + F.size("b") - common), 6)).filter(
        F.col("overlap") & (F.col("score") >= OFFLINE_MIN)).select("nq", "nt", "score", F.lit("trigram").alias("how"))
    pairs = q.join(by_shuffle(equal.unionByName(coined).unionByName(fuzzy)), "nq")
    shared = pairs.join(t.filter("term_kind <> 'provider_alias'"), "nt")
    own = pairs.join(t.filter("term_kind = 'provider_alias'").withColumn("provider_id", F.col("term_provider")), ["nt", "provider_id"]).select(*shared.columns)
    method = F.when(F.col("how") == "same", F.col("term_kind")).otherwise(F.col("how"))
    rank = F.lit(0)
    for name, value in METHOD_RANK.items():
        rank = F.when(F.col("method") == name, value).otherwise(rank)
    rows = shared.unionByName(own).withColumn("method", method).withColumn("method_rank", rank)
    return best_by(rows, ["nq", "provider_id", "item_id"], [-F.col("score"), -F.col("method_rank"), F.col("term")], ["display_name", "score", "method", F.col("term").alias("matched_term")])


def resolve_labels(labels: DataFrame, terms: DataFrame, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(status per (nq, provider_id), ranked candidates). Only a unique exact item resolves."""
    rows = offline_candidates(labels, terms)
    ranked = top_k(rows, ["nq", "provider_id"], [F.desc("score"), F.col("item_id")], limit, "candidate_rank")
    exact = (F.col("score") == 1.0) & F.col("method").isin("exact", "alias", "provider_alias")
    per = rows.groupBy("nq", "provider_id").agg(
        F.count_if(exact).alias("exact_items"), F.min(F.struct((-F.col("score")).alias("s"), "item_id", "method")).alias("top"))
    q = labels.select(norm_text("label").alias("nq"), F.col("provider_id").cast("string").alias("provider_id")).distinct()
    status = (
        F.when(F.col("top").isNull(), "no_match").when(F.col("exact_items") > 1, "ambiguous")
        .when((F.col("exact_items") == 1) & F.col("top.method").isin("exact", "alias", "provider_alias"), "resolved").otherwise("ambiguous"))
    joined = q.withColumn("pk", F.coalesce("provider_id", F.lit(""))).join(
        per.withColumn("pk", F.coalesce("provider_id", F.lit(""))).drop("provider_id"), ["nq", "pk"], "left")
    return joined.select("nq", "provider_id", status.alias("status"), F.when(status == "resolved", F.col("top.item_id")).alias("item_id")), ranked


def triage_groups(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """Outcome, action, holds and cluster key of label groups; fuzzy rank never decides.

    ``groups``: label, provider_id, occurrences, source_type, policy, source_url.
    """
    rows = resolve_labels(groups, terms)[1].filter(F.col("score") >= TRIAGE_MIN).select("nq", "provider_id", "item_id", "display_name", "matched_term", "score", "method")
    q = groups.select(norm_text("label").alias("nq"), F.col("provider_id").cast("string").alias("provider_id")).filter("nq <> ''").distinct()
    t = terms.select("item_id", "display_name", F.col("term").alias("matched_term"), "term_kind", "term_provider", norm_text("term").alias("nt")).withColumn("fold", article_fold("nt"))
    folded = q.withColumn("fold", article_fold("nq")).filter("fold <> ''").join(t, "fold").filter(
        (F.col("nq") != F.col("nt")) & ((F.col("term_kind") != "provider_alias") | (F.col("term_provider") == F.col("provider_id"))))
    folded = folded.select("nq", "provider_id", "item_id", "display_name", "matched_term", F.lit(1.0).alias("score"), F.lit("article_fold").alias("method"))
    exact_first = F.when(F.col("method").isin("exact", "alias", "provider_alias") & (F.col("score") == 1.0), 0).when(F.col("method") == "article_fold", 1).otherwise(2)
    rows = best_by(rows.unionByName(folded), ["nq", "provider_id", "item_id"], [exact_first, -F.col("score"), F.col("matched_term")], ["display_name", "matched_term", "score", "method"])
    # five branches read the candidates below
    rows = cut_lineage(rows.withColumns({"nd": norm_text("display_name"), "nm": norm_text("matched_term")}))
    texts = rows.select(F.col("nq").alias("x")).union(rows.select("nd")).union(rows.select("nm")).distinct()
    facts = cut_lineage(L.label_attributes(texts, "x"))
    def evidence(term: str):
        pairs = rows.select(F.col("nq").alias("query_label"), F.col(term).alias("term_label")).distinct()
        return L.attribute_evidence(pairs, facts).select(F.col("query_label").alias("nq"), F.col("term_label").alias(term), F.col("conflicts").alias(term + "_c"), F.col("missing").alias(term + "_m"))
    judged = rows.join(evidence("nd"), ["nq", "nd"]).join(evidence("nm"), ["nq", "nm"])
    core = lexical_evidence("nq", "nm", L.CORE_STOP)[0]
    rejection = (
        F.when(F.size(F.concat("nd_c", "nm_c")) > 0, "explicit_clinical_attribute_conflict")
        .when((F.col("method") != "rules") & (core == 0), "no_shared_core_terms")
        .when(F.size(F.concat("nd_m", "nm_m")) > 0, "missing_explicit_clinical_specificity"))
    judged = judged.withColumn("rejection", rejection)
    useful = F.col("rejection").isNull()
    per = judged.groupBy("nq", "provider_id").agg(
        F.count_if(useful).alias("useful"), F.count_if(~useful).alias("rejected"), F.count_if(useful & (F.col("score") == 1.0)).alias("exact_items"),
        F.bool_or(useful & (F.col("score") == 1.0) & (F.col("method") == "article_fold")).alias("by_fold"))
    out = groups.withColumns({"nq": norm_text("label"), "pk": F.coalesce(F.col("provider_id").cast("string"), F.lit(""))}).join(
        per.withColumn("pk", F.coalesce("provider_id", F.lit(""))).drop("provider_id"), ["nq", "pk"], "left").fillna(
        {"useful": 0, "rejected": 0, "exact_items": 0, "by_fold": False})
    holds = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("policy") == "approved", F.lit(False)), "source_policy_not_approved"),
        F.when(~F.col("source_type").isin("provider_official", "official_api"), "provider_official_source_unverified"),
        F.when(safe_url("source_url", https_only=True).isNull(), "https_source_missing")))
    outcome = (
        F.when(F.col("exact_items") > 1, "exact_collision_review").when((F.col("exact_items") == 1) & F.col("by_fold"), "deterministic_article_fold_preview")
        .when(F.col("exact_items") == 1, "approved_term_reprocess_preview").when(F.col("useful") > 0, "catalog_gap_with_suggestions").otherwise("catalog_gap"))
    out = out.withColumns({"holds": holds, "outcome": outcome})
    action = (
        F.when(F.col("outcome") == "exact_collision_review", "review_exact_collision").when(F.size("holds") > 0, "review_source_policy")
        .when(F.col("outcome") == "deterministic_article_fold_preview", "preview_deterministic_article_fold").when(F.col("exact_items") == 1, "preview_exact_reprocess")
        .when(F.col("useful") > 0, "review_clinical_equivalence").when(F.col("rejected") > 0, "catalog_gap_after_rejecting_unsafe_candidates")
        .otherwise("catalog_gap_or_new_concept_review"))
    return out.select(
        "label", "provider_id", "occurrences", "outcome", action.alias("review_action"), "holds", "useful", "rejected",
        F.left(F.sha2(F.concat_ws("|", F.coalesce(F.nullif(F.col("pk"), F.lit("")), F.lit("unattributed")), "nq"), 256), F.lit(20)).alias("review_cluster_key"))


def terminology_candidates(queries: DataFrame, index: DataFrame, limit: int = 20) -> DataFrame:
    """Terminology rows per query: 0.65 coverage + 0.20 weighted coverage + 0.15 phrase.

    ``index``: code, the weighted text fields, common_test_rank, common_order_rank. Without the phrase the
    score depends on the words of a query that the index has at all, so queries that agree in those form
    one class. A class meets the rows of its rarest word first, each with its score over all words; it
    meets the rows of its next word only while a row that has none of the earlier words could still reach
    the last place. So rows of a common word are read for those classes only that have nothing
    rarer. Rows whose title contains the query are found by their rarest character windows.
    """
    stop = F.array(*[F.lit(w) for w in TERMINOLOGY_STOP])
    q = queries.select(norm_text("query_text").alias("nq")).distinct().transform(spread).withColumn(
        "words", F.filter(tokens("nq"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))).filter(F.size("words") > 0)
    fields = F.array(*[
        F.struct(F.lit(w).alias("weight"), tokens(norm_text(f)).alias("words")) for f, w in FIELD_WEIGHTS.items() if f in index.columns])
    held = index.select("code", F.inline(fields)).select("code", "weight", F.explode("words").alias("word")).groupBy("code", "word").agg(F.max("weight").alias("weight"))
    lead = [norm_text(f) for f in list(FIELD_WEIGHTS)[:3] if f in index.columns]
    ranks = index.select("code", "common_test_rank", "common_order_rank", F.array_compact(F.array_distinct(F.array(*lead))).alias("titles"))
    profile = held.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("profile"))
    entries = cut_lineage(profile.join(by_shuffle(ranks), "code"))
    vocabulary = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("top"))
    asked = q.select("nq", F.size("words").alias("n"), F.explode("words").alias("word")).groupBy("nq", "n", "word").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.join(by_shuffle(vocabulary), "word").groupBy("nq", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word", "times", "top"))).alias("held"))
    ordered = F.array_contains(tokens("nq"), "panel") | F.array_contains(tokens("nq"), "order")
    keyed = asked.withColumn("ordered", ordered)
    keyed = cut_lineage(keyed.withColumn("class", F.sha2(F.to_json(F.struct("n", "ordered", "held")), 256)))
    classes = cut_lineage(spread(keyed.select("class", "n", "ordered", "held").dropDuplicates(["class"])))
    postings = entries.select("code", "profile", "common_test_rank", "common_order_rank", F.explode(F.map_keys("profile")).alias("word"))

    def scored(rows: DataFrame, bonus: float = 0.0) -> DataFrame:
        has = lambda t: F.map_contains_key("profile", t["word"])
        found = F.filter("held", has)
        matched = F.aggregate(found, F.lit(0).cast("long"), lambda acc, t: acc + t["times"])
        weighted = F.aggregate(found, F.lit(0.0), lambda acc, t: acc + t["times"] * F.element_at("profile", t["word"]))
        popularity = F.when(F.col("ordered"), F.col("common_order_rank")).otherwise(F.col("common_test_rank"))
        rows = evaluated(rows, matched=matched, weighted=weighted).filter("matched > 0")
        score = F.col("matched") / F.col("n") * 0.65 + F.col("weighted") / F.col("n") * 0.20 + bonus
        return rows.withColumns({
            "score": F.round(F.least(score, F.lit(1.0)), 6), "coverage": F.round(F.col("matched") / F.col("n"), 6),
            "popularity": F.when(popularity > 0, popularity).otherwise(1_000_000_000)})

    order = [F.desc("score"), F.desc("coverage"), F.col("popularity"), F.col("code")]
    kept, active, best, step = ["class", "code", "score", "coverage", "popularity"], classes, None, 1
    while True:
        asks = active.withColumn("word", F.element_at("held", step)["word"])
        earlier = F.exists(F.slice("held", 1, step - 1), lambda t: F.map_contains_key("profile", t["word"])) if step > 1 else F.lit(False)
        rows = scored(asks.join(by_shuffle(postings), "word").filter(~earlier)).select(*kept)
        best = cut_lineage(top_k(rows if best is None else best.unionByName(rows), ["class"], order, limit, "place").drop("place"))
        last = best.groupBy("class").agg(F.count(F.lit(1)).alias("places"), F.min("score").alias("least")).filter(F.col("places") >= limit).select("class", "least")
        rest = F.aggregate(F.slice("held", step + 1, F.greatest(F.size("held") - step, F.lit(0))), F.lit(0.0), lambda acc, t: acc + t["times"] * (0.65 + 0.20 * t["top"])) / F.col("n")
        active = cut_lineage(active.filter(F.size("held") > step).join(last, "class", "left").filter(
            F.col("least").isNull() | (F.round(F.least(rest, F.lit(1.0)), 6) >= F.col("least"))).drop("least"))
        step += 1
        if not active.take(1):
            break
    titled = entries.select("code", "profile", "common_test_rank", "common_order_rank", F.explode("titles").alias("nt")).filter("nt <> ''")
    named = containing_terms(keyed.select("nq"), titled.select("nt").distinct())
    phrases = scored(keyed.join(by_shuffle(named), "nq").join(by_shuffle(titled), "nt").dropDuplicates(["nq", "code"]), 0.15).select("nq", *kept[1:])
    phrases = top_k(phrases, ["nq"], order, limit, "place").drop("place")
    plain = keyed.select("nq", "class").join(by_shuffle(best), "class").drop("class")
    rows = plain.join(by_shuffle(phrases.select("nq", "code")), ["nq", "code"], "left_anti").unionByName(phrases)
    return top_k(rows, ["nq"], order, limit, "candidate_rank").select("nq", "code", "score", "coverage", "candidate_rank")
