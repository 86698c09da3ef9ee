"""Establishment identity: classes, duplicates, brand signals, branch matching, website identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hygiene import site_host
from ..functions.numbers import haversine_m
from ..functions.text import VENUE_WORDS, meaningful_tokens, norm_text, repair_text, shared_part
from ..session import cut_lineage
from .offers import best_by
from .spatial import nearest

# Activities that are, or may be, diagnostic, and words that hint at one.
DIRECT_ACTIVITY = "laboratorios medicos y de diagnostico del sector privado"
RELATED_ACTIVITIES = ["laboratorios de pruebas", "consultorios dentales del sector privado"]
RELATED_WORDS = ["radiologia", "ultrasonido", "imagenologia", "medicina nuclear"]
# Weights and distances of the branch match.
W_NAME, W_POSTAL, W_DISTANCE, FAR_M, STRONG_M, SAME_POSTAL_M, REVIEW_M = 0.55, 0.25, 0.20, 1000.0, 350.0, 100.0, 1000.0
#: Names of more common words than this are compared word by word, since the subsets of their words are too many.
SUBSET_WORDS = 6


def classify_census(records: DataFrame) -> DataFrame:
    """direct_clinical, related_clinical or non_clinical by activity and name words."""
    name = F.concat_ws(" ", norm_text(repair_text("name")), norm_text(repair_text("legal_name")))
    activity = norm_text(repair_text("activity"))
    related = activity.isin(*RELATED_ACTIVITIES)
    for word in RELATED_WORDS:
        related = related | F.contains(name, F.lit(word))
    kind = F.when(activity == DIRECT_ACTIVITY, "direct_clinical").when(related, "related_clinical").otherwise("non_clinical")
    review = F.when(F.col("classification") == "direct_clinical", "candidate").when(F.col("classification") == "related_clinical", "review_required").otherwise("excluded")
    return records.withColumn("classification", kind).withColumn("review_status", review)


def site_key(records: DataFrame) -> DataFrame:
    """Adds ``dedupe_key``: legal name or name with 5-decimal coordinates, else with the address."""
    legal, name = norm_text(repair_text("legal_name")), norm_text(repair_text("name"))
    identity = F.when(legal != "", legal).when(name != "", name).otherwise("unknown")
    place = F.when(
        F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat_ws("|", F.format_string("%.5f", "lat"), F.format_string("%.5f", "lon"))
    ).otherwise(norm_text(repair_text("address")))
    return records.withColumn("dedupe_key", F.concat_ws("|", identity, place))


def dedupe_sites(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per site and class with its size, membership of every record).

    Membership stays in long form, so a site with very many observations is never one row or one task.
    """
    keyed = site_key(records)
    sites = keyed.groupBy("classification", "dedupe_key").agg(
        F.min_by(F.struct("name", "record_hash"), "external_record_id").alias("r"), F.min("external_record_id").alias("external_record_id"),
        F.count(F.lit(1)).alias("duplicate_count"))
    members = keyed.select("classification", "dedupe_key", "external_record_id", "record_hash")
    return sites.select("classification", "dedupe_key", "external_record_id", F.col("r.name").alias("name"), F.col("r.record_hash").alias("record_hash"), "duplicate_count"), members


def brand_signal(records: DataFrame, rules: list[tuple[str, str, str | None, str, float]]) -> DataFrame:
    """First matching rule per record: (brand_key, name pattern, legal-name pattern or None, status, confidence)."""
    name, legal = norm_text(repair_text("name")), norm_text(repair_text("legal_name"))
    signal = F.lit(None).cast("struct<brand_key:string,status:string,confidence:double>")
    for brand, pattern, legal_pattern, status, confidence in reversed(rules):
        hit = name.rlike(pattern)
        if legal_pattern is not None:
            hit = hit & legal.rlike(legal_pattern)
        signal = F.when(hit, F.struct(F.lit(brand).alias("brand_key"), F.lit(status).alias("status"), F.lit(confidence).alias("confidence"))).otherwise(signal)
    return records.withColumn("brand_match", signal)


def _subsets(words: Column) -> Column:
    """All subsets of a sorted array of words, each joined to a key; the empty one is the empty string."""
    sets = F.aggregate(words, F.array(F.array().cast("array<string>")), lambda acc, w: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(w)))))
    return F.transform(sets, lambda s: F.array_join(s, " "))


def match_locations(candidates: DataFrame, locations: DataFrame, common_min: int = 20) -> DataFrame:
    """Best provider branch per candidate of the same brand, with match status.

    ``candidates``: candidate_id, brand_key, brand_status, name, postal_code, lat, lon (null brand
    allowed); ``locations``: location_id, brand_key, name, postal_code, lat, lon. A word that more than
    ``common_min`` branches of a brand have is common there; pairs that share another word are formed as
    they are. The score of any other pair depends on the common words both have, the number of words of
    the branch, the postal code and the distance. So for each set of common words of the candidate, number
    of words and postal code (its own, or any) only the nearest branch that has them can win: a
    nearest-neighbour search per such group (``spatial.nearest``), of the lowest id for a candidate without
    coordinates. The result equals that of all pairs, and the pairs of a candidate do not grow with its
    brand. What counts as common only moves work between the two ways.
    """
    c = candidates.filter("brand_key IS NOT NULL").withColumns({
        "cw": meaningful_tokens(norm_text("name"), 1, VENUE_WORDS), "cp": norm_text("postal_code")}).withColumnsRenamed({"lat": "clat", "lon": "clon"})
    p = locations.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumns({
        "pw": meaningful_tokens(norm_text("name"), 1, VENUE_WORDS), "pp": norm_text("postal_code")}).withColumnsRenamed({"lat": "plat", "lon": "plon"})
    p = cut_lineage(p.select("location_id", "brand_key", "pw", "pp", "plat", "plon"))
    words = p.select("location_id", "brand_key", F.explode("pw").alias("word"))
    seen = cut_lineage(words.groupBy("brand_key", "word").agg((F.count(F.lit(1)) > common_min).alias("common")))
    asked = c.select("candidate_id", "brand_key", F.explode("cw").alias("word")).join(seen, ["brand_key", "word"])
    held = words.join(seen, ["brand_key", "word"])
    commons = held.filter("common").groupBy("location_id", "brand_key").agg(F.array_sort(F.collect_set("word")).alias("commons"))
    many = commons.filter(F.size("commons") > SUBSET_WORDS).select("location_id", F.explode("commons").alias("word"))  # too many subsets
    direct = held.filter("NOT common").select("location_id", "brand_key", "word").unionByName(
        many.join(p.select("location_id", "brand_key"), "location_id").select("location_id", "brand_key", "word"))
    by_word = asked.join(direct, ["brand_key", "word"]).select("candidate_id", "location_id")

    def keyed(rows: DataFrame, sets: DataFrame, own: str, postal: str, *others: str) -> DataFrame:
        """A row for each subset of the common words, for any postal code ('') and for the own one."""
        empty = F.array().cast("array<string>")
        listed = rows.join(sets, own, "left").withColumn("commons", F.coalesce("commons", empty))
        listed = listed.withColumn("commons", F.when(F.size("commons") <= SUBSET_WORDS, F.col("commons")).otherwise(empty))
        codes = F.array_distinct(F.array(F.lit(""), F.col(postal)))
        return listed.select(own, "brand_key", *others, F.explode(_subsets(F.col("commons"))).alias("words"), codes.alias("codes")).select(
            own, "brand_key", *others, "words", F.explode("codes").alias("code"))

    size = F.when(F.col("words") == "", 0).otherwise(F.size("pw"))  # without a common word it does not matter
    group = F.to_json(F.struct("brand_key", "words", "code", size.alias("size")))
    places = keyed(p, commons.drop("brand_key"), "location_id", "pp", "plat", "plon", "pw").withColumn("group", group)
    places = cut_lineage(places.select("location_id", "brand_key", "words", "code", "group", "plat", "plon"))
    groups = places.groupBy("brand_key", "words", "code", "group").agg(F.min("location_id").alias("lowest"))
    shared = asked.filter("common").groupBy("candidate_id").agg(F.array_sort(F.collect_set("word")).alias("all"))
    few = shared.select("candidate_id", F.explode(F.slice("all", 1, SUBSET_WORDS)).alias("word")).groupBy("candidate_id").agg(F.array_sort(F.collect_list("word")).alias("commons"))
    over = shared.filter(F.size("all") > SUBSET_WORDS).select("candidate_id", F.explode("all").alias("word")).join(c.select("candidate_id", "brand_key"), "candidate_id")
    by_word = by_word.unionByName(over.join(held.filter("common"), ["brand_key", "word"]).select("candidate_id", "location_id"))
    points = keyed(c, few, "candidate_id", "cp", "clat", "clon").join(groups, ["brand_key", "words", "code"])
    placed = points.select(F.col("candidate_id").alias("point_id"), "group", F.col("clat").alias("lat"), F.col("clon").alias("lon"))
    near = nearest(placed, places.select(F.col("location_id").alias("place_id"), "group", F.col("plat").alias("lat"), F.col("plon").alias("lon")))
    by_class = near.select(F.col("point_id").alias("candidate_id"), F.col("place_id").alias("location_id")).unionByName(
        points.filter("clat IS NULL OR clon IS NULL").select("candidate_id", F.col("lowest").alias("location_id")))
    pairs = by_word.unionByName(by_class).distinct()
    rows = pairs.join(c.select("candidate_id", "cw", "cp", "clat", "clon"), "candidate_id").join(p.drop("brand_key"), "location_id")
    distance = haversine_m("clat", "clon", "plat", "plon")
    rows = rows.withColumns({"distance": distance, "similarity": shared_part("cw", "pw"),
                             "same_postal": (F.col("cp") != "") & (F.col("cp") == F.col("pp"))})
    near = F.when(F.col("distance").isNull(), 0.0).otherwise(1 - F.least("distance", F.lit(FAR_M)) / FAR_M)
    rows = rows.withColumn("score", F.col("similarity") * W_NAME + F.when(F.col("same_postal"), W_POSTAL).otherwise(0.0) + near * W_DISTANCE)
    best = best_by(
        rows, ["candidate_id"], [-F.round("score", 9), F.coalesce("distance", F.lit(1e6)), F.col("location_id")],
        ["location_id", F.round("distance", 2).alias("distance_meters"), F.round("similarity", 4).alias("name_similarity"), "same_postal", F.round("score", 5).alias("score")])
    strong = (F.col("distance_meters") <= STRONG_M) & (
        (F.col("name_similarity") > 0) | (F.col("same_postal") & (F.col("distance_meters") <= SAME_POSTAL_M)))
    status = (
        F.when(F.col("brand_key").isNull(), "unmatched")
        .when((F.col("brand_status") == "matched") & F.coalesce(strong, F.lit(False)), "matched").otherwise("review_required"))
    nearby = F.coalesce(F.col("distance_meters") <= REVIEW_M, F.lit(False))
    return candidates.select("candidate_id", "brand_key", "brand_status").join(best, "candidate_id", "left").withColumns({
        "status": status, "nearby": nearby})


def host_seeds(records: DataFrame, max_urls: int | None = None) -> DataFrame:
    """Seed URLs, record count and classes per website host; a shared portal host stays one small row.

    Sets are reduced before they are collected: classes are few, distinct URLs are cut to the first ``max_urls``, if given.
    """
    rows = records.withColumn("host", site_host("website_url")).filter("host IS NOT NULL")
    first = rows.select("host", "website_url").distinct()
    if max_urls is not None:
        first = first.withColumn("n", F.row_number().over(_by("host", "website_url"))).filter(F.col("n") <= max_urls)
    urls = first.groupBy("host").agg(F.array_sort(F.collect_list("website_url")).alias("seed_urls"))
    per = rows.groupBy("host").agg(F.count_distinct("external_record_id").alias("records"), F.array_sort(F.collect_set("classification")).alias("classifications"))
    return per.join(urls, "host")


def host_seed_rows(records: DataFrame) -> DataFrame:
    """One row per website host and URL, with the host's record count and classes; nothing of a shared portal host is cut or gathered."""
    rows = records.withColumn("host", site_host("website_url")).filter("host IS NOT NULL")
    per = rows.groupBy("host").agg(F.count_distinct("external_record_id").alias("records"), F.array_sort(F.collect_set("classification")).alias("classifications"))
    return rows.select("host", F.col("website_url").alias("seed_url")).distinct().join(per, "host")


def _by(key: str, order: str):
    from pyspark.sql import Window
    return Window.partitionBy(key).orderBy(order)


def website_identities(sites: DataFrame, excluded_hosts: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(website identities of direct sites, slugs claimed by several hosts)."""
    rows = sites.filter("classification = 'direct_clinical' AND lat IS NOT NULL").withColumn("host", site_host("website_url")).filter("host IS NOT NULL")
    rows = rows.join(excluded_hosts.select("host"), "host", "left_anti")
    per = rows.groupBy("host").agg(F.min_by("name", "external_record_id").alias("name"), F.count(F.lit(1)).alias("sites"))
    named = per.join(overrides.select("host", "brand_name"), "host", "left").withColumn("name", F.coalesce("brand_name", "name")).drop("brand_name")
    slugged = named.withColumn("slug", F.regexp_replace(F.trim(norm_text("name")), " ", "-"))
    clashes = slugged.groupBy("slug").agg(F.count(F.lit(1)).alias("hosts")).filter("hosts > 1")
    return slugged.join(clashes, "slug", "left_anti"), clashes


def source_inventory(sites: DataFrame, groups: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(sites with and without website per priority group, top hosts)."""
    rows = sites.withColumn("host", site_host("website_url")).join(groups.select("classification", "priority_group"), "classification", "left").fillna({"priority_group": "other"})
    per = rows.groupBy("priority_group").agg(
        F.count(F.lit(1)).alias("sites"), F.count("host").alias("with_website"), F.count_if(F.col("host").isNull()).alias("without_website"))
    hosts = rows.filter("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("sites")).orderBy(F.desc("sites"), "host").limit(top)
    return per, hosts


def provider_portfolio(mapping: DataFrame, discovery: DataFrame, census: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals per provider, references that do not exist).

    ``mapping``: provider_key, host, census_ids ARRAY. A missing host or id is an error, never dropped.
    """
    ids = mapping.select("provider_key", F.explode("census_ids").alias("external_record_id"))
    found = ids.join(census.select("external_record_id", "classification").distinct(), "external_record_id", "left")
    sites = found.groupBy("provider_key").agg(F.count("classification").alias("census_sites"), F.count_if(F.col("classification") == "direct_clinical").alias("direct_sites"))
    hosted = mapping.select("provider_key", "host").join(discovery.select("host", "offers", "priced_offers"), "host", "left")
    errors = found.filter("classification IS NULL").select("provider_key", F.lit("census_id").alias("kind"), F.col("external_record_id").alias("reference")).unionByName(
        hosted.filter("offers IS NULL").select("provider_key", F.lit("host").alias("kind"), F.col("host").alias("reference")))
    return hosted.join(sites, "provider_key", "left").fillna(0), errors


def golden_catalog(anchor: DataFrame, records: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapped records, queue): reviewed pairs first, then a unique exact normalized title of the anchor.

    ``anchor``: item_id, name. ``records``: source_key, external_record_id, title. ``reviewed``:
    source_key, external_record_id, item_id.
    """
    titles = anchor.select("item_id", norm_text("name").alias("nt")).groupBy("nt").agg(
        F.min("item_id").alias("exact_item"), F.count_distinct("item_id").alias("n")).filter("n = 1").drop("n")
    rows = records.withColumn("nt", norm_text("title")).join(reviewed.select("source_key", "external_record_id", F.col("item_id").alias("reviewed_item")), ["source_key", "external_record_id"], "left").join(titles, "nt", "left")
    mapped = rows.withColumn("item_id", F.coalesce("reviewed_item", "exact_item")).withColumn(
        "method", F.when(F.col("reviewed_item").isNotNull(), "reviewed").when(F.col("exact_item").isNotNull(), "exact"))
    return (mapped.filter("item_id IS NOT NULL").select("source_key", "external_record_id", "item_id", "method"),
            mapped.filter("item_id IS NULL").select("source_key", "external_record_id", F.col("nt").alias("normalized_title")))


def discovery_summary(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts per record type and status per host; a succeeded run without valid records is ``empty``."""
    kinds = records.groupBy("host").agg(
        F.count_if(F.col("record_type") == "provider_location_discovered").alias("locations"),
        F.count_if(F.col("record_type") == "provider_offer_discovered").alias("service_only_offers"),
        F.count_if(F.col("record_type") == "provider_offer_price").alias("priced_offers"))
    status = F.when((F.col("status") == "succeeded") & (F.col("records_valid") == 0), "empty").otherwise(F.col("status"))
    return runs.join(kinds, "host", "left").fillna(0, ["locations", "service_only_offers", "priced_offers"]).withColumns({
        "status": status, "offers": F.col("service_only_offers") + F.col("priced_offers")})


def identity_review_check(reviewed: DataFrame, census: DataFrame) -> DataFrame:
    """(external_record_id, problem) of reviewed links: repeated, missing, wrong class or other website host."""
    repeated = reviewed.groupBy("external_record_id").agg(F.count(F.lit(1)).alias("n"))
    rows = reviewed.join(census.select("external_record_id", "classification", F.col("website_url").alias("census_url")), "external_record_id", "left").join(repeated, "external_record_id")
    problems = F.array_compact(F.array(
        F.when(F.col("n") > 1, "repeated"), F.when(F.col("classification").isNull(), "missing"),
        F.when(F.col("classification") == "non_clinical", "wrong_class"),
        F.when(F.col("classification").isNotNull() & ~site_host("website_url").eqNullSafe(site_host("census_url")), "other_host")))
    return rows.select("external_record_id", F.explode(problems).alias("problem"))


# Transient failures worth another attempt, and permanent ones.
RETRYABLE = "(?i)timed out|timeout|temporar|connection reset|connection refused|\\b408\\b|\\b425\\b|\\b429\\b|\\b5\\d\\d\\b"
PERMANENT = "(?i)robots\\.txt|private, loopback|unresolved|\\b404\\b|\\b410\\b|\\b401\\b|\\b403\\b"


def retry_seeds(runs: DataFrame, max_providers: int | None = None) -> DataFrame:
    """Hosts worth another attempt: empty, or failed with a transient and no permanent error."""
    transient = (F.col("status") == "failed") & F.col("errors").rlike(RETRYABLE) & ~F.col("errors").rlike(PERMANENT)
    hosts = runs.filter((F.col("status") == "empty") | transient)
    return hosts if max_providers is None else hosts.orderBy("host").limit(max_providers)
