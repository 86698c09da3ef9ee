"""Offers, price resolution, expansion to branches, links, search and publication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import haversine_m
from ..functions.text import display_address, norm_text, stable_id
from ..session import by_shuffle, written
from .resolve import clamp
from .spatial import nearest

# Scope precedence and the price contract of captured price objects.
SPECIFICITY = {"location": 3, "market": 2, "brand": 1}
PRICE_TYPES = {
    "regular": ("regular", "default"), "online": ("online", "default"), "promotion": ("promo", "default"),
    "blue_card": ("member", "blue_card"), "gold_card": ("member", "gold_card"), "prepaid": ("other", "prepaid"),
}
STALE_DAYS = 30


def specificity() -> Column:
    return F.when(F.col("scope_type") == "location", 3).when(F.col("scope_type") == "market", 2).otherwise(1)


def current_prices(prices: DataFrame, as_of) -> DataFrame:
    """Current versions whose half-open validity holds at ``as_of`` (a Column or a timestamp)."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return prices.filter(
        F.col("is_current") & (F.col("valid_from").isNull() | (at >= F.col("valid_from")))
        & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def best_by(df: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """One row per key: the minimum of (order..., payload); a plain aggregate, combined map-side."""
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*payload).alias("p"))
    return df.groupBy(*keys).agg(F.min(packed)["p"].alias("p")).select(*keys, "p.*")


def nulls_last(column: str) -> list[Column]:
    return [F.col(column).isNull(), F.col(column)]


def by_scope(asks: DataFrame, scoped: DataFrame, market_locations: DataFrame) -> DataFrame:
    """Asks (offer_id, location_id, ...) with every scope row of their offer; ``reached`` where it holds for the location.

    Asks travel once to their location's markets and once to their offer's scopes, whatever the kind of scope;
    rows stay dealt by offer_id, so groups that include it need no further shuffle. An ask is kept if
    nothing reaches it, and one without a location is reached by brand scopes only. Rows of an ask follow the scopes
    of one offer.
    """
    markets = market_locations.groupBy("location_id").agg(F.collect_set("market_id").alias("markets"))
    held = scoped.withColumnsRenamed({"location_id": "scope_location", "market_id": "scope_market"})
    kind = F.col("scope_type")
    reached = (
        (kind == "brand") | ((kind == "market") & F.array_contains("markets", F.col("scope_market")))
        | ((kind == "location") & (F.col("scope_location") == F.col("location_id"))))
    return (
        asks.join(by_shuffle(markets), "location_id", "left").join(by_shuffle(held), "offer_id", "left")
        .withColumn("reached", F.coalesce(reached, F.lit(False))).drop("markets", "scope_market", "scope_location"))


def resolve_prices(asks: DataFrame, offers: DataFrame, scopes: DataFrame, prices: DataFrame, locations: DataFrame,
                   market_locations: DataFrame) -> DataFrame:
    """Best eligible price per (ask, price_type, channel, price_key).

    ``asks``: ask_id, offer_id, location_id, at (UTC). The location must belong to the offer's
    brand; weekday and time windows are judged in its time zone, windows may cross midnight.
    """
    place = locations.select("location_id", "provider_id", "timezone")
    own = asks.join(by_shuffle(place), "location_id")
    local = F.convert_timezone(F.lit("UTC"), F.col("timezone"), F.col("at"))
    own = own.select(
        "ask_id", "offer_id", "provider_id", "location_id", "at", F.date_format(local, "HH:mm:ss").alias("local_time"),
        (F.weekday(local) + 1).alias("local_dow"))
    owners = offers.groupBy("offer_id").agg(F.collect_set("provider_id").alias("owners"))
    priced = scopes.filter("status = 'active'").select("scope_id", "offer_id", "scope_type", "market_id", "location_id").join(
        by_shuffle(prices.filter("is_current")), "scope_id").join(by_shuffle(owners), "offer_id")
    reached = by_scope(own, priced, market_locations).filter(F.col("reached") & F.array_contains("owners", F.col("provider_id")))
    rows = current_prices(reached, F.col("at"))
    start, end, now = F.col("day_time_from"), F.col("day_time_to"), F.col("local_time")
    in_window = (
        start.isNull() | end.isNull()
        | ((start <= end) & (now >= start) & (now < end))
        | ((start > end) & ((now >= start) | (now < end))))
    rows = rows.filter((F.col("weekdays").isNull() | F.array_contains("weekdays", F.col("local_dow"))) & in_window)
    rows = rows.withColumn("specificity", specificity())
    newest_first = F.struct("specificity", "valid_from", "created_at", "price_id")
    payload = ["price_id", "scope_id", "amount_minor", "currency", "scope_type", "specificity", "valid_from", "valid_to", "last_seen_at"]
    return (
        rows.groupBy("ask_id", "offer_id", "location_id", "price_type", "channel", "price_key")
        .agg(F.max_by(F.struct(*payload), newest_first).alias("p"))
        .select("ask_id", "offer_id", "location_id", "price_type", "channel", "price_key", "p.*"))


def best_price(resolved: DataFrame) -> DataFrame:
    """One price per ask: most specific scope, regular first, cheapest, then key."""
    order = [-F.col("specificity"), (F.col("price_type") != "regular"), F.col("amount_minor"), F.col("price_key")]
    return best_by(resolved, ["ask_id"], order, ["price_type", "price_key", "amount_minor", "currency", "last_seen_at"])


# --- expansion ----------------------------------------------------------------------------------

def best_link(links: DataFrame, target: str) -> DataFrame:
    """scope_id -> url of the newest verified active link of a target."""
    rows = links.filter((F.col("status") == "active") & (F.col("link_target") == target))
    newest = F.struct("verified_at", "created_at", "url")
    return rows.groupBy("scope_id").agg(F.max_by("url", newest).alias("source_url"))


def expand_offers(offers: DataFrame, scopes: DataFrame, locations: DataFrame, market_locations: DataFrame, *,
                  brand_to_branches: bool = False) -> DataFrame:
    """(offer, scope) rows with the concrete branch each reaches; brand scopes stay broad unless asked.

    A market belongs to one brand: ``market_locations`` (market_id, provider_id, location_id) reaches
    only branches of the offer's own brand.
    """
    rows = offers.filter("status = 'active'").select("offer_id", "provider_id", "item_id", "requires_quote").join(
        scopes.filter("status = 'active'").select("scope_id", "offer_id", "scope_type", "market_id", F.col("location_id").alias("scope_location")),
        "offer_id").withColumn("specificity", specificity())
    columns = ["offer_id", "provider_id", "item_id", "requires_quote", "scope_id", "scope_type", "specificity", "location_id"]
    return _reached(rows, locations, market_locations, brand_to_branches, columns)


def _reached(rows: DataFrame, locations: DataFrame, market_locations: DataFrame, brand_to_branches: bool, columns: list[str]) -> DataFrame:
    """The rows (provider_id, scope_type, market_id, scope_location) with each branch that they reach."""
    at = rows.filter("scope_type = 'location'").withColumn("location_id", F.col("scope_location")).join(
        by_shuffle(locations.select("location_id", "provider_id")), ["location_id", "provider_id"], "left_semi")
    wide = rows.filter("scope_type = 'market'").join(
        by_shuffle(market_locations.select("market_id", "provider_id", "location_id").distinct()), ["market_id", "provider_id"])
    broad = rows.filter("scope_type = 'brand'")
    if brand_to_branches:
        broad = broad.join(by_shuffle(locations.select("location_id", "provider_id")), "provider_id")
    else:
        broad = broad.withColumn("location_id", F.lit(None).cast("string"))
    return at.select(*columns).unionByName(wide.select(*columns)).unionByName(broad.select(*columns))


def prefer_concrete(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Drop rows without a branch when their offer has an active location scope."""
    concrete = scopes.filter("scope_type = 'location' AND status = 'active'").select("offer_id").distinct()
    return rows.filter("location_id IS NOT NULL").unionByName(
        rows.filter("location_id IS NULL").join(concrete, "offer_id", "left_anti"))


def item_offer_rows(brands, offers, scopes, prices, locations, market_locations, links, *, as_of) -> DataFrame:
    """Search rows per item: offer, every branch it reaches, current scope price and details link."""
    rows = prefer_concrete(expand_offers(offers, scopes, locations, market_locations), scopes)
    now = current_prices(prices, as_of).select("scope_id", "price_type", "price_key", "amount_minor", "currency", "last_seen_at")
    active = brands.filter("status = 'active'").select("provider_id", "provider_name")
    places = locations.select("location_id", "location_name", "lat", "lon")
    return (
        rows.join(active, "provider_id").join(now, "scope_id", "left").join(best_link(links, "study"), "scope_id", "left")
        .join(by_shuffle(places), "location_id", "left"))


def offer_search(results: DataFrame, names: DataFrame, item_rows: DataFrame, limit: int = 20) -> DataFrame:
    """Offers per query with provider diversity: the first row of each (item, brand) comes first.

    Without a caller position the order inside an item does not depend on the query, so each item is
    cut to its own top rows before it meets the queries; the cut is exact for the final top-k.
    """
    k = clamp(limit, 20)
    tie = [*nulls_last("amount_minor"), F.col("offer_id"), *nulls_last("location_id"), F.col("price_type"), F.col("price_key"), F.col("scope_id")]
    within = W.partitionBy("item_id", "provider_id").orderBy(*tie)
    rows = item_rows.withColumn("provider_rank", F.row_number().over(within)).filter(F.col("provider_rank") <= k)
    bucket = F.when(F.col("provider_rank") == 1, 0).otherwise(1)
    order = [F.col("bucket"), F.col("provider_name"), F.col("provider_rank")]
    top = rows.withColumn("bucket", bucket).withColumn(
        "item_rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).filter(F.col("item_rank") <= k)
    hits = results.select("query_id", "item_id", "display_name", "confidence")
    final = W.partitionBy("query_id").orderBy(
        "bucket", F.desc("confidence"), "provider_name", "display_name", "item_id", "provider_rank")
    return (
        hits.join(by_shuffle(top), "item_id").withColumn("offer_rank", F.row_number().over(final)).filter(F.col("offer_rank") <= k)
        .select("query_id", "offer_rank", "item_id", "display_name", "confidence", "offer_id", "provider_id", "provider_name",
                "location_id", "source_url", "price_type", "price_key", "amount_minor"))


def offer_search_near(results: DataFrame, positions: DataFrame, item_rows: DataFrame, limit: int = 20) -> DataFrame:
    """As ``offer_search`` with a caller position (query_id, lat, lon): nearest rows first.

    Branches are ranked once per distinct (item, position), not once per query. Of an item that ``limit`` brands or
    more offer at a place, the nearest row of each brand comes first, so a position meets only the places no farther
    than ``limit`` brands surely have one (and those within rounding of the last). Of other items it meets the nearest
    ``limit`` branches of each brand, and as many rows without a position, which are cut per item and brand beforehand.
    ``item_rows`` is read several times; a caller may write it first.
    """
    k = clamp(limit, 20)
    points = positions.select("query_id", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    hits = results.select("query_id", "item_id", "display_name", "confidence").join(by_shuffle(points), "query_id")
    spots = hits.select("item_id", "qlat", "qlon").distinct()
    here = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("location_id").isNotNull()
    sites = item_rows.filter(here).groupBy("item_id", "provider_id", "location_id", "lat", "lon").agg(F.lit(1).alias("one")).drop("one")
    wide = written(sites.groupBy("item_id").agg(F.count_distinct("provider_id").alias("brands")).filter(F.col("brands") >= k).select("item_id"))
    asked = spots.join(wide, "item_id").withColumn("point_id", F.struct("qlat", "qlon"))
    first = F.row_number().over(W.partitionBy("item_id", "provider_id").orderBy("location_id", "lat", "lon")) == 1
    counted = sites.join(wide, "item_id", "left_semi").withColumn("weight", first.cast("int")).groupBy(
        F.col("location_id").alias("place_id"), F.col("item_id").alias("group"), "lat", "lon").agg(F.sum("weight").alias("weight"))
    close = nearest(asked.select("point_id", F.col("item_id").alias("group"), F.col("qlat").alias("lat"), F.col("qlon").alias("lon")), counted, k, slack_m=0.002)
    wide_rows = close.select("point_id.qlat", "point_id.qlon", F.col("group").alias("item_id"), F.col("place_id").alias("location_id")).join(
        item_rows.filter(here), ["item_id", "location_id"])
    narrow = _near_rows_by_brand(spots.join(wide, "item_id", "left_anti"), item_rows.join(wide, "item_id", "left_anti"), here, k)
    rows = wide_rows.unionByName(narrow).withColumn("distance_meters", F.round(haversine_m("lat", "lon", "qlat", "qlon"), 3))
    spot = ["item_id", "qlat", "qlon"]
    tie = [*nulls_last("distance_meters"), *nulls_last("amount_minor"), F.col("provider_name"), F.col("offer_id"), F.col("scope_id"),
           F.col("location_id"), F.col("price_type"), F.col("price_key")]
    rows = rows.withColumn("provider_rank", F.row_number().over(W.partitionBy(*spot, "provider_id").orderBy(*tie))).filter(
        F.col("provider_rank") <= k)
    near = [F.when(F.col("provider_rank") == 1, 0).otherwise(1), *nulls_last("distance_meters"), F.col("provider_name"), F.col("provider_rank")]
    top = rows.withColumn("spot_rank", F.row_number().over(W.partitionBy(*spot).orderBy(*near))).filter(F.col("spot_rank") <= k)
    final = W.partitionBy("query_id").orderBy(
        near[0], F.desc("confidence"), *near[1:4], "display_name", "item_id", "provider_rank")
    url = [c for c in ("source_url",) if c in item_rows.columns]
    return (
        hits.join(by_shuffle(top), spot).withColumn("offer_rank", F.row_number().over(final)).filter(F.col("offer_rank") <= k)
        .select("query_id", "offer_rank", "item_id", "display_name", "confidence", "offer_id", "provider_id", "provider_name",
                "location_id", "distance_meters", *url, "price_type", "price_key", "amount_minor"))


def _near_rows_by_brand(spots: DataFrame, item_rows: DataFrame, here: Column, k: int) -> DataFrame:
    """For each (item, position) the rows of each brand's k nearest branches, and its k first rows without a position."""
    placed = item_rows.withColumn("group", F.to_json(F.struct("item_id", "provider_id")))
    asked = spots.join(placed.select("item_id", "group").distinct(), "item_id").withColumn("point_id", F.struct("qlat", "qlon"))
    close = nearest(asked.select("point_id", "group", F.col("qlat").alias("lat"), F.col("qlon").alias("lon")),
                    placed.filter(here).select(F.col("location_id").alias("place_id"), "group", "lat", "lon").distinct(), k, slack_m=0.002)
    near_rows = close.select("point_id.qlat", "point_id.qlon", "group", F.col("place_id").alias("location_id")).join(
        placed.filter(here), ["group", "location_id"])
    cheapest = W.partitionBy("group").orderBy(*nulls_last("amount_minor"), "provider_name", "offer_id", "scope_id", "location_id", "price_type", "price_key")
    unplaced = placed.filter(~here).withColumn("cheap_rank", F.row_number().over(cheapest)).filter(F.col("cheap_rank") <= k).drop("cheap_rank")
    return near_rows.unionByName(asked.select("group", "qlat", "qlon").join(unplaced, "group")).drop("group")


def resolve_search(queries: DataFrame, results: DataFrame, status: DataFrame, found: DataFrame) -> DataFrame:
    """Nested answer per query: ordered candidates and their ordered, de-duplicated offers.

    Both arrays are bounded by the limits of the tables they come from.
    """
    once = best_by(
        found, ["query_id", "item_id", "offer_id", "location_id", "price_type", "price_key"], [F.col("offer_rank")],
        ["offer_rank", "provider_name", "amount_minor", "source_url"])
    candidates = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "result_rank", "item_id", "display_name", "confidence", "resolution_status", "match_method"))).alias("candidates"))
    offers = once.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "offer_rank", "item_id", "offer_id", "provider_name", "location_id", "price_type", "price_key", "amount_minor", "source_url"))).alias("offers"))
    return (
        queries.select("query_id", "query_text").join(by_shuffle(status.select("query_id", "status")), "query_id", "left")
        .join(by_shuffle(candidates), "query_id", "left").join(by_shuffle(offers), "query_id", "left"))


# --- links, details, lookups --------------------------------------------------------------------

def offer_links(asks: DataFrame, scopes: DataFrame, links: DataFrame, market_locations: DataFrame) -> DataFrame:
    """Best link per target and the capability label for (offer_id, location_id) pairs."""
    pairs = asks.select("offer_id", "location_id").distinct()
    active = links.filter("status = 'active' AND url IS NOT NULL").select("scope_id", "link_id", "link_target", "url", "verified_at", F.col("created_at").alias("linked_at"))
    scope = ["scope_id", "offer_id", "scope_type", "market_id", "location_id"]
    newest = F.struct("verified_at", "linked_at", "link_id", "url")
    targets = ("study", "booking", "location")
    linked = scopes.filter("status = 'active'").select(*scope).join(active, "scope_id").groupBy(*scope).agg(  # a scope's own best before offers meet
        *[F.max(F.when(F.col("link_target") == t, newest)).alias(t) for t in targets], F.bool_or(F.col("link_target") == "provider").alias("provider"))
    reached = by_scope(pairs, linked.drop("scope_id"), market_locations)

    def best(target: str) -> Column:
        return F.max(F.when(F.col("reached") & F.col(target).isNotNull(), F.struct(specificity().alias("specificity"), target)))[target]["url"]

    wide = reached.groupBy("offer_id", "location_id").agg(
        F.greatest(best("study"), best("booking")).alias("study_url"), best("location").alias("location_url"), best("booking").alias("booking_url"),
        F.bool_or(F.col("reached") & F.col("provider")).alias("has_provider"))
    study, place = F.col("study_url").isNotNull(), F.col("location_url").isNotNull()
    label = (
        F.when(study & place, "study_and_location").when(study, "study_only").when(place, "location_only")
        .when(F.coalesce("has_provider", F.lit(False)), "provider_only").otherwise("none"))
    return wide.withColumn("link_capability", label).drop("has_provider")


def service_detail(items, names, aliases, attributes, offers) -> DataFrame:
    """Nested detail per active item: names, approved aliases, attributes and offer counts."""
    def listed(df, key, *cols):
        return df.groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct(*cols))).alias(key))
    counts = offers.filter("status = 'active'").groupBy("item_id").agg(
        F.count(F.lit(1)).alias("offer_count"), F.count_distinct("provider_id").alias("provider_count"))
    return (
        items.filter("status = 'active'").select("item_id")
        .join(listed(names, "names", "name", "locale"), "item_id", "left")
        .join(listed(aliases.filter("status = 'approved'"), "aliases", "alias", "provider_id"), "item_id", "left")
        .join(listed(attributes, "attributes", "attribute_type", "attribute_value"), "item_id", "left")
        .join(counts, "item_id", "left").fillna({"offer_count": 0, "provider_count": 0}))


def provider_detail(brands: DataFrame, locations: DataFrame, offers: DataFrame) -> DataFrame:
    """Counts per brand over its branches and active offers."""
    places = locations.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("location_count"), F.count_if(F.col("status") == "active").alias("active_location_count"))
    supply = offers.filter("status = 'active'").groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("offer_count"), F.count_distinct("item_id").alias("service_count"))
    return brands.join(places, "provider_id", "left").join(supply, "provider_id", "left").fillna(0)


def service_summaries(requests: DataFrame, items: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Descriptions in the order of each request's id list, however long."""
    asked = requests.select("request_id", F.posexplode("item_ids").alias("position", "item_id"))
    return (
        asked.join(items.filter("status = 'active'").select("item_id"), "item_id", "left_semi")
        .join(descriptions.filter("status = 'approved'").select("item_id", "description"), "item_id")
        .select("request_id", (F.col("position") + 1).alias("position"), "item_id", "description"))


def branch_addresses(locations: DataFrame, offers: DataFrame, scopes: DataFrame, market_locations: DataFrame) -> DataFrame:
    """Display address of every active branch an active offer reaches.

    Which branches are reached depends on brand and scope alone, so offers that share both meet them once.
    """
    scoped = scopes.filter("status = 'active'").select("offer_id", "scope_type", "market_id", F.col("location_id").alias("scope_location"))
    kinds = offers.filter("status = 'active'").select("offer_id", "provider_id").join(scoped, "offer_id").select(
        "provider_id", "scope_type", "market_id", "scope_location").distinct()
    reached = _reached(kinds, locations, market_locations, True, ["location_id"])
    return locations.filter("status = 'active'").join(reached, "location_id", "left_semi").select(
        "location_id", display_address("line1", "line2", "locality", "postal_code").alias("address")).filter("address IS NOT NULL")


def offers_by_provider(offers: DataFrame, scopes: DataFrame, brands: DataFrame) -> DataFrame:
    """Per brand: offers, services, branches with an own scope, and offers without one."""
    active = offers.filter("status = 'active'")
    own = scopes.filter("scope_type = 'location' AND status = 'active'").select("offer_id", "location_id")
    joined = active.join(own, "offer_id", "left")
    per = joined.groupBy("provider_id").agg(
        F.count_distinct("offer_id").alias("offer_count"), F.count_distinct("item_id").alias("service_count"),
        F.count_distinct("location_id").alias("branch_count"), F.count_if(F.col("location_id").isNull()).alias("unscoped_offers"))
    return brands.select("provider_id", "provider_name").join(per, "provider_id")


# --- price history ------------------------------------------------------------------------------

def price_versions(observations: DataFrame, series: list[str], chunk: str = "month") -> DataFrame:
    """History of price observations (series..., amount_minor, observed_at) as validity intervals.

    Unchanged observations only extend ``last_seen_at``. A series is cut into time chunks that are
    collapsed on their own tasks, and only the collapsed runs meet again per series, so one hot
    series never sits in a single task with all its observations.
    """
    daily = observations.groupBy(*series, F.col("observed_at").alias("at")).agg(F.min("amount_minor").alias("amount_minor"))
    cut = daily.withColumns({"chunk": F.date_trunc(chunk, "at"), "last_seen_at": F.col("at")})
    merged = _runs(_runs(cut, [*series, "chunk"]).drop("chunk", "valid_from"), series)
    order = W.partitionBy(*series).orderBy("at")
    versions = merged.withColumns({"version": F.row_number().over(order), "valid_to": F.lead("valid_from").over(order)})
    return versions.withColumn("is_current", F.col("valid_to").isNull()).select(
        *series, "amount_minor", "valid_from", "last_seen_at", "version", "valid_to", "is_current")


def _runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive rows (keys, at, last_seen_at) of equal amount as one row, at its first ``at``; in one sort, without a table of groups."""
    order = W.partitionBy(*keys).orderBy("at")
    amount = F.col("amount_minor")
    marked = df.withColumns({
        "starts": (F.row_number().over(order) == 1) | ~F.lag(amount).over(order).eqNullSafe(amount),
        "valid_from": F.when(F.col("at").isNull() & F.lead(amount).over(order).eqNullSafe(amount), F.lead("at").over(order)).otherwise(F.col("at")),  # the first that is known
        "seen_before": F.lag("last_seen_at").over(order),
        "seen_last": F.last("last_seen_at").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    ended = F.when(F.lead(F.lit(True)).over(order), F.lead("seen_before").over(order)).otherwise(F.col("seen_last"))
    return marked.filter("starts").withColumn("last_seen_at", ended).drop("starts", "seen_before", "seen_last")


def apply_price_batch(current: DataFrame, batch: DataFrame, series: list[str]) -> DataFrame:
    """Next current/history state after one batch with at most one observation per series.

    Equal amounts touch ``last_seen_at``; others close the version and open a new one.
    """
    fresh = batch.select(*series, F.col("amount_minor").alias("new_amount"), F.col("observed_at"))
    open_rows = current.filter("is_current").join(fresh, series, "left")
    same = F.col("new_amount").isNull() | (F.col("new_amount") == F.col("amount_minor"))
    kept = open_rows.select(
        *series, "amount_minor", "valid_from",
        F.when(~same, F.col("observed_at")).alias("valid_to"),
        F.when(same, F.greatest("last_seen_at", F.coalesce("observed_at", "last_seen_at"))).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        same.alias("is_current"))
    known = current.filter("is_current").select(*series, F.col("amount_minor").alias("old_amount"))
    opened = fresh.join(known, series, "left").filter("old_amount IS NULL OR old_amount <> new_amount").select(
        *series, F.col("new_amount").alias("amount_minor"), F.col("observed_at").alias("valid_from"),
        F.lit(None).cast(current.schema["valid_to"].dataType).alias("valid_to"), F.col("observed_at").alias("last_seen_at"), F.lit(True).alias("is_current"))
    history = current.filter("NOT is_current").select(*opened.columns)
    return history.unionByName(kept).unionByName(opened)


def price_rows(records: DataFrame, prices: str = "prices") -> tuple[DataFrame, DataFrame]:
    """(typed price rows, refused rows) of a MAP<STRING, DOUBLE> column keyed by record_key.

    Unknown keys are ignored, amounts of zero or less are sentinels, fractions are refused.
    """
    contract = F.create_map(*[
        x for key, (kind, name) in PRICE_TYPES.items()
        for x in (F.lit(key), F.struct(F.lit(kind).alias("price_type"), F.lit(name).alias("price_key")))])
    rows = records.select("record_key", F.explode(prices).alias("source_type", "value")).withColumn(
        "t", F.try_element_at(contract, F.col("source_type"))).filter("t IS NOT NULL")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf")))
    whole = finite & (F.col("value") == F.floor("value"))
    good = rows.filter(whole & (F.col("value") > 0)).select(
        "record_key", "t.price_type", "t.price_key", F.col("value").cast("bigint").alias("amount_minor"))
    bad = rows.filter(~finite | (~whole & (F.col("value").cast("bigint") > 0))).select("record_key", "source_type")
    return good, bad


def publish_offers(mappings: DataFrame, records: DataFrame, held: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> dict[str, DataFrame]:
    """Offers, scopes and rejects from reviewed mappings and captured records.

    ``mappings``: source_key, external_record_id, provider_key, item_id, provider_alias,
    observed_label, expected_hash, branch_priced. ``records``: source_key, external_record_id,
    record_hash, display_name, provider_sku, location_external_id. A changed label, a changed hash
    or a missing record rejects; branch-priced sources share one offer with one scope per branch.
    ``held`` may write the accepted rows once for callers that read both offers and scopes.
    """
    captured = records.select("source_key", "external_record_id", "record_hash", F.trim("display_name").alias("observed"), "provider_sku", "location_external_id")
    rows = mappings.join(captured, ["source_key", "external_record_id"], "left")
    expected = F.nullif(F.trim("observed_label"), F.lit(""))
    label_ok = F.when(expected.isNotNull(), F.col("observed") == expected).otherwise(
        (F.col("observed") != "") & (norm_text("observed") == norm_text("provider_alias")))
    reasons = F.array_compact(F.array(
        F.when(F.col("record_hash").isNull(), "record_missing"),
        F.when(F.col("record_hash").isNotNull() & ~F.coalesce(label_ok, F.lit(False)), "label_changed"),
        F.when(F.col("record_hash") != F.col("expected_hash"), "hash_mismatch")))
    judged = rows.withColumn("reasons", reasons)
    at_branch = F.col("branch_priced") & (F.coalesce(F.trim("location_external_id"), F.lit("")) != "")
    good = judged.filter(F.size("reasons") == 0).withColumn("at_branch", at_branch).withColumn(
        "offer_id", stable_id(F.lit("offer"), F.col("provider_key"), F.when(F.col("at_branch"), F.concat(F.lit("item "), F.col("item_id"))).otherwise(F.concat(F.lit("record "), F.col("external_record_id")))))
    good = held(good.select("offer_id", "provider_key", "item_id", "observed", "external_record_id", "at_branch", "location_external_id"))
    offers = best_by(good, ["offer_id"], [F.col("external_record_id")], ["provider_key", "item_id", "observed", "external_record_id"])
    scopes = good.select(
        "offer_id", "external_record_id", F.when(F.col("at_branch"), "location").otherwise("market").alias("scope_type"),
        F.when(F.col("at_branch"), F.col("location_external_id")).alias("location_external_id")).distinct()
    return {
        "offers": offers, "scopes": scopes,
        "rejects": judged.filter(F.size("reasons") > 0).select("source_key", "external_record_id", F.explode("reasons").alias("reason")),
    }


def default_brand_scopes(offers: DataFrame) -> DataFrame:
    return offers.select(
        F.concat(F.lit("b"), "offer_id").alias("scope_id"), "offer_id", F.lit("brand").alias("scope_type"),
        F.lit(None).cast("string").alias("market_id"), F.lit(None).cast("string").alias("location_id"), F.lit("active").alias("status"))


def price_drift(current: DataFrame, capture: DataFrame) -> DataFrame:
    """State of every current price against a fresh capture of its source record.

    ``current``: price_id, source_key, external_record_id, amount_minor, channel, currency,
    scope_location, branch_priced. ``capture``: source_key, external_record_id, fresh_amount_minor,
    fresh_location.
    """
    joined = current.join(capture.withColumn("captured", F.lit(True)), ["source_key", "external_record_id"], "left")
    bound = ~F.col("branch_priced") | F.coalesce(F.col("scope_location") == F.col("fresh_location"), F.lit(False))
    state = (
        F.when(F.col("captured").isNull(), "unmatched_source").when(~bound, "location_binding_requires_review")
        .when(F.col("price_id").isNull() | (F.col("channel") != "any") | (F.col("currency") != "MXN"), "contract_not_comparable")
        .when(F.col("fresh_amount_minor").isNull(), "source_price_missing")
        .when(F.col("fresh_amount_minor") == F.col("amount_minor"), "amount_same").otherwise("amount_changed_requires_review"))
    return joined.withColumn("state", state).drop("captured")
