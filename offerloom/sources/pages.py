"""Evidence from landed HTML pages, as expressions over the page table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import PRICE_PATTERN, price_minor
from ..session import cut_lineage
from ..functions.text import c, evaluated, norm_text, stable_id

# Confidence per evidence method; anything else is 0.50.
CONFIDENCE = {
    "jsonld_local_business": 0.95, "jsonld_offer": 0.90, "jsonld_price": 0.88, "embedded_script_pattern": 0.78,
    "price_pattern": 0.68, "jsonld_service": 0.65, "heading_pattern": 0.50,
}
# Structured types that describe a place and those that describe an offer.
LOCATION_TYPES = ["localbusiness", "medicalbusiness", "medicalclinic", "diagnosticlab", "hospital", "pharmacy", "physician"]
OFFER_TYPES = ["product", "service", "medicaltest", "offer"]
# Words that mark a heading as a study, and words that introduce a price.
SERVICE_HINT = (
    "(?iu)\\b(?:biometr[ií]a|citometr[ií]a|hemograma|orina|ego|glucosa|creatinina|tiroid\\w*|tsh|qu[ií]mica|laboratorio|ultrasonido|radiolog[ií]a"
    "|tomograf[ií]a|resonancia|mastograf[ií]a|electrocardiograma|electromiograf[ií]a|an[aá]lisis cl[ií]nico|perfil|albumina|ant[ií]geno|covid|vdrl"
    "|reacciones|electrolitos|deshidrogenasa|lipidos|hep[aá]tico|rx|columna|torax|prueba|insulina)\\b")
PRICE_WORDS = "precio|costo|tarifa|oferta|promocion|desde"
# Named entities decoded in visible text.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def visible_text(html) -> Column:
    """Tags, scripts and styles removed, entities decoded, whitespace collapsed."""
    out = F.regexp_replace(c(html), "(?is)<(script|style|noscript|template)\\b.*?</\\1\\s*>", " ")
    out = F.regexp_replace(out, "(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, letter in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def page_parts(pages: DataFrame) -> DataFrame:
    """Title, headings, links, JSON-LD blocks and visible text per page, each computed once."""
    cleaned = F.regexp_replace("html", "(?is)<(script|style)\\b.*?</\\1\\s*>", " ")
    base = evaluated(pages.select("page_id", "url", "html"), body=cleaned)
    return evaluated(
        base,
        host=F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), "^www\\.", ""),
        title=visible_text(F.regexp_extract("body", "(?is)<title[^>]*>(.*?)</title>", 1)),
        site_name=F.regexp_extract("html", "(?i)<meta[^>]+property=[\"']og:site_name[\"'][^>]+content=[\"']([^\"']*)", 1),
        headings=F.filter(
            F.transform(F.regexp_extract_all("body", F.lit("(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]\\s*>"), F.lit(1)), visible_text), lambda h: h != ""),
        links=F.regexp_extract_all("body", F.lit("(?i)<a\\b[^>]*\\bhref=[\"']([^\"'#]+)"), F.lit(1)),
        jsonld=F.regexp_extract_all("html", F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), F.lit(1)),
        text=visible_text("body"),
        pairs=_script_pairs(),
    ).drop("body", "html")


def page_links(parts: DataFrame) -> DataFrame:
    """Distinct links per page, absolute or relative, and whether they stay on the site."""
    rows = parts.select("page_id", "host", F.explode(F.array_distinct("links")).alias("href"))
    target = F.regexp_replace(F.lower(F.try_parse_url("href", F.lit("HOST"))), "^www\\.", "")
    return rows.select("page_id", "href", (~F.col("href").rlike("(?i)^[a-z]+:") | (target == F.col("host"))).alias("internal"))


def _jsonld_nodes(parts: DataFrame) -> DataFrame:
    """One row per JSON-LD object: top level, array members and @graph members."""
    blocks = parts.select("page_id", "url", F.posexplode("jsonld").alias("block", "json"))
    value = blocks.select("page_id", "url", "block", F.try_parse_json("json").alias("v")).filter("v IS NOT NULL")
    listed = "ARRAY<VARIANT>"
    members = F.coalesce(F.expr(f"try_variant_get(v, '$', '{listed}')"), F.array("v"))
    nodes = value.select("page_id", "url", "block", F.posexplode(members).alias("pos", "node"))
    graph = nodes.select("page_id", "url", "block", (F.col("pos") + 1000).alias("pos"), F.explode(F.expr(f"try_variant_get(node, '$[\"@graph\"]', '{listed}')")).alias("node"))
    return nodes.unionByName(graph)


def _text(path: str, node: str = "node") -> Column:
    return F.nullif(F.trim(F.expr(f"try_variant_get({node}, '{path}', 'string')")), F.lit(""))


def _price_text(node: str) -> Column:
    return F.coalesce(_text("$.price", node), _text("$.lowPrice", node), _text("$.priceSpecification.price", node))


def structured_evidence(parts: DataFrame, hint: str = SERVICE_HINT) -> tuple[DataFrame, DataFrame]:
    """(locations, offers) read from JSON-LD."""
    kinds = F.coalesce(
        F.expr("try_variant_get(node, '$[\"@type\"]', 'ARRAY<STRING>')"), F.array(F.expr("try_variant_get(node, '$[\"@type\"]', 'string')")))
    nodes = _jsonld_nodes(parts).withColumns({
        "kinds": F.transform(kinds, lambda k: F.regexp_replace(F.regexp_replace(F.lower(k), " ", ""), "^.*/", "")),
        "name": F.coalesce(_text("$.name"), _text("$.legalName"), _text("$.alternateName")),
        "node_url": F.coalesce(_text("$.url"), F.col("url"))})
    def is_a(types):
        return F.arrays_overlap("kinds", F.array(*[F.lit(t) for t in types]))
    locations = nodes.filter(is_a(LOCATION_TYPES) & F.col("name").isNotNull()).select(
        "page_id", "url", "name", F.coalesce(_text("$.address.streetAddress"), _text("$.address")).alias("street"),
        _text("$.address.postalCode").alias("postal_code"), _text("$.geo.latitude").try_cast("double").alias("lat"),
        _text("$.geo.longitude").try_cast("double").alias("lon"), F.lit("jsonld_local_business").alias("method"))
    priced = nodes.filter(is_a(OFFER_TYPES))
    plausible = ~is_a(["product", "offer"]) | F.col("name").rlike(hint)
    nested = F.coalesce(F.expr("try_variant_get(node, '$.offers', 'ARRAY<VARIANT>')"), F.array(F.expr("try_variant_get(node, '$.offers', 'VARIANT')")))
    offers = priced.select("*", F.posexplode_outer(F.filter(nested, lambda o: o.isNotNull())).alias("offer_pos", "offer"))
    offers = evaluated(offers, nested_text=_price_text("offer"), own_text=_price_text("node"))
    offers = evaluated(offers, nested_price=price_minor("nested_text"), own_price=price_minor("own_text"))
    best = (
        F.when(F.col("nested_price").isNotNull(), "jsonld_offer").when(F.col("own_price").isNotNull(), "jsonld_price")
        .when(is_a(["service", "medicaltest"]), "jsonld_service"))
    rows = offers.withColumn("method", best).filter(F.col("method").isNotNull() & F.col("name").isNotNull() & plausible).select(
        "page_id", "url", (F.col("block") * 1000000 + F.col("pos") * 1000 + F.coalesce("offer_pos", F.lit(0))).alias("seq"), "name",
        F.coalesce("nested_price", "own_price").alias("price_minor"), F.col("node_url").alias("offer_url"), "method")
    return locations, rows


# Members of script objects that name a study, and those that price it.
NAME_MEMBERS, PRICE_MEMBERS = ["title", "name"], ["precio", "price", "cost", "amount"]
#: A quoted key and its value, quoted or bare.
MEMBER = "[\"'](\\w+)[\"']\\s*:\\s*(?:[\"']([^\"']*)[\"']|([^\\s,\"'\\]]+))"


def _script_pairs() -> Column:
    """(title, price) pairs of embedded script objects: of the members between two braces, a name and the next price."""
    state = "struct<name: string, out: array<struct<n: string, p: string>>>"

    def read(chunk: Column) -> Column:
        part = lambda i: F.regexp_extract_all(chunk, F.lit(MEMBER), F.lit(i))
        members = F.zip_with(F.arrays_zip(part(1).alias("k"), part(2).alias("v")), part(3), lambda m, bare: F.struct(F.lower(m["k"]).alias("k"), F.coalesce(F.nullif(m["v"], F.lit("")), bare).alias("v")))

        def step(acc: Column, m: Column) -> Column:
            names = acc["name"].isNull() & m["k"].isin(NAME_MEMBERS) & (F.length(m["v"]) >= 3)
            prices = acc["name"].isNotNull() & m["k"].isin(PRICE_MEMBERS) & m["v"].rlike("[0-9]")
            out = F.when(prices, F.concat(acc["out"], F.array(F.struct(acc["name"].alias("n"), m["v"].alias("p"))))).otherwise(acc["out"])
            return F.struct(F.when(names, m["v"]).when(prices, F.lit(None)).otherwise(acc["name"]).alias("name"), out.alias("out")).cast(state)

        start = F.struct(F.lit(None).cast("string").alias("name"), F.array().cast("array<struct<n: string, p: string>>").alias("out")).cast(state)
        return F.aggregate(members, start, step)["out"]

    wanted = F.filter(F.split("html", "[{}]"), lambda x: x.rlike(f"(?i)[\"'](?:{'|'.join(PRICE_MEMBERS)})[\"']"))
    return F.flatten(F.transform(wanted, read))


def script_evidence(parts: DataFrame, hint: str = SERVICE_HINT) -> DataFrame:
    """Study titles with a price from embedded scripts."""
    rows = parts.select("page_id", "url", F.posexplode("pairs").alias("seq", "z"))
    rows = evaluated(rows, price_minor=price_minor("z.p"))
    return rows.select("page_id", "url", F.col("seq").cast("long"), visible_text("z.n").alias("name"), "price_minor",
                       F.col("url").alias("offer_url"), F.lit("embedded_script_pattern").alias("method")).filter(
        F.col("name").rlike(hint) & (F.col("price_minor") > 0))


def heading_evidence(parts: DataFrame, hint: str = SERVICE_HINT, price_chars: int | None = None) -> DataFrame:
    """Study headings with the price between them and the next heading; without any, the headings alone.

    After a heading without a following one the text is searched to its end, or for ``price_chars``.
    """
    rows = parts.select("page_id", "url", "text", "headings", F.posexplode("headings").alias("seq", "name")).filter(F.col("name").rlike(hint))
    after = F.expr("substring_index(text, name, -1)")
    start = F.instr(F.lower("text"), F.lower("name")) + F.length("name")
    rest = F.when(start > F.length("name"), F.substring(F.col("text"), start, F.length("text"))).otherwise(after)
    following = F.get("headings", F.col("seq") + 1)
    cut = F.when(following.isNotNull() & (F.instr(rest, following) > 0), F.substring(rest, F.lit(1), F.instr(rest, following) - 1)).otherwise(
        rest if price_chars is None else F.substring(rest, 1, price_chars))
    found = evaluated(rows, segment=cut).drop("text", "headings")
    found = evaluated(found, raw=F.regexp_extract("segment", PRICE_PATTERN, 0))
    marked = F.col("raw").contains("$") | F.lower("raw").contains("mxn") | F.lower("segment").rlike(PRICE_WORDS)
    found = evaluated(found, amount=F.when(marked, price_minor("raw")))
    priced = found.withColumn("price_minor", F.when(F.col("amount") > 0, F.col("amount")))
    any_price = priced.groupBy("page_id").agg(F.count("price_minor").alias("prices"))
    return priced.join(any_price, "page_id").filter("prices = 0 OR price_minor IS NOT NULL").select(
        "page_id", "url", F.col("seq").cast("long"), "name", "price_minor", F.col("url").alias("offer_url"),
        F.when(F.col("price_minor").isNotNull(), "price_pattern").otherwise("heading_pattern").alias("method"))


def page_evidence(
        pages: DataFrame, hint: str = SERVICE_HINT, price_chars: int | None = None) -> DataFrame:
    """Location and offer evidence per page with method confidence and stable ids.

    Structured prices win over visible ones of the same name; visible headings alone count only on
    pages with nothing structured.
    """
    # the pages are parsed once; every kind of evidence reads the small extract
    parts = cut_lineage(page_parts(pages))
    locations, offers = structured_evidence(parts, hint)
    structured = offers.unionByName(script_evidence(parts, hint)).withColumn("nname", norm_text("name"))
    patterns = heading_evidence(parts, hint, price_chars).withColumn("nname", norm_text("name"))
    pages_with = structured.select("page_id").distinct()
    priced = structured.filter("price_minor IS NOT NULL").select("page_id", "nname").distinct()
    visible = patterns.filter("price_minor IS NOT NULL").join(pages_with, "page_id", "left_semi").join(priced, ["page_id", "nname"], "left_anti")
    kept = structured.join(visible.select("page_id", "nname").distinct(), ["page_id", "nname"], "left_anti")
    everything = kept.unionByName(visible).unionByName(patterns.join(pages_with, "page_id", "left_anti"))
    once = everything.filter("nname <> ''").groupBy("page_id", "url", "nname", "price_minor", "offer_url").agg(F.min_by(F.struct("name", "method"), "seq").alias("b"))
    confidence = F.lit(0.50)
    for method, value in CONFIDENCE.items():
        confidence = F.when(F.col("method") == method, value).otherwise(confidence)
    rows = once.select("page_id", "url", F.lit("offer").alias("kind"), F.col("b.name").alias("name"), "price_minor", F.col("b.method").alias("method"), "offer_url").unionByName(
        locations.select("page_id", "url", F.lit("location").alias("kind"), "name", F.lit(None).cast("bigint").alias("price_minor"), "method", F.col("url").alias("offer_url")))
    return rows.withColumns({"confidence": confidence.cast("decimal(3,2)"), "external_id": stable_id("kind", "offer_url", "name")})
