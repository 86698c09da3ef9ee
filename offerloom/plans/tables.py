"""Domain tables derived from the driver's tables, in SQL that Spark and DuckDB both run.

``{name}`` stands for a base table or another view; ``view`` renders for Spark (parquet paths),
``duck`` renders the same text as a chain of CTEs, so an oracle starts from the same inputs and
only the operator under test differs.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {
    # --- catalog: one item per part name, attributes from its two words -------------------------
    "items": """
        SELECT CAST(min(p_partkey) AS STRING) AS item_id, p_name AS name, 'parts' AS domain_code,
               CASE WHEN p_name = 'cold rod' THEN 'retired' ELSE 'active' END AS status
        FROM {part} GROUP BY p_name""",
    "names": """
        SELECT item_id, 'es-MX' AS locale, name, TRUE AS is_primary, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM {items}
        UNION ALL
        SELECT item_id, 'en-US' AS locale, concat(split_part(name, ' ', 2), ' ', split_part(name, ' ', 1)) AS name,
               FALSE AS is_primary, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM {items}""",
    "aliases": """
        SELECT i.item_id, concat(lower(p.p_type), ' ', p.p_name) AS alias,
               CASE WHEN count(*) % 2 = 0 THEN min(p.p_brand) ELSE CAST(NULL AS STRING) END AS provider_id,
               CASE WHEN max(p.p_size) >= 40 THEN 0.95 ELSE 0.9 END AS confidence,
               CASE WHEN p.p_type = 'PROMO' THEN 'proposed' ELSE 'approved' END AS status
        FROM {part} p JOIN {items} i ON i.name = p.p_name GROUP BY i.item_id, p.p_type, p.p_name""",
    "descriptions": "SELECT item_id, concat(name, ' spare part') AS description, 'approved' AS status FROM {items}",
    "disambiguation": "SELECT 'old' AS term, item_id, 'approved' AS status FROM {items} WHERE split_part(name, ' ', 1) = 'old'",
    "attributes": """
        SELECT item_id, 'modality' AS attribute_type, split_part(name, ' ', 1) AS attribute_value FROM {items}
        UNION ALL SELECT item_id, 'component' AS attribute_type, split_part(name, ' ', 2) AS attribute_value FROM {items}""",
    "lexicon": """
        SELECT DISTINCT split_part(p_name, ' ', 1) AS phrase, 'modality' AS attribute_type, split_part(p_name, ' ', 1) AS attribute_value, 'approved' AS status FROM {part}
        UNION ALL
        SELECT DISTINCT split_part(p_name, ' ', 2) AS phrase, 'component' AS attribute_type, split_part(p_name, ' ', 2) AS attribute_value, 'approved' AS status FROM {part}
        UNION ALL
        SELECT DISTINCT lower(p_type) AS phrase, 'panel' AS attribute_type, lower(p_type) AS attribute_value, 'approved' AS status FROM {part} WHERE p_type = 'STANDARD'""",
    "identifiers": """
        SELECT item_id, 'http://loinc.org' AS system, concat(CAST(CAST(item_id AS BIGINT) % 50 AS STRING), '-', CAST(length(name) AS STRING)) AS code,
               '2.7' AS version, 'exact' AS mapping_type, 'active' AS status, TRUE AS verified,
               TIMESTAMP '2024-01-01 00:00:00' AS approved_at, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM {items}""",
    # one request per part and per customer: exact, letters swapped or dropped, alias, extra word, code, foreign text
    "queries": """
        SELECT concat('p', CAST(p_partkey AS STRING)) AS query_id,
               CASE p_partkey % 7
                 WHEN 0 THEN p_name
                 WHEN 1 THEN concat(substr(p_name, 1, 1), substr(p_name, 3, 1), substr(p_name, 2, 1), substr(p_name, 4))
                 WHEN 2 THEN concat(substr(p_name, 1, CAST(1 + p_partkey % 4 AS INT)), substr(p_name, CAST(3 + p_partkey % 4 AS INT)))
                 WHEN 3 THEN concat(p_type, ' ', p_name)
                 WHEN 4 THEN concat(p_name, ' #', CAST(p_partkey AS STRING))
                 WHEN 5 THEN split_part(p_name, ' ', 2)
                 ELSE concat(CAST(p_partkey % 50 AS STRING), '-', CAST(length(p_name) AS STRING)) END AS query_text,
               CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS provider_id
        FROM {part}
        UNION ALL
        SELECT concat('c', CAST(c_custkey AS STRING)) AS query_id, c_name AS query_text, CAST(NULL AS STRING) AS provider_id FROM {customer}""",
    # --- supply ---------------------------------------------------------------------------------
    "brands": "SELECT CAST(s_suppkey AS STRING) AS provider_id, s_name AS provider_name, CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status FROM {supplier}",
    "locations": """
        SELECT CAST(c_custkey AS STRING) AS location_id, CAST(c_custkey % (SELECT count(*) FROM {supplier}) AS STRING) AS provider_id,
               concat(CAST(c_custkey % (SELECT count(*) FROM {supplier}) AS STRING), '-', CAST(c_nationkey AS STRING)) AS market_id, c_name AS location_name,
               CASE WHEN c_acctbal < 500 THEN 'closed' ELSE 'active' END AS status,
               CASE c_nationkey % 3 WHEN 0 THEN 'America/Mexico_City' WHEN 1 THEN 'UTC' ELSE 'America/New_York' END AS timezone,
               CAST(19 + (c_custkey * 37 % 1000) / 1000.0 AS DOUBLE) AS lat, CAST(-98 - (c_custkey * 91 % 1000) / 1000.0 AS DOUBLE) AS lon,
               CASE WHEN c_custkey % 10 = 9 THEN ' ' ELSE concat('Calle ', CAST(c_custkey AS STRING)) END AS line1,
               CASE WHEN c_custkey % 4 = 0 THEN 'Local 2' END AS line2, c_mktsegment AS locality,
               CASE WHEN c_custkey % 5 <> 0 THEN CAST(72000 + c_custkey % 1000 AS STRING) END AS postal_code
        FROM {customer}""",
    "market_locations": "SELECT market_id, provider_id, location_id FROM {locations}",
    "offers": """
        SELECT concat(CAST(l.l_partkey AS STRING), '-', CAST(l.l_suppkey AS STRING)) AS offer_id, CAST(l.l_suppkey AS STRING) AS provider_id,
               i.item_id, max(l.l_quantity) >= 48 AS requires_quote,
               CASE WHEN min(l.l_tax) >= 0.08 THEN 'retired' ELSE 'active' END AS status, count(*) AS seen
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {items} i ON i.name = p.p_name
        GROUP BY l.l_partkey, l.l_suppkey, i.item_id""",
    "scopes": """
        SELECT concat('b', offer_id) AS scope_id, offer_id, 'brand' AS scope_type, CAST(NULL AS STRING) AS market_id, CAST(NULL AS STRING) AS location_id, 'active' AS status FROM {offers}
        UNION ALL
        SELECT DISTINCT concat('m', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_linenumber * 3 AS STRING)) AS scope_id,
               concat(CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS offer_id, 'market' AS scope_type,
               concat(CAST(l_suppkey AS STRING), '-', CAST(l_linenumber * 3 AS STRING)) AS market_id, CAST(NULL AS STRING) AS location_id, 'active' AS status
        FROM {lineitem} WHERE l_returnflag = 'N'
        UNION ALL
        SELECT DISTINCT concat('l', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_orderkey % 15 AS STRING)) AS scope_id,
               concat(CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS offer_id, 'location' AS scope_type,
               CAST(NULL AS STRING) AS market_id, CAST(l_suppkey + (SELECT count(*) FROM {supplier}) * (l_orderkey % 15) AS STRING) AS location_id, 'active' AS status
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    # one current price per (scope, type, key): the smallest amount seen for it
    "prices": """
        SELECT concat(scope_id, '/', price_type, '/', price_key) AS price_id, scope_id, price_type, 'any' AS channel, price_key,
               min(amount_minor) AS amount_minor, 'MXN' AS currency, min(valid_from) AS valid_from,
               CASE WHEN max(tax) >= 0.07 THEN max(valid_from) + INTERVAL '900' DAY END AS valid_to,
               CASE WHEN max(tax) < 0.02 THEN '08:00:00' WHEN max(tax) < 0.03 THEN '20:00:00' END AS day_time_from,
               CASE WHEN max(tax) < 0.02 THEN '18:00:00' WHEN max(tax) < 0.03 THEN '06:00:00' END AS day_time_to,
               CASE WHEN max(discount) < 0.03 THEN array(1, 2, 3, 4, 5) END AS weekdays,
               max(valid_from) AS last_seen_at, min(valid_from) AS created_at, max(discount) < 0.1 AS is_current
        FROM (
          SELECT s.scope_id, CASE WHEN l.l_linestatus = 'O' THEN 'regular' ELSE 'online' END AS price_type,
                 CASE WHEN l.l_discount >= 0.05 THEN 'member' ELSE 'default' END AS price_key,
                 CAST(round(l.l_extendedprice / l.l_quantity * 100) AS BIGINT) AS amount_minor, l.l_shipdate AS valid_from, l.l_tax AS tax, l.l_discount AS discount
          FROM {lineitem} l JOIN {scopes} s
            ON s.offer_id = concat(CAST(l.l_partkey AS STRING), '-', CAST(l.l_suppkey AS STRING))
           AND s.scope_type = CASE l.l_returnflag WHEN 'N' THEN 'market' WHEN 'R' THEN 'location' ELSE 'brand' END
        ) x GROUP BY scope_id, price_type, price_key""",
    # every line asks for the price of its offer at one branch of the brand
    "price_asks": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS ask_id,
               concat(CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS offer_id,
               CAST(l_suppkey + (SELECT count(*) FROM {supplier}) * (l_orderkey % 15) AS STRING) AS location_id,
               l_shipdate + (l_orderkey % 24 + 1440) * INTERVAL '1' HOUR AS at
        FROM {lineitem}""",
    "links": """
        SELECT concat('d', scope_id) AS link_id, scope_id, 'study' AS link_target, concat('https://p.example.com/d/', scope_id) AS url, 'active' AS status,
               CASE WHEN scope_type = 'brand' THEN TIMESTAMP '2024-03-01 00:00:00' END AS verified_at, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM {scopes}
        UNION ALL
        SELECT concat('k', scope_id) AS link_id, scope_id, 'booking' AS link_target, concat('https://p.example.com/b/', scope_id) AS url,
               CASE WHEN length(scope_id) % 5 = 0 THEN 'broken' ELSE 'active' END AS status, CAST(NULL AS TIMESTAMP) AS verified_at, TIMESTAMP '2024-02-01 00:00:00' AS created_at FROM {scopes} WHERE scope_type <> 'brand'
        UNION ALL
        SELECT concat('h', scope_id) AS link_id, scope_id, 'provider' AS link_target, concat('https://p.example.com/h/', scope_id) AS url, 'active' AS status,
               CAST(NULL AS TIMESTAMP) AS verified_at, TIMESTAMP '2024-02-01 00:00:00' AS created_at FROM {scopes} WHERE scope_type = 'brand' AND length(offer_id) % 2 = 0
        UNION ALL
        SELECT concat('o', scope_id) AS link_id, scope_id, 'location' AS link_target, concat('https://p.example.com/l/', scope_id) AS url, 'active' AS status,
               CAST(NULL AS TIMESTAMP) AS verified_at, TIMESTAMP '2024-02-01 00:00:00' AS created_at FROM {scopes} WHERE scope_type = 'location'""",
    # --- packages: parts are the items, every supplier has one branch ----------------------------
    "requests": """
        SELECT concat(CAST(o.o_custkey AS STRING), '-', o.o_orderstatus) AS request_id, CAST(l.l_partkey AS STRING) AS item_id,
               dense_rank() OVER (PARTITION BY o.o_custkey, o.o_orderstatus ORDER BY l.l_partkey) AS item_index,
               CAST(19 + (o.o_custkey * 37 % 1000) / 1000.0 AS DOUBLE) AS lat, CAST(-98 - (o.o_custkey * 91 % 1000) / 1000.0 AS DOUBLE) AS lon
        FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, o.o_orderstatus, l.l_partkey""",
    "branch_offers": """
        SELECT CAST(l.l_partkey AS STRING) AS item_id, concat('s', CAST(l.l_suppkey AS STRING)) AS location_id,
               concat(CAST(l.l_partkey AS STRING), '-', CAST(l.l_suppkey AS STRING)) AS offer_id, s.s_name AS provider_name, s.s_name AS location_name,
               CAST(19 + (l.l_suppkey * 53 % 1000) / 1000.0 AS DOUBLE) AS lat, CAST(-98 - (l.l_suppkey * 17 % 1000) / 1000.0 AS DOUBLE) AS lon,
               CASE WHEN min(l.l_tax) >= 0.08 THEN NULL ELSE CAST(round(min(l.l_extendedprice / l.l_quantity) * 100) AS BIGINT) END AS amount_minor,
               'MXN' AS currency, max(l.l_quantity) >= 49 AS requires_quote
        FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey GROUP BY l.l_partkey, l.l_suppkey, s.s_name""",
}

_REF = re.compile(r"\{(\w+)\}")


def _needed(names, held=()) -> list[str]:
    """The views behind the given names, dependencies first; those held as tables end the search."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in held or name in ordered:
            return
        for dep in _REF.findall(VIEWS[name]):
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _chain(names, table, array: str, held=()) -> str:
    def render(sql: str) -> str:
        return _REF.sub(lambda m: table(m.group(1)) if m.group(1) in BASE or m.group(1) in held else m.group(1), sql).replace("array(", array)
    return ",\n".join(f"{n} AS ({render(VIEWS[n])})" for n in _needed(names, held))


def view(spark: SparkSession, sf_dir: str, name: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """A domain view (or base table) as a DataFrame.

    ``held``: views that the query has written already, read in their place by the views made of them.
    """
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    held = held or {}
    named = {n: f"held_{n}_{uuid.uuid4().hex}" for n in held}
    for n, rows in held.items():
        rows.createOrReplaceTempView(named[n])
    chain = _chain([name], lambda t: named.get(t, f"parquet.`{sf_dir}/{t}.parquet`"), "array(", held)
    out = spark.sql(f"WITH {chain} SELECT * FROM {name}")
    for n in named.values():  # the plan holds them now
        spark.catalog.dropTempView(n)
    return out


def duck(*names: str) -> str:
    """``WITH`` prefix that defines the same views for DuckDB (ends without a trailing comma)."""
    return "WITH " + _chain(names, lambda t: t, "list_value(")
