"""Hashes, URL hygiene and redaction."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .text import c

# Query parameters whose value is a secret.
SECRET_PARAMS = "token|api[_-]?key|access[_-]?token|refresh[_-]?token|signature|sig|key"
# What is removed from free text, in this order, and what takes its place.
REDACTIONS = [
    ("(?i)\\bhttps?://[^\\s<>\"']+", "[REDACTED]"),
    (f"(?i)([?&](?:{SECRET_PARAMS})=)[^&#\\s]+", "$1[REDACTED]"),
    ("(?i)(bearer\\s+)[^\\s]+", "$1[REDACTED]"),
]
# Key names whose value is removed from JSON.
SECRET_KEYS = re.compile(
    "(password|passphrase|secret|token|authorization|cookie|api[_-]?key|private[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret)")


def content_hash(payload) -> Column:
    """SHA-256 of the JSON with sorted keys; null for text that is not JSON."""
    return F.sha2(F.to_json(F.try_parse_json(c(payload))), 256)


def safe_url(url, https_only: bool = False) -> Column:
    """scheme://host/path without credentials, query or fragment; null when not acceptable."""
    text = F.trim(c(url))
    pattern = "^https://" if https_only else "^https?://"
    scheme = F.lower(F.try_parse_url(text, F.lit("PROTOCOL")))
    authority = F.try_parse_url(text, F.lit("AUTHORITY"))
    path = F.coalesce(F.try_parse_url(text, F.lit("PATH")), F.lit(""))
    ok = (
        F.lower(text).rlike(pattern)
        & F.try_parse_url(text, F.lit("HOST")).isNotNull()
        & ~authority.contains("@")
    )
    return F.when(ok, F.concat(scheme, F.lit("://"), F.lower(authority), path))


def site_host(url) -> Column:
    """Host of a website text: wrapping punctuation stripped, scheme added, ``www.`` folded."""
    text = F.regexp_replace(F.trim(c(url)), "^[<(\\[\"'\\s]+|[>)\\]\"'.,;\\s]+$", "")
    full = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), "^www\\.", "")
    authority = F.try_parse_url(full, F.lit("AUTHORITY"))
    port = F.regexp_extract(authority, ":([0-9]+)$", 1)
    return F.when((text != "") & host.contains(".") & ~authority.contains("@") & port.isin("", "80", "443"), host)


def redact_text(text, limit: int | None = None) -> Column:
    """Secrets of ``REDACTIONS`` removed from free text, on one line; cut only where a limit is asked for."""
    out = F.translate(c(text), "\r\n", "  ")
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return out if limit is None else F.left(out, F.lit(limit))


def _strip_secrets(value):
    """Secret-named keys replaced, level by level without recursion, so that depth has no limit."""
    top = [value]
    stack: list = [top]
    while stack:
        node = stack.pop()
        for key in node if isinstance(node, dict) else range(len(node)):
            if isinstance(node, dict) and SECRET_KEYS.search(key.lower()):
                node[key] = "[REDACTED]"
            elif isinstance(node[key], (dict, list)):
                stack.append(node[key])
    return top[0]


def _redact_one(text):
    try:
        return None if text is None else json.dumps(
            _strip_secrets(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def redact_json(df: DataFrame, column: str) -> DataFrame:
    """Secret-named keys replaced at any depth; Catalyst has no recursive JSON rewrite.

    A value that is not JSON becomes null.
    """
    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{column: [_redact_one(v) for v in batch[column]]})

    return df.mapInPandas(rewrite, df.schema)


def table_digest(df: DataFrame) -> DataFrame:
    """Row count and order-free hash of a table: equal before and after means unchanged."""
    row_hash = F.xxhash64(*[F.col(f.name) for f in df.schema.fields]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(row_hash), F.lit(0)).alias("digest"))
