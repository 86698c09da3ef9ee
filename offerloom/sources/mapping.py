"""Source rows (JSON text) to records and observations; one operator, one spec per source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hygiene import content_hash, safe_url


@dataclass(frozen=True)
class Field:
    """An observation: attribute name, JSON paths in order of preference, optional cast of the text."""

    entity_type: str
    attribute: str
    paths: tuple[str, ...]
    cast: object = None


@dataclass(frozen=True)
class SourceSpec:
    source_key: str
    record_type: str
    id_paths: tuple[str, ...]
    title_paths: tuple[str, ...]
    observations: tuple[Field, ...]
    url: object = None
    keep: object = None
    confidence: float = 1.0
    drop_keys: tuple[str, ...] = field(default=())


def first_text(payload: Column, paths) -> Column:
    """First non-blank scalar among the paths."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in paths])


def source_records(rows: DataFrame, spec: SourceSpec, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(records with their observation array, rejected rows with the reason).

    ``rows`` holds one JSON text per row plus ``observed_at``. Rows the source marks as out of scope
    (inactive, other zone) are skipped without being errors.
    """
    body = F.col(payload)
    record_id, title = first_text(body, spec.id_paths), first_text(body, spec.title_paths)
    scoped = rows if spec.keep is None else rows.filter(spec.keep(body))
    values = [
        F.struct(
            F.lit(o.entity_type).alias("entity_type"), F.lit(o.attribute).alias("attribute_name"),
            (o.cast(first_text(body, o.paths)).cast("string") if o.cast else first_text(body, o.paths)).alias("observed_value"))
        for o in spec.observations]
    judged = scoped.withColumns({
        "external_record_id": record_id,
        "title": title,
        "reject_reason": F.when(F.try_parse_json(body).isNull(), "not_json").when(record_id.isNull(), "missing_id").when(title.isNull(), "missing_title"),
    })
    records = judged.filter("reject_reason IS NULL").select(
        F.lit(spec.source_key).alias("source_key"), F.lit(spec.record_type).alias("record_type"), "external_record_id", "title",
        (safe_url(spec.url(body)) if spec.url else F.lit(None).cast("string")).alias("source_url"),
        content_hash(payload).alias("record_hash"), "observed_at", payload,
        F.filter(F.array(*values), lambda o: o["observed_value"].isNotNull()).alias("observations"))
    rejects = judged.filter("reject_reason IS NOT NULL").select(
        F.lit(spec.source_key).alias("source_key"), "observed_at", "reject_reason", payload)
    return records, rejects


def observations_of(records: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Long form: one row per observation, linked by the content hash of its record."""
    return records.select("source_key", "record_hash", "external_record_id", "observed_at", F.inline("observations")).withColumns({
        "confidence": F.lit(confidence).cast("decimal(5,4)"), "status": F.lit("candidate")})


def union_captures(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One record per id over several queries (external_record_id, payload, query), plus conflicts.

    An id seen twice must carry the same content; the queries that hit it are kept. The list per id
    is bounded by the number of distinct queries, which is reduced before it is collected.
    """
    hashed = captures.withColumn("content", content_hash("payload")).groupBy("external_record_id", "content", "query").agg(
        F.min("payload").alias("payload"))
    per = hashed.groupBy("external_record_id").agg(
        F.min("content").alias("record_hash"), F.count_distinct("content").alias("variants"), F.min("payload").alias("payload"),
        F.array_sort(F.collect_set("query")).alias("queries"))
    return per.filter("variants = 1").drop("variants"), per.filter("variants > 1").select("external_record_id", "variants")


def approved_sources(sources: DataFrame, endpoints: DataFrame, expected: DataFrame) -> DataFrame:
    """Sources with exactly one reviewed endpoint: active, approved, brand bound, URL as expected."""
    rows = expected.filter(F.col("source_type").isin("government", "provider_official", "official_api")).join(
        sources.select("source_name", "source_type", "source_id", "status", "policy", "provider_id"), ["source_name", "source_type"]).join(
        endpoints.select("source_id", F.col("endpoint_id"), F.col("status").alias("endpoint_status"), F.col("url")), "source_id")
    fine = (
        (F.col("status") == "active") & (F.col("policy") == "approved") & F.col("provider_id").isNotNull()
        & (F.col("endpoint_status") == "active") & (safe_url("url") == safe_url("expected_url")))
    per = rows.groupBy("source_key").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("fine"), F.min("source_id").alias("source_id"),
        F.min("endpoint_id").alias("endpoint_id"))
    return per.filter("n = 1 AND fine").select("source_key", "source_id", "endpoint_id")


def catalog_terms_export(terms: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Ordered page of catalog terms."""
    return terms.orderBy("item_id", "term_source", "nt", "term_provider", "term").offset(offset).limit(limit)


def terminology_index(release: DataFrame, classes=None, class_types=None, active_only: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept rows, counts seen and written, codes that occur more than once)."""
    def listed(column, values):
        return F.upper(column).isin(*[v.upper() for v in values]) if values else F.lit(True)
    keep = listed("class", classes) & listed("classtype", class_types)
    if active_only:
        keep = keep & F.upper("status").isin("ACTIVE", "TRIAL")
    kept = release.filter(keep)
    counts = release.agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(keep).alias("rows_written"))
    return kept, counts, kept.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
