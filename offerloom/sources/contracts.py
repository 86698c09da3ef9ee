"""Contract checks of incoming batches: one pass of rules plus duplicate checks, nothing dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Attributes an observation of a place may carry, and the size limits of a batch.
PLACE_ATTRIBUTES = ["name", "legal_name", "activity_code", "phone", "email", "website_url", "postal_code", "latitude", "longitude", "address", "coordinates"]
MAX_OBSERVATIONS, MAX_PAYLOAD, MAX_VALUE, MAX_ID = 12, 65536, 32768, 256


def violations(**rules: Column) -> Column:
    """Names of the rules that hold for a row (a rule is true when it is broken; null counts as broken)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()]))


def ingest_contract(batch: DataFrame, url_prefix: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons) of a batch: external_record_id, source_url, payload (JSON text),
    observations ARRAY<STRUCT<entity_type, status, attribute_name, observed_value>>."""
    names = F.transform("observations", lambda o: o["attribute_name"])
    judged = batch.withColumn("violations", violations(
        observation_count=~F.size("observations").between(1, MAX_OBSERVATIONS),
        record_id=~(F.col("external_record_id").rlike("^[A-Za-z0-9_-]+$") & (F.length("external_record_id") <= MAX_ID)),
        source_url=F.col("source_url") != F.concat(F.lit(url_prefix), "external_record_id"),
        payload_shape=~F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False)),
        payload_size=F.octet_length("payload") > MAX_PAYLOAD,
        observation_shape=~F.forall(
            "observations",
            lambda o: (o["entity_type"] == "provider_location") & (o["status"] == "candidate")
            & o["attribute_name"].isin(*PLACE_ATTRIBUTES) & o["observed_value"].isNotNull() & (F.octet_length(o["observed_value"]) <= MAX_VALUE)),
        duplicate_attribute=F.size(F.array_distinct(names)) != F.size(names),
    ))
    repeated = batch.groupBy("external_record_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "external_record_id", F.array(F.lit("duplicate_id")).alias("repeated"))
    judged = judged.join(repeated, "external_record_id", "left").withColumn(
        "violations", F.concat("violations", F.coalesce("repeated", F.array().cast("array<string>")))).drop("repeated")
    return judged.filter(F.size("violations") == 0).drop("violations"), judged.filter(F.size("violations") > 0)


def location_contract(rows: DataFrame) -> DataFrame:
    """Published branch rows (external_id, slug, name, url, lat, lon) with their broken rules."""
    judged = rows.withColumn("violations", violations(
        external_id=~F.col("external_id").rlike("^[A-Za-z0-9_-]{1,128}$"), slug=~F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"),
        name=F.trim("name") == "", url=~F.col("url").rlike("^https://[^\\s?#]+$"),
        coordinates=~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))))
    repeated = rows.groupBy("external_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("external_id", F.lit(True).alias("again"))
    return judged.join(repeated, "external_id", "left").withColumn(
        "violations", F.when(F.col("again"), F.array_append("violations", F.lit("duplicate_id"))).otherwise(F.col("violations"))).drop("again")
