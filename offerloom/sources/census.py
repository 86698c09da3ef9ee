"""Census CSV scan and registry filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The columns that identify and locate an establishment; contact columns are never read.
CENSUS_COLUMNS = ["id", "clee", "nom_estab", "raz_social", "codigo_act", "nombre_act", "cve_ent", "municipio", "cod_postal", "www", "latitud", "longitud"]
# State code, activity prefixes and bounding box of the census.
STATE, ACTIVITY, BOX = "21", "^62[12]", (17.7, 21.0, -99.1, -96.6)


def read_census_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with an explicit all-text schema in header order (land files as UTF-8)."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    missing = [c for c in CENSUS_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"census header lacks {missing}")
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False).select(*CENSUS_COLUMNS)


def census_scan(rows: DataFrame) -> dict[str, DataFrame]:
    """Health establishments with quality flags, contract errors, and counts per class and place."""
    wanted = rows.filter(F.col("codigo_act").rlike(ACTIVITY))
    lat, lon = F.col("latitud").try_cast("double"), F.col("longitud").try_cast("double")
    inside = lat.between(BOX[0], BOX[1]) & lon.between(BOX[2], BOX[3])
    ok = F.coalesce(inside & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))
    key = F.trim("id")
    flagged = wanted.withColumns({
        "external_record_id": key,
        "lat": F.when(ok, lat), "lon": F.when(ok, lon),
        "quality_flags": F.array_compact(F.array(
            F.when(F.coalesce(F.trim("nom_estab"), F.lit("")) == "", "missing_business_name"), F.when(~ok, "invalid_coordinates"))),
    })
    repeated = flagged.groupBy("external_record_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    errors = (
        rows.filter(F.col("cve_ent") != STATE).select(F.trim("id").alias("external_record_id"), F.lit("other_state").alias("error"))
        .unionByName(flagged.filter(~F.col("external_record_id").rlike("^[0-9]{1,16}$")).select("external_record_id", F.lit("invalid_id").alias("error")))
        .unionByName(repeated.select("external_record_id", F.lit("duplicate_id").alias("error"))))
    return {
        "records": flagged, "errors": errors,
        "by_class": flagged.groupBy("codigo_act").agg(F.count(F.lit(1)).alias("n")),
        "by_municipality": flagged.groupBy("municipio").agg(F.count(F.lit(1)).alias("n")),
        "by_flag": flagged.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n")),
    }


def registry_filter(rows: DataFrame, entity: str, requested: DataFrame | None = None) -> dict[str, DataFrame]:
    """Registry rows (registry_id, entity, name, comment) of one entity.

    Ids must be unique over all rows; requested ids that are absent are listed, and ids mentioned in
    comments are emitted.
    """
    repeated = rows.groupBy("registry_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = rows.filter(F.col("entity") == entity)
    missing = None
    if requested is not None:
        missing = requested.select("registry_id").distinct().join(kept, "registry_id", "left_anti")
        kept = kept.join(requested.select("registry_id").distinct(), "registry_id", "left_semi")
    mentioned = kept.select(
        "registry_id", F.explode(F.array_distinct(F.regexp_extract_all("comment", F.lit("\\b([A-Z]{5}[0-9]{6})\\b"), F.lit(1)))).alias("mentioned_id"))
    return {"records": kept, "duplicates": repeated, "missing": missing, "mentioned": mentioned}
