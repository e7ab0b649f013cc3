"""Submission payloads, manifests, validation and warnings — one row per survey.

The reference builds one nested dict per file; here the same record is a
nested ``struct`` built from a per-survey catalogue joined with the QC
summary and the product's file entry.  ``to_json`` renders it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.joins import join_null_safe
from fathom.sinks.products import ProductInfo

# Fixed values (must equal the reference's payload).
DATA_TYPE = "bathymetry"
SUBMISSION_PREFIX = "SB2030"
QC_RULES = ["coordinate_range_check", "depth_range_check", "beam_angle_range_check",
            "quality_range_check", "duplicate_timestamp_check", "depth_consistency_check"]
DATA_STANDARDS = ["CF-1.8", "NetCDF-4", "WGS84"]
METADATA_STANDARDS = ["ISO 19115", "Dublin Core"]
QUALITY_STANDARDS = ["IHO S-44", "Seabed 2030 QC Guidelines"]
DEFAULT_KEYWORDS = ["bathymetry", "ocean", "mapping"]
REQUIRED_FIELDS = ["submission_id", "data_type", "format", "file_info", "metadata"]
LOW_QUALITY = 0.7
HIGH_ANOMALIES = 100


def _c(df: DataFrame, name: str, default) -> Column:
    lit = F.lit(default) if not isinstance(default, Column) else default
    return F.coalesce(F.col(name), lit) if name in df.columns else lit


def survey_catalog(points: DataFrame, sensor: str, qc: DataFrame | None = None) -> DataFrame:
    """Per survey: extent, time span, totals and QC fields (the metadata a
    payload is built from)."""
    z = "elevation" if sensor == "lidar" else "depth"
    cat = points.groupBy("survey_id").agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        (F.min(z) if z in points.columns else F.lit(None)).alias("min_depth"),
        (F.max(z) if z in points.columns else F.lit(None)).alias("max_depth"),
        F.date_format(F.min("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_time"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("end_time"),
        F.count(F.lit(1)).alias("total_points"))
    cat = cat.withColumn("sensor_type", F.lit(sensor))
    if qc is not None:
        cat = join_null_safe(cat, qc.select("survey_id", "quality_score", F.col("total_anomalies").alias("anomaly_count"),
                                            F.col("status").alias("qc_status")), ["survey_id"], "left")
    return cat


def spatial_coverage(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """Closed bounding-box ring [[[lon, lat] x 5]]; missing bounds -> 0.0."""
    a, b = F.coalesce(min_lat, F.lit(0.0)), F.coalesce(max_lat, F.lit(0.0))
    c, d = F.coalesce(min_lon, F.lit(0.0)), F.coalesce(max_lon, F.lit(0.0))
    return F.array(F.array(F.array(c, a), F.array(d, a), F.array(d, b), F.array(c, b), F.array(c, a)))


def submission_id(run_ts: str, key: Column) -> Column:
    """SB2030_<yyyymmdd_hhmmss>_<md5(...)[:8]>; the survey key keeps ids unique
    when many surveys are submitted in the same second."""
    stamp = F.date_format(F.to_timestamp(F.lit(run_ts)), "yyyyMMdd_HHmmss")
    return F.concat_ws("_", F.lit(SUBMISSION_PREFIX), stamp,
                       F.substring(F.md5(F.concat(stamp, F.lit("_"), key.cast("string"))), 1, 8))


def payload_metadata(cat: DataFrame) -> Column:
    """Metadata section with the reference's defaults for missing values.

    ``quality_score`` falls back from the top level to ``data_quality``."""
    qs = _c(cat, "quality_score", _c(cat, "data_quality_score", 0.0)).cast("double")
    return F.struct(
        _c(cat, "title", "Ocean Mapping Data").alias("title"),
        _c(cat, "description", "Processed ocean mapping data").alias("description"),
        _c(cat, "keywords", F.array(*[F.lit(k) for k in DEFAULT_KEYWORDS])).alias("keywords"),
        F.struct(F.lit("Polygon").alias("type"),
                 spatial_coverage(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))
                 .alias("coordinates")).alias("spatial_coverage"),
        F.struct(_c(cat, "start_time", "2024-01-01T00:00:00Z").alias("start"),
                 _c(cat, "end_time", "2024-01-01T23:59:59Z").alias("end")).alias("temporal_coverage"),
        F.struct(qs.alias("quality_score"), _c(cat, "anomaly_count", 0).cast("long").alias("anomaly_count"),
                 _c(cat, "qc_status", "unknown").alias("qc_status")).alias("data_quality"),
        F.struct(_c(cat, "sensor_type", "unknown").alias("type"), _c(cat, "sensor_model", "unknown").alias("model"),
                 _c(cat, "frequency", "unknown").cast("string").alias("frequency")).alias("sensor_info"),
        F.struct(_c(cat, "vessel_name", "unknown").alias("name"),
                 _c(cat, "vessel_call_sign", "unknown").alias("call_sign"),
                 _c(cat, "vessel_imo", "unknown").cast("string").alias("imo")).alias("vessel_info"),
        F.struct(F.col("survey_id").cast("string").alias("survey_id"),
                 _c(cat, "survey_name", "unknown").alias("survey_name"),
                 _c(cat, "survey_date", "2024-01-01").alias("survey_date")).alias("survey_info"))


def payloads(cat: DataFrame, files: DataFrame, info: ProductInfo = ProductInfo(),
             anonymized: bool = False, overlay: str | None = None, output_format: str = "netcdf") -> DataFrame:
    """One payload per survey: catalogue ⋈ file entry (filename, size, checksum)."""
    j = join_null_safe(cat, files.select("survey_id", "filename", "file_size_bytes", "checksum"), ["survey_id"], "left")
    md = payload_metadata(j)
    qs = md["data_quality"]["quality_score"]
    ac = md["data_quality"]["anomaly_count"]
    qc = F.struct(F.lit(True).alias("qc_applied"), F.lit("automated").alias("qc_method"),
                  F.lit(f"{info.software} v{info.version}").alias("qc_software"),
                  F.array(*[F.lit(r) for r in QC_RULES]).alias("qc_rules"),
                  F.struct(F.lit("deterministic_rules").alias("method"), ac.alias("anomalies_found"),
                           qs.alias("quality_score")).alias("anomaly_detection"))
    prov = F.struct(F.lit(info.software).alias("data_source"),
                    F.lit(f"{info.software} v{info.version}").alias("processing_software"),
                    F.lit(info.run_ts).alias("processing_date"), F.lit("L2").alias("processing_level"),
                    F.struct(F.lit(anonymized).alias("applied"),
                             F.lit("deterministic_hashing").alias("method")).alias("anonymization"),
                    F.struct(F.lit(overlay is not None).alias("applied"),
                             F.lit(overlay or "none").alias("plugin")).alias("environmental_overlay"))
    comp = F.struct(F.lit(True).alias("seabed2030_compliant"), F.lit("1.0").alias("seabed2030_version"),
                    F.array(*[F.lit(s) for s in DATA_STANDARDS]).alias("data_standards"),
                    F.array(*[F.lit(s) for s in METADATA_STANDARDS]).alias("metadata_standards"),
                    F.array(*[F.lit(s) for s in QUALITY_STANDARDS]).alias("quality_standards"),
                    F.lit(info.license).alias("license"), F.lit("None").alias("usage_restrictions"),
                    F.lit("Public").alias("data_availability"))
    fi = F.struct(F.col("filename"), F.coalesce(F.col("file_size_bytes"), F.lit(0)).cast("long")
                  .alias("file_size_bytes"), F.col("checksum"), F.lit("sha256").alias("checksum_algorithm"))
    return j.select("survey_id", submission_id(info.run_ts, F.col("survey_id")).alias("submission_id"),
                    F.lit(info.run_ts).alias("timestamp"), F.lit(DATA_TYPE).alias("data_type"),
                    F.lit(output_format).alias("format"), fi.alias("file_info"), md.alias("metadata"),
                    qc.alias("quality_control"), prov.alias("provenance"), comp.alias("compliance"))


def product_files(spark, product_path: str) -> DataFrame:
    """Every file of a product written ``partitionBy("survey_id")``: survey,
    file name, size and SHA-256 of its bytes (``binaryFile``)."""
    from fathom.sources.files import file_checksums
    f = file_checksums(spark, f"{product_path.rstrip('/')}/*/*.parquet")
    return f.select(F.regexp_extract("path", r"survey_id=([^/]+)/", 1).alias("survey_id"),
                    F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
                    "file_size_bytes", "checksum")


def survey_file_entries(files: DataFrame) -> DataFrame:
    """One payload file entry per survey: its product folder, total size and a
    checksum over its files' checksums (sorted, so it is deterministic).  The
    list per survey is bounded by the product's files, not by rows."""
    return files.groupBy("survey_id").agg(
        F.concat(F.lit("survey_id="), F.first("survey_id")).alias("filename"),
        F.sum("file_size_bytes").alias("file_size_bytes"),
        F.sha2(F.array_join(F.sort_array(F.collect_list("checksum")), ","), 256).alias("checksum"))


def manifest(payload: DataFrame, run_ts: str, files: DataFrame | None = None) -> DataFrame:
    """manifest v1.0 per submission with its files[]: one entry per product
    file when ``files`` (``product_files``) is given, else the payload's file."""
    if files is not None:
        rows = join_null_safe(payload.select("survey_id", "submission_id", "metadata", "quality_control", "provenance", "compliance"),
                              files, ["survey_id"])
        entry = F.struct("filename", "file_size_bytes", "checksum",
                         F.lit("sha256").alias("checksum_algorithm"), F.lit("data").alias("file_type"))
    else:
        rows = payload
        entry = F.struct(F.col("file_info.filename").alias("filename"),
                         F.col("file_info.file_size_bytes").alias("file_size_bytes"),
                         F.col("file_info.checksum").alias("checksum"),
                         F.col("file_info.checksum_algorithm").alias("checksum_algorithm"),
                         F.lit("data").alias("file_type"))
    return rows.groupBy("submission_id").agg(
        F.lit("1.0").alias("manifest_version"), F.lit(run_ts).alias("created"),
        F.collect_list(entry).alias("files"), F.first("metadata").alias("metadata"),
        F.first("quality_control").alias("quality_control"), F.first("provenance").alias("provenance"),
        F.first("compliance").alias("compliance"))


def validate_payload(payload: DataFrame) -> DataFrame:
    """checks[] (field, status, message) and overall valid / invalid."""
    def present(f):
        ok = F.col(f).isNotNull()
        return F.struct(F.lit(f).alias("field"), F.when(ok, "present").otherwise("missing").alias("status"),
                        F.when(ok, F.lit(f"Required field '{f}' is present"))
                         .otherwise(F.lit(f"Required field '{f}' is missing")).alias("message"))
    size_ok = F.col("file_info.file_size_bytes") > 0
    size = F.struct(F.lit("file_size").alias("field"), F.when(size_ok, "valid").otherwise("invalid").alias("status"),
                    F.when(size_ok, F.lit("File size is valid")).otherwise(F.lit("File size is invalid"))
                    .alias("message"))
    cov_ok = F.col("metadata.spatial_coverage").isNotNull()
    cov = F.struct(F.lit("spatial_coverage").alias("field"),
                   F.when(cov_ok, "valid").otherwise("missing").alias("status"),
                   F.when(cov_ok, F.lit("Spatial coverage is defined"))
                    .otherwise(F.lit("Spatial coverage is missing")).alias("message"))
    checks = F.array(*[present(f) for f in REQUIRED_FIELDS], size, cov)
    bad = F.exists(checks, lambda c: c["status"].isin("missing", "invalid"))
    return payload.select("survey_id", "submission_id", checks.alias("checks"),
                          F.when(bad, "invalid").otherwise("valid").alias("status"))


def warnings(payload: DataFrame, api_key: bool = False) -> DataFrame:
    qs = F.col("metadata.data_quality.quality_score")
    ac = F.col("metadata.data_quality.anomaly_count")
    w = F.array_compact(F.array(
        F.lit(None) if api_key else F.lit("No API key provided - upload will fail in production"),
        F.when(F.col("provenance.anonymization.applied"),
               F.lit("Data has been anonymized - original vessel information is not available")),
        F.when(F.col("provenance.environmental_overlay.applied"),
               F.lit("Environmental overlay applied - verify overlay data accuracy")),
        F.when(qs < LOW_QUALITY, F.format_string("Low quality score (%.2f) - consider data review", qs)),
        F.when(ac > HIGH_ANOMALIES, F.format_string("High anomaly count (%d) - consider data review", ac))))
    return payload.select("survey_id", "submission_id", w.alias("warnings"))


def submission_report(payload: DataFrame, api_key: bool = False) -> DataFrame:
    """Batch readiness report: validation + warnings per submission."""
    v = validate_payload(payload)
    w = warnings(payload, api_key)
    return (join_null_safe(v, w, ["survey_id", "submission_id"])
             .withColumn("dry_run_status", F.lit("dry_run_completed")))
