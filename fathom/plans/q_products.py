"""Check queries: overlays (§2.3, 2.5), products (§2.2), submission (§2.11),
job analytics (§2.12), sources (§2.1) and the convert composition."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fathom.operators import jobs as jb
from fathom.operators import overlay as ov
from fathom.operators import scoring as sc
from fathom.operators import stats as st
from fathom.operators import submission as sb
from fathom.operators.grid import attributed_grid
from fathom.operators.joins import join_null_safe
from fathom.plans.catalog import r6, register
from fathom.plans.views import view
from fathom.session import scratch_table_path
from fathom.sinks import products as pr
from fathom.sources import files as fs

RUN_TS = "2024-01-01T00:00:00Z"
INFO = pr.ProductInfo(run_ts=RUN_TS)

# ------------------------------------------------------------- overlays

register("overlay_environment", """
SELECT survey_id, idx,
       coalesce(latitude BETWEEN 40.0 AND 41.0 AND longitude BETWEEN -74.0 AND -73.0 AND depth > 100, false) AS plume_detected,
       round(greatest(0.0, 20.0 - (latitude - 40.0) * 0.5 - depth * 0.01), 6) AS water_temperature,
       CASE WHEN depth < 50 THEN 'shallow_water' WHEN depth < 200 THEN 'continental_shelf'
            WHEN depth < 1000 THEN 'continental_slope' ELSE 'deep_sea' END AS habitat_type,
       CASE WHEN coalesce(latitude BETWEEN 40.0 AND 41.0 AND longitude BETWEEN -74.0 AND -73.0 AND depth > 100, false)
            THEN 'high' ELSE 'low' END AS environmental_risk,
       concat_ws('|', CASE WHEN coalesce(latitude BETWEEN 40.0 AND 41.0 AND longitude BETWEEN -74.0 AND -73.0
                                          AND depth > 100, false) THEN 'plume_detected' END,
                      CASE WHEN depth < 100 THEN 'shallow_water' END) AS risk_factors
FROM soundings_mbes""", ("soundings_mbes",))(
    lambda spark, sf_dir: r6(ov.apply_overlay(view(spark, sf_dir, "soundings_mbes"), "environment")
                             .select("survey_id", "idx", "plume_detected", "water_temperature", "habitat_type",
                                     "environmental_risk", F.array_join("risk_factors", "|").alias("risk_factors"))))


@register("overlay_layer_join", """
WITH pts AS (SELECT survey_id, idx, latitude, longitude FROM soundings_mbes
             WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
b AS (SELECT survey_id, min(latitude) AS min_lat, min(longitude) AS min_lon,
             CAST(ceil(((max(latitude) + CAST(0.01 AS DOUBLE)) - min(latitude)) / CAST(0.01 AS DOUBLE)) AS INT) AS n_rows,
             CAST(ceil(((max(longitude) + CAST(0.01 AS DOUBLE)) - min(longitude)) / CAST(0.01 AS DOUBLE)) AS INT) AS n_cols
      FROM pts GROUP BY survey_id),
c AS (SELECT * FROM (SELECT p.survey_id, p.idx, CAST(floor((p.latitude - b.min_lat) / CAST(0.01 AS DOUBLE)) AS INT) AS row,
                            CAST(floor((p.longitude - b.min_lon) / CAST(0.01 AS DOUBLE)) AS INT) AS col, n_rows, n_cols
                     FROM pts p JOIN b ON p.survey_id = b.survey_id) x
      WHERE row >= 0 AND row < n_rows AND col >= 0 AND col < n_cols)
SELECT c.survey_id, c.idx, c.row, c.col, e.dissolved_oxygen, e.ph_level, e.water_turbidity
FROM c LEFT JOIN env_layer e ON c.row = e.row AND c.col = e.col
UNION ALL SELECT survey_id, idx, NULL, NULL, NULL, NULL, NULL FROM soundings_mbes
WHERE latitude IS NULL OR longitude IS NULL""", ("soundings_mbes", "env_layer"))
def q_layer(spark, sf_dir):
    s = view(spark, sf_dir, "soundings_mbes")
    out = ov.apply_overlay(s, "water_quality", {"layer": view(spark, sf_dir, "env_layer"), "resolution": 0.01})
    return out.select("survey_id", "idx", "row", "col", "dissolved_oxygen", "ph_level", "water_turbidity")


@register("overlay_registry")
def q_registry(spark, sf_dir):
    """Every registered overlay applied by name; rows-only (counts per overlay)."""
    s = view(spark, sf_dir, "soundings_mbes")
    a = ov.apply_overlay(s, "environment").groupBy("survey_id").agg(
        F.count_if("plume_detected").alias("plume_points"))
    b = ov.apply_overlay(s, "water_quality", {"layer": view(spark, sf_dir, "env_layer"), "resolution": 0.01})
    b = b.groupBy("survey_id").agg(F.count("dissolved_oxygen").alias("layer_points"))
    info = ov.overlay_info("environment")
    return a.join(b, "survey_id").withColumns({"overlays": F.lit(",".join(ov.available_overlays())),
                                               "plugin": F.lit(info["name"]), "version": F.lit(info["version"])})

# ------------------------------------------------------------- products

register("trajectory_projection", """
SELECT survey_id, timestamp AS time, latitude, longitude, depth, quality, beam_angle FROM soundings_mbes""",
         ("soundings_mbes",))(
    lambda spark, sf_dir: pr.trajectory_table(view(spark, sf_dir, "soundings_mbes"), "mbes"))


@register("trajectory_global_attrs", """
SELECT survey_id, min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min,
       max(longitude) AS lon_max, min(depth) AS z_min, max(depth) AS z_max, count(*) AS total_points,
       'CF-1.8' AS conventions, 'Ocean Mapping Data - MBES' AS title, 'L2' AS processing_level, 'MBES' AS seabed2030_data_type,
       min(latitude) AS geospatial_lat_min, max(longitude) AS geospatial_lon_max, max(depth) AS geospatial_vertical_max,
       CAST(count(*) AS VARCHAR) AS points_attribute, true AS json_alike
FROM soundings_mbes GROUP BY survey_id""", ("soundings_mbes",))
def q_gattrs(spark, sf_dir):
    out = pr.trajectory_global_attrs(view(spark, sf_dir, "soundings_mbes"), "mbes", INFO)
    a = F.col("attributes")
    alike = F.from_json("attributes_json", "map<string,string>")
    same = F.map_filter(alike, lambda k, v: a[k] == v)
    return r6(out.withColumns({
        **{n: a[k] for n, k in (("conventions", "Conventions"), ("title", "title"), ("processing_level", "processing_level"),
                                ("seabed2030_data_type", "seabed2030_data_type"), ("points_attribute", "total_points"))},
        **{n: a[n].cast("double") for n in ("geospatial_lat_min", "geospatial_lon_max", "geospatial_vertical_max")},
        "json_alike": F.size(same) == F.size(a)}).drop("attributes", "attributes_json"))


register("trajectory_variables", """
SELECT survey_id, variable, CAST(CASE WHEN variable = 'depth' THEN lo WHEN variable IN ('beam_angle', 'latitude') THEN -90
                                      WHEN variable = 'longitude' THEN -180 WHEN variable = 'quality' THEN 0 END AS DOUBLE) AS valid_min,
       CAST(CASE WHEN variable = 'depth' THEN hi WHEN variable IN ('beam_angle', 'latitude') THEN 90
                 WHEN variable = 'longitude' THEN 180 WHEN variable = 'quality' THEN 100 END AS DOUBLE) AS valid_max
FROM (SELECT survey_id, min(depth) AS lo, max(depth) AS hi,
             unnest(['time', 'latitude', 'longitude', 'depth', 'quality', 'beam_angle']) AS variable FROM soundings_mbes GROUP BY survey_id)""",
         ("soundings_mbes",))(
    lambda spark, sf_dir: r6(pr.trajectory_variables(view(spark, sf_dir, "soundings_mbes"), "mbes").select(
        "survey_id", "variable", *[F.col("attributes")[k].cast("double").alias(k) for k in ("valid_min", "valid_max")])))


@register("validate_trajectory", """
SELECT survey_id, CAST([] AS VARCHAR[]) AS missing_attributes, true AS valid FROM soundings_mbes GROUP BY survey_id""", ("soundings_mbes",))
def q_validate_traj(spark, sf_dir):
    """Write the trajectory product, read it back, check variables + attributes."""
    s = view(spark, sf_dir, "soundings_mbes")
    path = scratch_table_path(spark, f"trajectory-{uuid.uuid4().hex}")
    pr.write_product(pr.trajectory_table(s, "mbes"), path)
    back = spark.read.parquet(path)
    back = back.withColumn("survey_id", F.col("survey_id").cast("long"))
    return pr.validate_trajectory(back, pr.trajectory_global_attrs(back, "mbes", INFO))


def _sink_grid_sql():
    from fathom.plans.oracle import sql_grid_cells, sql_with
    return sql_with(sql_grid_cells(res=0.001, depth_filter=False, src="points_lidar", z="elevation",
                                   where="latitude IS NOT NULL AND longitude IS NOT NULL"), """
SELECT c.survey_id, c.row, c.col, round(min(b.min_lat) + c.row * CAST(0.001 AS DOUBLE), 6) AS lat,
       round(min(b.min_lon) + c.col * CAST(0.001 AS DOUBLE), 6) AS lon,
       round(CAST(avg(CAST(CAST(z AS VARCHAR) AS DECIMAL(38,18))) AS DOUBLE), 6) AS elevation,
       CAST(1.0 AS DOUBLE) AS uncertainty, count(*) AS density
FROM cells c JOIN b ON c.survey_id = b.survey_id GROUP BY c.survey_id, c.row, c.col""")


@register("sink_attributed_grid", _sink_grid_sql(), ("points_lidar",))
def q_sink_grid(spark, sf_dir):
    """Write the attributed grid partitioned by survey and read it back."""
    g = attributed_grid(view(spark, sf_dir, "points_lidar"), "lidar", 0.001, "mean")
    path = scratch_table_path(spark, f"grid-{uuid.uuid4().hex}")
    pr.write_product(g, path)
    return r6(spark.read.parquet(path).withColumn("survey_id", F.col("survey_id").cast("long")))


def _grid_meta_sql():
    from fathom.plans.oracle import sql_grid_cells, sql_with
    return sql_with(sql_grid_cells(res=0.001, depth_filter=False, src="points_lidar", z="elevation",
                            where="latitude IS NOT NULL"), """
SELECT b.survey_id, b.valid_points AS total_points, c.populated_cells, b.min_lat, b.max_lat, b.min_lon, b.max_lon, e.lo AS min_elevation, e.hi AS max_elevation,
       '1.6' AS format_version, 'WGS84' AS coordinate_system, 'Mean Sea Level' AS vertical_datum, 'meters' AS elevation_units,
       'points_per_cell' AS density_units, false AS qc_applied
FROM b JOIN (SELECT survey_id, min(elevation) AS lo, max(elevation) AS hi FROM points_lidar GROUP BY survey_id) e ON b.survey_id = e.survey_id
JOIN (SELECT survey_id, count(DISTINCT (row, col)) AS populated_cells FROM cells GROUP BY survey_id) c
  ON b.survey_id = c.survey_id""")


register("grid_metadata", _grid_meta_sql(), ("points_lidar",))(lambda spark, sf_dir: _grid_meta(spark, sf_dir))


def _grid_meta(spark, sf_dir):
    pts = view(spark, sf_dir, "points_lidar")
    g = attributed_grid(pts, "lidar", 0.001, "mean")
    m = pr.grid_metadata(g, pts, "lidar", None, INFO)
    ends = [F.col(f"{c}_range")[i].alias(f"{n}_{a}") for c, a in (("latitude", "lat"), ("longitude", "lon"), ("elevation", "elevation"))
            for i, n in enumerate(("min", "max"))]
    return m.select("survey_id", "total_points", "populated_cells", *ends, "format_version", "coordinate_system", "vertical_datum",
                    F.col("units")["elevation"].alias("elevation_units"), F.col("units")["density"].alias("density_units"), "qc_applied")


register("raster_tags", """
SELECT survey_id, count(*) AS total_points, CAST(0.0 AS DOUBLE) AS quality_score, CAST(0 AS BIGINT) AS total_anomalies,
       CAST(count(*) AS VARCHAR) AS tag_total_points, 'Float32' AS tag_datatype, 'LIDAR' AS tag_sensor,
       'fathom 0.1.0 False False' AS tag_processing
FROM points_lidar GROUP BY survey_id""", ("points_lidar",))(
    lambda spark, sf_dir: pr.raster_tags(view(spark, sf_dir, "points_lidar"), "lidar", None, 0.001, INFO)
    .select("survey_id", "total_points", "quality_score", "total_anomalies",
            F.col("tags")["TOTAL_POINTS"].alias("tag_total_points"),
            F.col("tags")["GDAL_DATATYPE"].alias("tag_datatype"), F.col("tags")["SENSOR_TYPE"].alias("tag_sensor"),
            F.concat_ws(" ", *[F.col("tags")[k] for k in ("PROCESSING_SOFTWARE", "PROCESSING_VERSION", "ANONYMIZATION", "ENVIRONMENTAL_OVERLAY")])
            .alias("tag_processing")))


@register("sink_dispatch", """
SELECT output_format, count(*) AS jobs,
       CASE output_format WHEN 'netcdf' THEN 'trajectory' WHEN 'bag' THEN 'attributed_grid' WHEN 'geotiff' THEN 'raster_bands' END AS product
FROM jobs GROUP BY output_format""", ("jobs",))
def q_sink_dispatch(spark, sf_dir):
    """Each job's output format mapped to the product it produces."""
    j = view(spark, sf_dir, "jobs")
    m = F.create_map(*[x for k, v in pr.SINKS.items() for x in (F.lit(k), F.lit(v))])
    return j.groupBy("output_format").agg(F.count(F.lit(1)).alias("jobs")).withColumn("product", m[F.col("output_format")])


def _qc_report_sql():
    from fathom.plans.oracle import sql_rule_anomalies
    return f"""
SELECT survey_id, count(*) AS total_anomalies, greatest(0, count(*) - 10) AS more_anomalies,
       CAST(least(count(*), 10) AS INT) AS shown
FROM ({sql_rule_anomalies('soundings_mbes', 'mbes')}) a GROUP BY survey_id"""


@register("sink_qc_report", _qc_report_sql(), ("soundings_mbes",))
def q_qc_report(spark, sf_dir):
    """QC report per survey (summary + first 10 anomalies + "N more"), written as JSON and read back."""
    from fathom.operators import rules as rl
    from fathom.sinks.reports import qc_report
    s = view(spark, sf_dir, "soundings_mbes")
    rep = qc_report(sc.qc_summary(s, "mbes", "manual"), rl.rule_anomalies(s, "mbes"), "mbes", 10)
    path = scratch_table_path(spark, f"qc-report-{uuid.uuid4().hex}")
    rep.write.mode("overwrite").json(path)
    return spark.read.json(path).select("survey_id", "total_anomalies", "more_anomalies",
                                        F.size("first_anomalies").alias("shown"))

# ------------------------------------------------------------ submission


def _product_files(spark, sf_dir):
    """Write the trajectory product of the mbes view and list its real files."""
    s = view(spark, sf_dir, "soundings_mbes")
    path = scratch_table_path(spark, f"traj-files-{uuid.uuid4().hex}")
    pr.write_product(pr.trajectory_table(s, "mbes"), path)
    return sb.product_files(spark, path).withColumn("survey_id", F.col("survey_id").cast("long"))


def _payloads(spark, sf_dir, files=None):
    s = view(spark, sf_dir, "soundings_mbes")
    cat = sb.survey_catalog(s, "mbes", sc.qc_summary(s, "mbes", "auto"))
    files = files if files is not None else _product_files(spark, sf_dir)
    return sb.payloads(cat, sb.survey_file_entries(files), INFO, anonymized=True, overlay="environment")


def _qc_sql():
    from fathom.plans.q_qc import _qc_summary_sql
    return _qc_summary_sql("soundings_mbes", "mbes")


register("payload_metadata", f"""
WITH q AS ({_qc_sql()})
SELECT s.survey_id, 'Ocean Mapping Data' AS title, min(latitude) AS min_lat, max(latitude) AS max_lat,
       min(longitude) AS min_lon, max(longitude) AS max_lon, any_value(q.quality_score) AS quality_score,
       any_value(q.total_anomalies) AS anomaly_count, any_value(q.status) AS qc_status,
       strftime(min(timestamp), '%Y-%m-%dT%H:%M:%SZ') AS start_time
FROM soundings_mbes s JOIN q ON s.survey_id = q.survey_id GROUP BY s.survey_id""", ("soundings_mbes",))(
    lambda spark, sf_dir: r6(_payloads(spark, sf_dir).select(
        "survey_id", F.col("metadata.title").alias("title"),
        F.col("metadata.spatial_coverage.coordinates")[0][0][1].alias("min_lat"),
        F.col("metadata.spatial_coverage.coordinates")[0][2][1].alias("max_lat"),
        F.col("metadata.spatial_coverage.coordinates")[0][0][0].alias("min_lon"),
        F.col("metadata.spatial_coverage.coordinates")[0][2][0].alias("max_lon"),
        F.col("metadata.data_quality.quality_score").alias("quality_score"),
        F.col("metadata.data_quality.anomaly_count").alias("anomaly_count"),
        F.col("metadata.data_quality.qc_status").alias("qc_status"),
        F.col("metadata.temporal_coverage.start").alias("start_time"))))

register("payload")(lambda spark, sf_dir: _payloads(spark, sf_dir).select(
    "survey_id", "submission_id", F.to_json(F.struct("*")).alias("payload_json")))

@register("manifest")
def q_manifest(spark, sf_dir):
    """Manifest per submission listing every real file of the written product (rows-only)."""
    files = _product_files(spark, sf_dir)
    return sb.manifest(_payloads(spark, sf_dir, files), RUN_TS, files).select(
        "submission_id", "manifest_version", F.size("files").alias("n_files"), F.to_json("files").alias("files_json"))

register("spatial_coverage", """
SELECT survey_id, min(longitude) AS lon0, min(latitude) AS lat0, max(longitude) AS lon2, max(latitude) AS lat2,
       min(longitude) AS lon4, min(latitude) AS lat4 FROM soundings_nav GROUP BY survey_id""", ("soundings_nav",))(
    lambda spark, sf_dir: view(spark, sf_dir, "soundings_nav").groupBy("survey_id").agg(
        sb.spatial_coverage(F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")).alias("r"))
    .select("survey_id", F.col("r")[0][0][0].alias("lon0"), F.col("r")[0][0][1].alias("lat0"),
            F.col("r")[0][2][0].alias("lon2"), F.col("r")[0][2][1].alias("lat2"),
            F.col("r")[0][4][0].alias("lon4"), F.col("r")[0][4][1].alias("lat4")))

register("submission_id", """
SELECT survey_id, 'SB2030_20240101_000000_' || substr(md5('20240101_000000_' || CAST(survey_id AS VARCHAR)), 1, 8)
       AS submission_id FROM (SELECT DISTINCT survey_id FROM soundings_mbes) s""", ("soundings_mbes",))(
    lambda spark, sf_dir: view(spark, sf_dir, "soundings_mbes").select("survey_id").distinct()
    .select("survey_id", sb.submission_id(RUN_TS, F.col("survey_id")).alias("submission_id")))

register("validate_payload", """
SELECT DISTINCT survey_id, 'valid' AS status, CAST(7 AS INT) AS n_checks FROM soundings_mbes""", ("soundings_mbes",))(
    lambda spark, sf_dir: sb.validate_payload(_payloads(spark, sf_dir)).select(
        "survey_id", "status", F.size("checks").alias("n_checks")))

register("submission_warnings", f"""
WITH q AS ({_qc_sql()})
SELECT survey_id, concat_ws('|',
  'No API key provided - upload will fail in production',
  'Data has been anonymized - original vessel information is not available',
  'Environmental overlay applied - verify overlay data accuracy',
  CASE WHEN quality_score < 0.7 THEN printf('Low quality score (%.2f) - consider data review', quality_score) END,
  CASE WHEN total_anomalies > 100 THEN printf('High anomaly count (%d) - consider data review', total_anomalies) END)
  AS warnings FROM q""", ("soundings_mbes",))(
    lambda spark, sf_dir: sb.warnings(_payloads(spark, sf_dir)).select(
        "survey_id", F.array_join("warnings", "|").alias("warnings")))

register("submission_report", f"""
WITH q AS ({_qc_sql()})
SELECT survey_id, 'valid' AS status, 'dry_run_completed' AS dry_run_status,
       CAST(3 + (quality_score < 0.7)::INT + (total_anomalies > 100)::INT AS INT) AS n_warnings FROM q""",
         ("soundings_mbes",))(
    lambda spark, sf_dir: sb.submission_report(_payloads(spark, sf_dir)).select(
        "survey_id", "status", "dry_run_status", F.size("warnings").alias("n_warnings")))

register("file_checksum", """
SELECT doc_id, sha256(text) AS checksum, CAST(octet_length(encode(text)) AS BIGINT) AS file_size_bytes FROM documents""")(
    lambda spark, sf_dir: view_table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(F.col("text"), 256).alias("checksum"),
        F.octet_length(F.col("text")).cast("long").alias("file_size_bytes")))


def view_table(spark, sf_dir, name):
    from fathom.plans.views import table
    return table(spark, sf_dir, name)

# --------------------------------------------------------------- jobs

register("jobs_health_counts", """
SELECT count(*) FILTER (WHERE status IN ('queued', 'processing')) AS active_jobs,
       count(*) FILTER (WHERE status = 'completed') AS completed_jobs,
       count(*) FILTER (WHERE status = 'failed') AS failed_jobs FROM jobs""", ("jobs",))(
    lambda spark, sf_dir: jb.health_counts(view(spark, sf_dir, "jobs")))

register("jobs_metrics", """
SELECT total, completed, failed, active,
       round(CASE WHEN completed + failed > 0 THEN completed / (completed + failed) * 100.0 ELSE 0.0 END, 2) AS success_rate
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
             count(*) FILTER (WHERE status = 'failed') AS failed,
             count(*) FILTER (WHERE status IN ('queued', 'processing')) AS active FROM jobs) t""", ("jobs",))(
    lambda spark, sf_dir: r6(jb.metrics(view(spark, sf_dir, "jobs"))))

register("jobs_queue", """
SELECT queued_jobs, processing_jobs, queued_jobs * 120 AS estimated_wait_seconds,
       round(queued_jobs * 120 / 60.0, 1) AS estimated_wait_minutes, 5 AS max_concurrent_jobs,
       greatest(0, 5 - processing_jobs) AS available_slots
FROM (SELECT count(*) FILTER (WHERE status = 'queued') AS queued_jobs,
             count(*) FILTER (WHERE status = 'processing') AS processing_jobs FROM jobs) t""", ("jobs",))(
    lambda spark, sf_dir: r6(jb.queue_status(view(spark, sf_dir, "jobs"))))

register("jobs_page", """
SELECT p.*, t.total, 100 + 50 < t.total AS has_more FROM (
  SELECT * FROM jobs WHERE status = 'completed' ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 100) p,
  (SELECT count(*) AS total FROM jobs WHERE status = 'completed') t""", ("jobs",))(
    lambda spark, sf_dir: jb.page(view(spark, sf_dir, "jobs"), "completed", 50, 100))

register("jobs_page_total", """
SELECT count(*) AS total, 0 + 50 < count(*) AS has_more FROM jobs WHERE status = 'failed'""", ("jobs",))(
    lambda spark, sf_dir: jb.page(view(spark, sf_dir, "jobs"), "failed", 50, 0)
    .select("total", "has_more").limit(1))

register("jobs_sorted", """
SELECT job_id, quality_score FROM jobs WHERE status = 'processing'""", ("jobs",))(
    lambda spark, sf_dir: jb.sorted_jobs(view(spark, sf_dir, "jobs"), "processing", "quality_score", True)
    .select("job_id", "quality_score"))

register("job_lookup", "SELECT * FROM jobs WHERE job_id = 42", ("jobs",))(
    lambda spark, sf_dir: jb.lookup(view(spark, sf_dir, "jobs"), 42))

register("job_cancel", """
SELECT job_id, CASE WHEN output_format = 'geotiff' AND status IN ('queued', 'processing') THEN 'cancelled' ELSE status END AS status,
       CASE WHEN output_format = 'geotiff' AND status IN ('queued', 'processing') THEN 'cancelled'
            WHEN output_format = 'geotiff' THEN 'rejected' ELSE 'unchanged' END AS outcome
FROM jobs""", ("jobs",))(
    lambda spark, sf_dir: jb.cancel(view(spark, sf_dir, "jobs"),
                                    view(spark, sf_dir, "jobs").where(F.col("output_format") == "geotiff"), RUN_TS)
    .select("job_id", "status", "outcome"))

register("jobs_map_summary", """
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'processing') AS processing,
       round(avg(quality_score) * 100.0, 1) AS avg_quality_pct,
       round(avg(n.latitude), 6) AS center_lat, round(avg(n.longitude), 6) AS center_lon
FROM jobs j LEFT JOIN soundings_nav n ON j.job_id = n.idx""", ("jobs", "soundings_nav"))(
    lambda spark, sf_dir: r6(jb.map_summary(
        view(spark, sf_dir, "jobs"),
        view(spark, sf_dir, "soundings_nav").select(F.col("idx").alias("job_id"), "latitude", "longitude"))))

register("job_duration", """
SELECT job_id, CASE WHEN duration_s IS NULL THEN 'In progress...'
                    ELSE CAST(duration_s // 60 AS VARCHAR) || 'm ' || CAST(duration_s % 60 AS VARCHAR) || 's' END AS duration
FROM jobs""", ("jobs",))(
    lambda spark, sf_dir: view(spark, sf_dir, "jobs").select(
        "job_id", jb.duration_text(F.col("created_at"),
                                   F.col("created_at") + F.make_interval(secs=F.col("duration_s"))).alias("duration")))

register("validate_job_params", """
SELECT job_id, CASE WHEN sensor_type IN ('mbes','sbes','lidar','singlebeam','auv') AND output_format IN ('netcdf','bag','geotiff')
                    AND CASE WHEN total_points % 3 = 0 THEN 'auto' WHEN total_points % 3 = 1 THEN 'manual' ELSE 'fast' END
                        IN ('auto','manual','skip') THEN true ELSE false END AS accepted
FROM jobs""", ("jobs",))(
    lambda spark, sf_dir: jb.validate_requests(view(spark, sf_dir, "jobs").withColumns({
        "qc_mode": F.when(F.col("total_points") % 3 == 0, "auto").when(F.col("total_points") % 3 == 1, "manual")
                    .otherwise("fast"),
        "input_exists": F.lit(True)})).select("job_id", "accepted"))

register("conversion_result", f"""
WITH q AS ({_qc_sql()})
SELECT s.survey_id, 'completed' AS status, count(*) AS data_points_processed, any_value(q.quality_score) AS quality_score,
       any_value(q.total_anomalies) AS anomaly_count, min(latitude) AS min_lat, max(latitude) AS max_lat,
       min(depth) AS min_depth, max(depth) AS max_depth
FROM soundings_mbes s JOIN q ON s.survey_id = q.survey_id GROUP BY s.survey_id""", ("soundings_mbes",))(
    lambda spark, sf_dir: _conversion(spark, sf_dir))


def _conversion(spark, sf_dir):
    s = view(spark, sf_dir, "soundings_mbes")
    q = sc.qc_summary(s, "mbes", "auto").select("survey_id", "quality_score", F.col("total_anomalies")
                                                .alias("anomaly_count"))
    e = st.extent(s).select("survey_id", "min_lat", "max_lat", "min_depth", "max_depth")
    n = s.groupBy("survey_id").agg(F.count(F.lit(1)).alias("data_points_processed"))
    return r6(join_null_safe(join_null_safe(n, q, ["survey_id"]), e, ["survey_id"]).withColumn("status", F.lit("completed")))


def _processing_sql():
    from fathom.plans.oracle import sql_grid_cells, sql_with
    return sql_with(sql_grid_cells(depth_filter=False, where="latitude IS NOT NULL AND longitude IS NOT NULL"), """
SELECT survey_id, 'drop_null_xyz' AS operation, count(*) AS input_size,
       count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND depth IS NOT NULL) AS output_size,
       round(count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND depth IS NOT NULL) / count(*), 6)
         AS efficiency
FROM soundings_mbes GROUP BY survey_id
UNION ALL
SELECT survey_id, 'grid_binning', count(*), count(DISTINCT (row, col)),
       round(count(DISTINCT (row, col)) / count(*), 6)
FROM cells GROUP BY survey_id""")


@register("processing_metrics", _processing_sql(), ("soundings_mbes",))
def q_processing(spark, sf_dir):
    """Per survey and operation: input rows, output rows, efficiency = out / in (0 without input)."""
    from fathom.operators import grid as gr
    s = view(spark, sf_dir, "soundings_mbes")
    xyz = s.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("input_size"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("depth").isNotNull())
        .alias("output_size")).withColumn("operation", F.lit("drop_null_xyz"))
    binned = gr.binned_points(s, "mbes", 0.01)
    grid = (binned.groupBy("survey_id").agg(F.count(F.lit(1)).alias("input_size"),
                                            F.count_distinct("row", "col").alias("output_size"))
                  .withColumn("operation", F.lit("grid_binning")))
    out = xyz.unionByName(grid)
    return r6(out.withColumn("efficiency", F.when(F.col("input_size") > 0, F.col("output_size") / F.col("input_size"))
                                            .otherwise(F.lit(0.0))))


# -------------------------------------------------------------- sources

_ALIAS_HEADERS = {"idx": "IDX", "survey_id": "survey_id", "timestamp": " Time ", "latitude": "LAT",
                  "longitude": "lng", "depth": "Z", "beam_angle": "Beam", "quality": "qual"}


def _write_survey_csv(spark, sf_dir, fmt="csv"):
    """Spark writes the mbes view as text files with aliased headers, one
    folder per survey (data derived from the given table)."""
    s = view(spark, sf_dir, "soundings_mbes").drop("vessel_id")
    s = s.withColumn("timestamp", fs.iso_text(F.col("timestamp")))
    renamed = s.select(*[F.col(c).alias(_ALIAS_HEADERS[c]) for c in s.columns])
    path = scratch_table_path(spark, f"scan-{fmt}-{uuid.uuid4().hex}")
    w = renamed.write.mode("overwrite")
    if fmt == "json":
        w.json(path)
    else:
        w.option("header", True).option("sep", "\t" if fmt == "txt" else ",").csv(path)
    return path


_SCAN_SQL = """
SELECT survey_id, idx, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, latitude, longitude, depth,
       beam_angle, quality FROM soundings_mbes"""


def _scan_out(df):
    return df.select(F.col("survey_id").cast("long").alias("survey_id"), "idx",
                     fs.iso_text(F.col("timestamp")).alias("timestamp"), "latitude", "longitude", "depth",
                     "beam_angle", "quality")


register("scan_mbes", _SCAN_SQL, ("soundings_mbes",))(
    lambda spark, sf_dir: _scan_out(fs.scan_surveys(spark, _write_survey_csv(spark, sf_dir), "mbes")))
register("scan_mbes_txt", _SCAN_SQL, ("soundings_mbes",))(
    lambda spark, sf_dir: _scan_out(fs.scan_surveys(spark, _write_survey_csv(spark, sf_dir, "txt"), "mbes", "txt")))
register("scan_nav_json", _SCAN_SQL, ("soundings_mbes",))(
    lambda spark, sf_dir: _scan_out(fs.scan_surveys(spark, _write_survey_csv(spark, sf_dir, "json"), "mbes", "json",
                                                      multiline=False)))


@register("scan_file_order", """
SELECT survey_id, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM (
  SELECT survey_id, row_number() OVER (PARTITION BY survey_id ORDER BY idx) - 1 AS pos FROM soundings_mbes) t
GROUP BY survey_id""", ("soundings_mbes",))
def q_file_order(spark, sf_dir):
    """Headerless comment-prefixed text without an index column: idx = position in file."""
    s = view(spark, sf_dir, "soundings_mbes").orderBy("survey_id", "idx")
    s = s.select("survey_id", fs.iso_text(F.col("timestamp")).alias("timestamp"), "latitude", "longitude", "depth")
    path = scratch_table_path(spark, f"scan-nohdr-{uuid.uuid4().hex}")
    s.repartition("survey_id").write.partitionBy("survey_id").option("header", False).csv(path)
    df = fs.scan_surveys(spark, path, "mbes", "csv", comment="#", header=False,
                         names=["timestamp", "latitude", "longitude", "depth"])
    return df.groupBy(F.col("survey_id").cast("long").alias("survey_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_pos"), F.max("idx").alias("last_pos"))


@register("validate_format_depth")
def q_sniff(spark, sf_dir):
    """Header sniffing over every written survey file (rows-only)."""
    path = _write_survey_csv(spark, sf_dir)
    return fs.sniff_format(fs.first_lines(spark, path + "/*.csv"), "mbes")


register("standardize_mbes", """
SELECT idx, survey_id, latitude, longitude, depth, beam_angle, quality FROM soundings_mbes""", ("soundings_mbes",))(
    lambda spark, sf_dir: fs.standardize(view(spark, sf_dir, "soundings_mbes").select(
        F.col("idx").alias("IDX"), F.col("survey_id").alias("Survey_ID"), F.col("latitude").alias(" lat"),
        F.col("longitude").alias("X"), F.col("depth").alias("z"), F.col("beam_angle").alias("ANGLE"),
        F.col("quality").alias("quality_factor")), "mbes"))

register("normalize_timestamp", """
SELECT idx, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS from_epoch
FROM (SELECT o_orderkey AS idx, o_orderdate FROM orders) o""")(
    lambda spark, sf_dir: view_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"),
        fs.iso_text(fs.normalize_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))).alias("iso"),
        fs.iso_text(fs.normalize_timestamp(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")))
        .alias("from_epoch")))


@register("file_catalog")
def q_catalog(spark, sf_dir):
    """File name, size, modification time of every written survey file (rows-only)."""
    return fs.file_catalog_with_columns(spark, _write_survey_csv(spark, sf_dir) + "/*.csv")


register("supported_formats")(
    lambda spark, sf_dir: fs.supported_formats(spark).join(
        view(spark, sf_dir, "jobs").groupBy("sensor_type").agg(F.count(F.lit(1)).alias("jobs")), "sensor_type", "left"))
