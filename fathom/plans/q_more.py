"""Check queries for the remaining SURVEY §2 keys: per-column environment
functions, message formats, set operations over fields, sensor unions,
the rule catalogue, more file scans and product validations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fathom.operators.joins import join_null_safe
from fathom.functions import environment as env
from fathom.operators import overlay as ov
from fathom.operators import rules as rl
from fathom.operators import submission as sb
from fathom.operators.detector import depth_sequence, jump_anomalies
from fathom.operators.grid import attributed_grid
from fathom.plans.catalog import r6, register
from fathom.plans.q_products import _payloads, q_file_order
from fathom.plans.views import view
from fathom.session import scratch_table_path
from fathom.sinks import products as pr
from fathom.sources import files as fs

# ----------------------------------------------------------- environment

_M = ("soundings_mbes",)
_PLUME = ("coalesce(latitude BETWEEN 40.0 AND 41.0 AND longitude BETWEEN -74.0 AND -73.0 AND depth > 100, false)")


def _mb(spark, sf_dir):
    return view(spark, sf_dir, "soundings_mbes")


def _plume():
    return env.plume_detected(F.col("latitude"), F.col("longitude"), F.col("depth"))


register("plume_detected", f"SELECT survey_id, idx, {_PLUME} AS plume_detected FROM soundings_mbes", _M)(
    lambda spark, sf_dir: _mb(spark, sf_dir).select("survey_id", "idx", _plume().alias("plume_detected")))
register("water_temperature", """
SELECT survey_id, idx, round(greatest(0.0, 20.0 - (latitude - 40.0) * 0.5 - depth * 0.01), 6) AS water_temperature
FROM soundings_mbes""", _M)(
    lambda spark, sf_dir: r6(_mb(spark, sf_dir).select(
        "survey_id", "idx", env.water_temperature(F.col("latitude"), F.col("depth")).alias("water_temperature"))))
register("habitat_type", """
SELECT survey_id, idx, CASE WHEN depth < 50 THEN 'shallow_water' WHEN depth < 200 THEN 'continental_shelf'
       WHEN depth < 1000 THEN 'continental_slope' ELSE 'deep_sea' END AS habitat_type FROM soundings_mbes""", _M)(
    lambda spark, sf_dir: _mb(spark, sf_dir).select("survey_id", "idx", env.habitat_type(F.col("depth"))
                                                    .alias("habitat_type")))
register("environmental_risk", f"""
SELECT survey_id, idx, CASE WHEN {_PLUME} THEN 'high' ELSE 'low' END AS environmental_risk FROM soundings_mbes""", _M)(
    lambda spark, sf_dir: _mb(spark, sf_dir).select("survey_id", "idx", env.environmental_risk(_plume())
                                                    .alias("environmental_risk")))
register("risk_factors", f"""
SELECT survey_id, idx, concat_ws('|', CASE WHEN {_PLUME} THEN 'plume_detected' END,
                                  CASE WHEN depth < 100 THEN 'shallow_water' END) AS risk_factors
FROM soundings_mbes""", _M)(
    lambda spark, sf_dir: _mb(spark, sf_dir).select(
        "survey_id", "idx", F.array_join(env.risk_factors(_plume(), F.col("depth")), "|").alias("risk_factors")))


class DepthBandOverlay(ov.OverlayPlugin):
    """Example user plugin: depth band in 100 m steps."""
    name = "DepthBand"
    version = "0.1.0"

    def apply(self, df, config=None):
        step = float((config or {}).get("step", 100.0))
        return df.withColumn("depth_band", F.floor(F.col("depth") / F.lit(step)).cast("int"))


@register("overlay_plugin_api")
def q_plugin(spark, sf_dir):
    """A user overlay registered by name and applied through the registry (rows-only)."""
    ov.register_overlay("depth_band", DepthBandOverlay())
    out = ov.apply_overlay(_mb(spark, sf_dir), "depth_band", {"step": 100})
    return (out.groupBy("survey_id", "depth_band").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("plugin", F.lit(ov.overlay_info("depth_band")["name"])))

# -------------------------------------------------------- message formats


@register("format_messages", """
SELECT survey_id, idx, 'Invalid latitude value: ' || CAST(latitude AS VARCHAR) AS description
FROM soundings_mbes WHERE latitude < -90 OR latitude > 90
UNION ALL SELECT survey_id, idx, 'Invalid depth value: ' || CAST(depth AS VARCHAR) || 'm'
FROM soundings_mbes WHERE depth < 0 OR depth > 12000
UNION ALL SELECT survey_id, idx, printf('Depth jump of %.2fm detected', diff) FROM (
  SELECT survey_id, idx, depth - lag(depth) OVER (PARTITION BY survey_id ORDER BY timestamp NULLS FIRST, idx) AS diff
  FROM soundings_mbes) s WHERE diff > 100 OR diff < -100""", _M)
def q_messages(spark, sf_dir):
    s = _mb(spark, sf_dir)
    r = rl.range_anomalies(s, "mbes", only=["latitude", "depth"]).select("survey_id", "idx", "description")
    j = jump_anomalies(depth_sequence(s)).select("survey_id", "idx", "description")
    return r.unionByName(j)

# ------------------------------------------------- set operations on fields

REQUIRED_JOB_FIELDS = ["created_at", "duration_s", "quality_score", "total_points"]


def _present(cols):
    return F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in cols]))


register("missing_set", """
SELECT job_id, concat_ws(',', CASE WHEN created_at IS NULL THEN 'created_at' END,
       CASE WHEN duration_s IS NULL THEN 'duration_s' END, CASE WHEN quality_score IS NULL THEN 'quality_score' END,
       CASE WHEN total_points IS NULL THEN 'total_points' END) AS missing FROM jobs""", ("jobs",))(
    lambda spark, sf_dir: view(spark, sf_dir, "jobs").select(
        "job_id", F.array_join(F.array_except(F.array(*[F.lit(c) for c in REQUIRED_JOB_FIELDS]),
                                              _present(REQUIRED_JOB_FIELDS)), ",").alias("missing")))

register("present_count", """
SELECT job_id, CAST((created_at IS NOT NULL)::INT + (duration_s IS NOT NULL)::INT + (quality_score IS NOT NULL)::INT
       + (total_points IS NOT NULL)::INT AS INT) AS present FROM jobs""", ("jobs",))(
    lambda spark, sf_dir: view(spark, sf_dir, "jobs").select(
        "job_id", F.size(F.array_intersect(F.array(*[F.lit(c) for c in REQUIRED_JOB_FIELDS]),
                                           _present(REQUIRED_JOB_FIELDS))).alias("present")))


@register("required_anti", """
SELECT job_id, 'duration_s' AS field FROM jobs WHERE duration_s IS NULL""", ("jobs",))
def q_required_anti(spark, sf_dir):
    j = view(spark, sf_dir, "jobs")
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_JOB_FIELDS]))
    return j.select("job_id", F.explode(absent).alias("field"))


@register("duplicate_semi", """
SELECT survey_id, idx FROM points_lidar p
WHERE EXISTS (SELECT 1 FROM (SELECT survey_id, timestamp FROM points_lidar GROUP BY survey_id, timestamp
                             HAVING count(*) > 1) d
              WHERE d.survey_id = p.survey_id AND d.timestamp IS NOT DISTINCT FROM p.timestamp)""", ("points_lidar",))
def q_dup_semi(spark, sf_dir):
    p = view(spark, sf_dir, "points_lidar")
    d = p.groupBy("survey_id", "timestamp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cond = (p["survey_id"] == d["survey_id"]) & p["timestamp"].eqNullSafe(d["timestamp"])
    return p.join(d, cond, "left_semi").select("survey_id", "idx")


@register("stats_broadcast_join", """
SELECT v.survey_id, v.idx, round((v.depth - s.mean) / s.std, 6) AS zscore
FROM soundings_mbes v JOIN (SELECT survey_id, avg(depth) AS mean, stddev_samp(depth) AS std FROM soundings_mbes
                            GROUP BY survey_id) s ON v.survey_id IS NOT DISTINCT FROM s.survey_id""", _M)
def q_zscore(spark, sf_dir):
    s = _mb(spark, sf_dir)
    st = rl.depth_stats(s)
    return r6(join_null_safe(s, st, ["survey_id"]).select(
        "survey_id", "idx", ((F.col("depth") - F.col("mean")) / F.col("std")).alias("zscore")))

# --------------------------------------------------------- sensor unions


def union_sensors(frames: dict):
    out = None
    for sensor, df in frames.items():
        d = df.withColumn("sensor_type", F.lit(sensor))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def _sensors(spark, sf_dir):
    return union_sensors({"mbes": _mb(spark, sf_dir).select("survey_id", "idx", "depth"),
                          "sbes": view(spark, sf_dir, "soundings_nav").select("survey_id", "idx", "depth"),
                          "lidar": view(spark, sf_dir, "points_lidar").select("survey_id", "idx", "elevation")})


register("union_sensors", """
SELECT sensor_type, survey_id, count(*) AS n, count(depth) AS n_depth, count(elevation) AS n_elevation FROM (
  SELECT 'mbes' AS sensor_type, survey_id, depth, NULL::DOUBLE AS elevation FROM soundings_mbes
  UNION ALL SELECT 'sbes', survey_id, depth, NULL FROM soundings_nav
  UNION ALL SELECT 'lidar', survey_id, NULL, elevation FROM points_lidar) u GROUP BY sensor_type, survey_id""",
         ("soundings_mbes", "soundings_nav", "points_lidar"))(
    lambda spark, sf_dir: _sensors(spark, sf_dir).groupBy("sensor_type", "survey_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("depth").alias("n_depth"), F.count("elevation").alias("n_elevation")))

register("depth_column_choice", """
SELECT 'mbes' AS sensor_type, survey_id, idx, depth AS z FROM soundings_mbes
UNION ALL SELECT 'sbes', survey_id, idx, depth FROM soundings_nav
UNION ALL SELECT 'lidar', survey_id, idx, elevation FROM points_lidar""",
         ("soundings_mbes", "soundings_nav", "points_lidar"))(
    lambda spark, sf_dir: _sensors(spark, sf_dir).select(
        "sensor_type", "survey_id", "idx",
        F.when(F.col("sensor_type") == "lidar", F.col("elevation")).otherwise(F.col("depth")).alias("z")))

# -------------------------------------------------------- rule catalogue

register("rule_catalog_check", """
SELECT survey_id, idx, "column", value, lo, hi FROM (
  SELECT survey_id, idx, 'latitude' AS "column", latitude AS value, -90.0 AS lo, 90.0 AS hi FROM soundings_mbes
  UNION ALL SELECT survey_id, idx, 'longitude', longitude, -180.0, 180.0 FROM soundings_mbes
  UNION ALL SELECT survey_id, idx, 'depth', depth, 0.0, 12000.0 FROM soundings_mbes) u
WHERE value < lo OR value > hi""".replace("-90.0 AS lo", "CAST(-90 AS DOUBLE) AS lo").replace(
    "90.0 AS hi", "CAST(90 AS DOUBLE) AS hi").replace("-180.0, 180.0", "CAST(-180 AS DOUBLE), CAST(180 AS DOUBLE)")
    .replace("0.0, 12000.0", "CAST(0 AS DOUBLE), CAST(12000 AS DOUBLE)"), _M)(
    lambda spark, sf_dir: rl.rule_catalog_check(_mb(spark, sf_dir), "mbes"))

register("validation_rules", """
SELECT survey_id, "column", count(*) AS violations FROM (
  SELECT survey_id, 'latitude' AS "column", latitude AS value FROM soundings_mbes WHERE latitude < -90 OR latitude > 90
  UNION ALL SELECT survey_id, 'longitude', longitude FROM soundings_mbes WHERE longitude < -180 OR longitude > 180
  UNION ALL SELECT survey_id, 'depth', depth FROM soundings_mbes WHERE depth < 0 OR depth > 6000) u
GROUP BY survey_id, "column\"""", _M)(
    lambda spark, sf_dir: rl.rule_catalog_check(_mb(spark, sf_dir), "auv")
    .groupBy("survey_id", "column").agg(F.count(F.lit(1)).alias("violations")))

# --------------------------------------------------------------- payload

register("payload_qc", f"""
WITH q AS ({__import__('fathom.plans.q_qc', fromlist=['x'])._qc_summary_sql('soundings_mbes', 'mbes')})
SELECT survey_id, true AS qc_applied, 'automated' AS qc_method, 6 AS n_rules, total_anomalies AS anomalies_found,
       quality_score FROM q""", _M)(
    lambda spark, sf_dir: r6(_payloads(spark, sf_dir).select(
        "survey_id", F.col("quality_control.qc_applied").alias("qc_applied"),
        F.col("quality_control.qc_method").alias("qc_method"),
        F.size("quality_control.qc_rules").alias("n_rules"),
        F.col("quality_control.anomaly_detection.anomalies_found").alias("anomalies_found"),
        F.col("quality_control.anomaly_detection.quality_score").alias("quality_score"))))

register("payload_provenance", """
SELECT DISTINCT survey_id, 'L2' AS processing_level, true AS anonymized, 'environment' AS overlay_plugin
FROM soundings_mbes""", _M)(
    lambda spark, sf_dir: _payloads(spark, sf_dir).select(
        "survey_id", F.col("provenance.processing_level").alias("processing_level"),
        F.col("provenance.anonymization.applied").alias("anonymized"),
        F.col("provenance.environmental_overlay.plugin").alias("overlay_plugin")))

register("payload_compliance", """
SELECT DISTINCT survey_id, true AS compliant, 'CF-1.8,NetCDF-4,WGS84' AS data_standards,
       'IHO S-44,Seabed 2030 QC Guidelines' AS quality_standards FROM soundings_mbes""", _M)(
    lambda spark, sf_dir: _payloads(spark, sf_dir).select(
        "survey_id", F.col("compliance.seabed2030_compliant").alias("compliant"),
        F.array_join("compliance.data_standards", ",").alias("data_standards"),
        F.array_join("compliance.quality_standards", ",").alias("quality_standards")))

# ------------------------------------------------------------------ scans


def _write_csv(spark, df, headers: dict, tag: str, partition: bool = False, header: bool = True):
    d = df.select(*[F.col(c).alias(headers.get(c, c)) for c in df.columns])
    path = scratch_table_path(spark, f"{tag}-{uuid.uuid4().hex}")
    w = d.write.mode("overwrite").option("header", header)
    (w.partitionBy(headers.get("survey_id", "survey_id")) if partition else w).csv(path)
    return path


_LIDAR_H = {"idx": "idx", "timestamp": "UTC", "latitude": "Northing", "longitude": "easting", "elevation": "Height",
            "intensity": "INT", "classification": "cls", "return_number": "ret"}
_NAV_H = {"idx": "idx", "timestamp": "epoch", "latitude": "lat", "longitude": "lng", "depth": "altitude",
          "heading": "HDG", "pitch": "pitch_angle", "roll": "roll_angle", "velocity": "speed", "quality": "signal_quality"}


def _lidar_csv(spark, sf_dir):
    v = view(spark, sf_dir, "points_lidar").withColumn("timestamp", fs.iso_text(F.col("timestamp")))
    return _write_csv(spark, v, _LIDAR_H, "scan-lidar")


register("scan_lidar", """
SELECT survey_id, idx, latitude, longitude, elevation, intensity, classification, return_number FROM points_lidar""",
         ("points_lidar",))(
    lambda spark, sf_dir: fs.scan_surveys(spark, _lidar_csv(spark, sf_dir), "lidar").select(
        F.col("survey_id").cast("long").alias("survey_id"), "idx", "latitude", "longitude", "elevation",
        "intensity", "classification", F.col("return_number")))


def _nav_csv(spark, sf_dir):
    v = view(spark, sf_dir, "soundings_nav").withColumn(
        "timestamp", F.unix_timestamp(F.col("timestamp").cast("timestamp")).cast("string"))
    return _write_csv(spark, v, _NAV_H, "scan-nav")


register("scan_nav", """
SELECT survey_id, idx, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, latitude, longitude, depth, heading,
       pitch, roll, velocity, quality FROM soundings_nav""", ("soundings_nav",))(
    lambda spark, sf_dir: fs.scan_surveys(spark, _nav_csv(spark, sf_dir), "auv").select(
        F.col("survey_id").cast("long").alias("survey_id"), "idx", fs.iso_text(F.col("timestamp")).alias("timestamp"),
        "latitude", "longitude", "depth", "heading", "pitch", "roll", "velocity", "quality"))

register("standardize_nav", """
SELECT idx, survey_id, latitude, longitude, depth, heading, velocity FROM soundings_nav""", ("soundings_nav",))(
    lambda spark, sf_dir: fs.standardize(view(spark, sf_dir, "soundings_nav").select(
        "idx", "survey_id", F.col("latitude").alias("Northing"), F.col("longitude").alias("EASTING"),
        F.col("depth").alias("z"), F.col("heading").alias("course"), F.col("velocity").alias("vel")), "sbes"))

register("standardize_lidar", """
SELECT idx, survey_id, latitude, longitude, elevation, classification, return_number AS number_of_returns
FROM points_lidar""",
         ("points_lidar",))(
    lambda spark, sf_dir: fs.standardize(view(spark, sf_dir, "points_lidar").select(
        "idx", "survey_id", F.col("latitude").alias("y"), F.col("longitude").alias("x"),
        F.col("elevation").alias("ALT"), F.col("classification").alias("class"),
        F.col("return_number").alias("nret")), "lidar"))

register("scan_comment_text", """
SELECT survey_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, latitude, longitude, depth
FROM soundings_mbes""", _M)(
    lambda spark, sf_dir: _comment_text(spark, sf_dir))


def _comment_text(spark, sf_dir):
    s = _mb(spark, sf_dir).select("survey_id", fs.iso_text(F.col("timestamp")).alias("timestamp"),
                                  "latitude", "longitude", "depth")
    path = _write_csv(spark, s, {}, "scan-text", partition=True, header=False)
    df = fs.scan_surveys(spark, path, "mbes", "csv", comment="#", header=False,
                         names=["timestamp", "latitude", "longitude", "depth"])
    return df.select(F.col("survey_id").cast("long").alias("survey_id"),
                     fs.iso_text(F.col("timestamp")).alias("timestamp"), "latitude", "longitude", "depth")


register("assign_index", """
SELECT survey_id, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM (
  SELECT survey_id, row_number() OVER (PARTITION BY survey_id ORDER BY idx) - 1 AS pos FROM soundings_mbes) t
GROUP BY survey_id""", _M)(q_file_order)


@register("scan_dispatch", """
SELECT 'mbes' AS sensor_type, survey_id, count(*) AS n FROM soundings_mbes GROUP BY survey_id
UNION ALL SELECT 'lidar', survey_id, count(*) FROM points_lidar GROUP BY survey_id""",
          ("soundings_mbes", "points_lidar"))
def q_dispatch(spark, sf_dir):
    from fathom.plans.q_products import _write_survey_csv
    paths = {"mbes": _write_survey_csv(spark, sf_dir), "lidar": _lidar_csv(spark, sf_dir)}
    frames = {s: fs.scan_surveys(spark, p, s).select(F.col("survey_id").cast("long").alias("survey_id"))
              for s, p in paths.items()}
    return union_sensors(frames).groupBy("sensor_type", "survey_id").agg(F.count(F.lit(1)).alias("n"))


@register("validate_format_lidar")
def q_sniff_lidar(spark, sf_dir):
    """Header sniffing of written LiDAR files (rows-only)."""
    return fs.sniff_format(fs.first_lines(spark, _lidar_csv(spark, sf_dir) + "/*.csv"), "lidar")


@register("validate_required_columns")
def q_required_cols(spark, sf_dir):
    """Missing required columns per written file header, after aliasing (rows-only)."""
    h = fs.first_lines(spark, _nav_csv(spark, sf_dir) + "/*.csv")
    aliases = fs.ALIASES["sbes"]
    amap = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
    cols = F.transform(F.split(F.col("header"), ","), lambda c: F.coalesce(amap[F.lower(F.trim(c))],
                                                                            F.lower(F.trim(c))))
    req = F.array(*[F.lit(c) for c in fs.REQUIRED["sbes"]])
    return h.select("path", F.array_except(req, cols).alias("missing"),
                    (F.size(F.array_except(req, cols)) == 0).alias("valid"))


@register("scan_metadata_json", """
SELECT survey_id, count(*) AS total_points, min(latitude) AS min_lat FROM soundings_mbes GROUP BY survey_id""", _M)
def q_meta_json(spark, sf_dir):
    cat = sb.survey_catalog(_mb(spark, sf_dir), "mbes")
    path = scratch_table_path(spark, f"meta-json-{uuid.uuid4().hex}")
    # One metadata document per survey folder, read back as whole JSON documents.
    cat.write.mode("overwrite").partitionBy("survey_id").json(path)
    back = fs.read_metadata_json(spark, path)
    return back.select(F.col("survey_id").cast("long").alias("survey_id"),
                       F.col("total_points").cast("long").alias("total_points"), "min_lat")


@register("scan_payload_json")
def q_payload_json(spark, sf_dir):
    """Payloads written as JSON and read back with the payload schema (rows-only)."""
    p = _payloads(spark, sf_dir)
    path = scratch_table_path(spark, f"payload-json-{uuid.uuid4().hex}")
    p.write.mode("overwrite").json(path)
    back = spark.read.schema(p.schema).json(path)
    return sb.validate_payload(back).select("survey_id", "status", F.size("checks").alias("n_checks"))

# -------------------------------------------------------- product writes


@register("sink_trajectory", """
SELECT 'mbes' AS sensor_type, survey_id, count(*) AS n, min(depth) AS depth_min FROM soundings_mbes GROUP BY survey_id""",
          _M)
def q_sink_traj(spark, sf_dir):
    t = pr.trajectory_table(_mb(spark, sf_dir), "mbes").withColumn("sensor_type", F.lit("mbes"))
    path = scratch_table_path(spark, f"traj-{uuid.uuid4().hex}")
    pr.write_product(t, path, ("sensor_type", "survey_id"))
    back = spark.read.parquet(path)
    return back.groupBy("sensor_type", F.col("survey_id").cast("long").alias("survey_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("depth").alias("depth_min"))


@register("validate_grid", """
SELECT survey_id, true AS non_empty, 3 AS bands, 'EPSG:4326' AS crs, true AS has_transform
FROM points_lidar WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY survey_id""", ("points_lidar",))
def q_validate_grid(spark, sf_dir):
    """Written attributed grid: non-empty, bands present, CRS/transform recorded."""
    g = attributed_grid(view(spark, sf_dir, "points_lidar"), "lidar", 0.001)
    path = scratch_table_path(spark, f"grid-v-{uuid.uuid4().hex}")
    pr.write_product(g, path)
    back = spark.read.parquet(path)
    bands = [c for c in ("elevation", "uncertainty", "density") if c in back.columns]
    return back.groupBy(F.col("survey_id").cast("long").alias("survey_id")).agg(
        (F.count(F.lit(1)) > 0).alias("non_empty"), F.lit(len(bands)).alias("bands"),
        F.lit("EPSG:4326").alias("crs"),
        (F.min("lat").isNotNull() & F.min("lon").isNotNull()).alias("has_transform"))
