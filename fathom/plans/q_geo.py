"""Check queries: geo scalars, reprojection, anonymisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import geo, privacy as pv
from fathom.operators import privacy as ap
from fathom.operators.ordered import sequence
from fathom.operators.reproject import crs_profile, reproject_to_wgs84
from fathom.plans.catalog import r6, register
from fathom.plans.views import view

# Reference point of the geo checks (New York harbour, as in the reference demo).
REF_LAT, REF_LON = 40.7128, -74.0060

_HAV_SQL = """6371000.0 * (2 * asin(least(1.0, sqrt(sin((radians({lat2}) - radians({lat1})) / 2) * sin((radians({lat2}) - radians({lat1})) / 2)
  + cos(radians({lat1})) * cos(radians({lat2})) * sin((radians({lon2}) - radians({lon1})) / 2) * sin((radians({lon2}) - radians({lon1})) / 2)))))"""
_BEAR_SQL = """((degrees(atan2(sin(radians({lon2}) - radians({lon1})) * cos(radians({lat2})),
  cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2}) - radians({lon1}))))
  + 360.0) % 360.0)"""


def _hav(lat1, lon1, lat2, lon2):
    return _HAV_SQL.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


def _bear(lat1, lon1, lat2, lon2):
    return _BEAR_SQL.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


register("haversine", f"""
SELECT survey_id, idx, round({_hav(REF_LAT, REF_LON, 'latitude', 'longitude')}, 6) AS distance_m
FROM soundings_mbes""", ("soundings_mbes",))(
    lambda spark, sf_dir: r6(view(spark, sf_dir, "soundings_mbes").select(
        "survey_id", "idx", geo.haversine_m(F.lit(REF_LAT), F.lit(REF_LON), F.col("latitude"),
                                            F.col("longitude")).alias("distance_m"))))

register("bearing", f"""
SELECT survey_id, idx, round({_bear(REF_LAT, REF_LON, 'latitude', 'longitude')}, 6) AS bearing_deg
FROM soundings_mbes""", ("soundings_mbes",))(
    lambda spark, sf_dir: r6(view(spark, sf_dir, "soundings_mbes").select(
        "survey_id", "idx", geo.bearing_deg(F.lit(REF_LAT), F.lit(REF_LON), F.col("latitude"),
                                            F.col("longitude")).alias("bearing_deg"))))


@register("track_segments", f"""
SELECT survey_id, idx, round({_hav('prev_lat', 'prev_lon', 'latitude', 'longitude')}, 3) AS distance_m,
       round({_bear('prev_lat', 'prev_lon', 'latitude', 'longitude')}, 6) AS bearing_deg
FROM (SELECT survey_id, idx, latitude, longitude,
             lag(latitude) OVER (PARTITION BY survey_id ORDER BY timestamp NULLS FIRST, idx) AS prev_lat,
             lag(longitude) OVER (PARTITION BY survey_id ORDER BY timestamp NULLS FIRST, idx) AS prev_lon
      FROM soundings_nav) t""", ("soundings_nav",))
def q_track(spark, sf_dir):
    s = view(spark, sf_dir, "soundings_nav").select("survey_id", "idx", "timestamp", "latitude", "longitude")
    seq = sequence(s, ["survey_id"], ["timestamp", "idx"], lags=["latitude", "longitude"])
    a = (F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude"))
    # Distances in millimetres: near-antipodal fixes put asin close to 1, where
    # JVM and C math libraries differ below that precision.
    return r6(seq.select("survey_id", "idx",
                         (F.round(geo.haversine_m(*a) * F.lit(1e3)) / F.lit(1e3)).alias("distance_m"),
                         geo.bearing_deg(*a).alias("bearing_deg")))


register("utm_zone", """
SELECT survey_id, idx, 'EPSG:' || CAST(CASE WHEN longitude >= 0 THEN 32600 ELSE 32700 END
       + CAST(trunc((longitude + 180.0) / 6.0) AS INT) + 1 AS VARCHAR) AS epsg
FROM soundings_nav""", ("soundings_nav",))(
    lambda spark, sf_dir: view(spark, sf_dir, "soundings_nav").select(
        "survey_id", "idx", geo.utm_epsg(F.col("longitude")).alias("epsg")))

register("utm_zone_by_latitude", """
SELECT survey_id, idx, 'EPSG:' || CAST(CASE WHEN latitude >= 0 THEN 32600 ELSE 32700 END
       + least(CAST(trunc((longitude + 180.0) / 6.0) AS INT) + 1, 60) AS VARCHAR) AS epsg
FROM soundings_nav""", ("soundings_nav",))(
    lambda spark, sf_dir: view(spark, sf_dir, "soundings_nav").select(
        "survey_id", "idx", geo.utm_epsg(F.col("longitude"), F.col("latitude"), "latitude").alias("epsg")))

_PROFILE_SQL = """
SELECT survey_id, lat_min, lat_max, lon_min, lon_max,
       coalesce(lat_max - lat_min <= 180 AND lon_max - lon_min <= 360 AND lat_min >= -90 AND lat_max <= 90
                AND lon_min >= -180 AND lon_max <= 180, false) AS is_wgs84,
       CASE WHEN lat_max - lat_min <= 180 AND lon_max - lon_min <= 360 THEN 'EPSG:4326'
            WHEN lat_max - lat_min > 1000 AND lon_max - lon_min > 1000 THEN 'EPSG:32633' ELSE 'EPSG:4326' END AS source_crs
FROM (SELECT survey_id, min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min,
             max(longitude) AS lon_max FROM {v} GROUP BY survey_id) p"""

register("detect_crs", _PROFILE_SQL.format(v="soundings_utm"), ("soundings_utm",))(
    lambda spark, sf_dir: r6(crs_profile(view(spark, sf_dir, "soundings_utm"))))
register("is_wgs84", _PROFILE_SQL.format(v="soundings_mbes"), ("soundings_mbes",))(
    lambda spark, sf_dir: r6(crs_profile(view(spark, sf_dir, "soundings_mbes"))))


def _utm_inverse_sql(e: str, n: str, zone: int = 33) -> tuple[str, str]:
    k0a = geo.UTM_K0 * geo._A
    xi, eta = f"(({n}) / {k0a!r})", f"(({e}) - 500000.0) / {k0a!r}"
    xi_p, eta_p = xi, f"({eta})"
    for j, b in enumerate(geo._BETA, start=1):
        xi_p += f" - {b!r} * sin({2 * j}.0 * {xi}) * cosh({2 * j}.0 * {eta})"
        eta_p += f" - {b!r} * cos({2 * j}.0 * {xi}) * sinh({2 * j}.0 * {eta})"
    chi = f"asin(sin({xi_p}) / cosh({eta_p}))"
    phi = chi + "".join(f" + {d!r} * sin({2 * j}.0 * {chi})" for j, d in enumerate(geo._DELTA, start=1))
    lam = f"{geo.central_meridian(zone)}.0 + degrees(atan2(sinh({eta_p}), cos({xi_p})))"
    return f"degrees({phi})", lam


_LAT, _LON = _utm_inverse_sql("longitude", "latitude")
register("reproject", f"""
SELECT survey_id, idx, round({_LAT}, 6) AS latitude, round({_LON}, 6) AS longitude FROM soundings_utm""",
         ("soundings_utm",))(
    lambda spark, sf_dir: r6(reproject_to_wgs84(view(spark, sf_dir, "soundings_utm"))
                             .select("survey_id", "idx", "latitude", "longitude")))

register("reproject_noop", """
SELECT survey_id, idx, latitude, longitude FROM soundings_mbes""", ("soundings_mbes",))(
    lambda spark, sf_dir: r6(reproject_to_wgs84(view(spark, sf_dir, "soundings_mbes"))
                             .select("survey_id", "idx", "latitude", "longitude")))

# ------------------------------------------------------------- privacy

_H = "'VESSEL_' || upper(substr(sha256(CAST({c} AS VARCHAR) || '_default_salt'), 1, 8))"

register("hash_vessel_id", f"""
SELECT vessel_key, {_H.format(c='vessel_id')} AS vessel_id, {_H.format(c='vessel_name')} AS vessel_name
FROM vessels""", ("vessels",))(
    lambda spark, sf_dir: view(spark, sf_dir, "vessels").select(
        "vessel_key", pv.hash_vessel_id(F.col("vessel_id")).alias("vessel_id"),
        pv.hash_vessel_id(F.col("vessel_name")).alias("vessel_name")))

register("hash_vessel_demo", """
SELECT vessel_key, substr(sha256(vessel_id || 'default_salt'), 1, 16) AS vessel_hash FROM vessels""",
         ("vessels",))(
    lambda spark, sf_dir: view(spark, sf_dir, "vessels").select(
        "vessel_key", pv.hash_demo(F.col("vessel_id")).alias("vessel_hash")))

register("anonymize_identifiers", f"""
SELECT {_H.format(c='survey_id')} AS survey_id, idx, {_H.format(c='vessel_id')} AS vessel_id, depth
FROM soundings_mbes""", ("soundings_mbes",))(
    lambda spark, sf_dir: ap.anonymize(view(spark, sf_dir, "soundings_mbes"))
    .select("survey_id", "idx", "vessel_id", "depth"))

register("vessel_mapping", f"""
SELECT DISTINCT hashed, original FROM (
  SELECT {_H.format(c='vessel_id')} AS hashed, vessel_id AS original FROM vessels
  UNION ALL SELECT {_H.format(c='vessel_name')}, vessel_name FROM vessels) m""", ("vessels",))(
    lambda spark, sf_dir: ap.vessel_mapping(view(spark, sf_dir, "vessels")))


@register("vessel_mapping_positional", f"""
SELECT DISTINCT hashed, original FROM (
  SELECT {_H.format(c='vessel_id')} AS hashed, vessel_id AS original FROM soundings_mbes
  UNION ALL SELECT {_H.format(c='survey_id')}, CAST(survey_id AS VARCHAR) FROM soundings_mbes) m""",
          ("soundings_mbes",))
def q_positional(spark, sf_dir):
    s = view(spark, sf_dir, "soundings_mbes").select("survey_id", "idx", "vessel_id")
    anon = ap.anonymize(s).withColumnRenamed("survey_id", "survey_id_h")
    orig = s.withColumn("survey_id_h", ap.hash_vessel_id(F.col("survey_id")))
    # Row identity = (hashed survey, idx); the mapping covers vessel_id and survey_id.
    m1 = ap.positional_mapping(orig.select("survey_id_h", "idx", "vessel_id"),
                               anon.select("survey_id_h", "idx", "vessel_id"), ["survey_id_h", "idx"])
    m2 = orig.select(F.col("survey_id_h").alias("hashed"), F.col("survey_id").cast("string").alias("original"))
    return m1.unionByName(m2).distinct()


@register("deanonymize_join", """
SELECT vessel_key, vessel_id, vessel_name FROM vessels""", ("vessels",))
def q_deanon(spark, sf_dir):
    v = view(spark, sf_dir, "vessels")
    return ap.deanonymize(ap.anonymize(v), ap.vessel_mapping(v)).select("vessel_key", "vessel_id", "vessel_name")


register("validate_anonymization", """
SELECT survey_id, bool_and(starts_with(vessel_id, 'VESSEL_')) AS is_anonymized FROM (
  SELECT 'VESSEL_' || upper(substr(sha256(CAST(survey_id AS VARCHAR) || '_default_salt'), 1, 8)) AS survey_id,
         'VESSEL_' || upper(substr(sha256(vessel_id || '_default_salt'), 1, 8)) AS vessel_id FROM soundings_mbes) a
GROUP BY survey_id""", ("soundings_mbes",))(
    lambda spark, sf_dir: ap.validate_anonymization(ap.anonymize(view(spark, sf_dir, "soundings_mbes"))))


@register("gps_jitter")
def q_jitter(spark, sf_dir):
    """Rows flagged for jitter (quality above 50) move by at most 50 m; rows-only check."""
    s = view(spark, sf_dir, "soundings_mbes").withColumn("gps_jitter", F.col("quality") > 50)
    j = ap.anonymize(s)
    return j.select("survey_id", "idx", "latitude", "longitude", "gps_jitter_applied", "jitter_radius_meters")
