"""Per-survey coordinate-system detection and reprojection to WGS84.

A survey's coordinate ranges decide (one small aggregate row per survey,
joined back, broadcast when small): already geographic -> untouched;
projected metres -> inverse UTM of the configured source zone (the reference
only ever detects zone 33 north, kept as the default).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.joins import join_surveys
from fathom.functions.geo import utm_to_wgs84_df

WGS84 = "EPSG:4326"


def crs_profile(df: DataFrame, source_zone: int = 33, north: bool = True) -> DataFrame:
    """Per survey: ranges, ``is_wgs84`` and the detected source CRS."""
    p = df.groupBy("survey_id").agg(
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"))
    lat_r = F.col("lat_max") - F.col("lat_min")
    lon_r = F.col("lon_max") - F.col("lon_min")
    small = (lat_r <= 180) & (lon_r <= 360)
    inside = ((F.col("lat_min") >= -90) & (F.col("lat_max") <= 90)
              & (F.col("lon_min") >= -180) & (F.col("lon_max") <= 180))
    projected_code = f"EPSG:{(32600 if north else 32700) + source_zone}"
    return p.withColumns({
        "is_wgs84": F.coalesce(small & inside, F.lit(False)),
        "source_crs": F.when(small, F.lit(WGS84))
                       .when((lat_r > 1000) & (lon_r > 1000), F.lit(projected_code))
                       .otherwise(F.lit(WGS84))})


def reproject_to_wgs84(df: DataFrame, source_zone: int = 33, north: bool = True) -> DataFrame:
    """latitude/longitude in WGS84 degrees; ``source_crs`` says what was done."""
    prof = crs_profile(df, source_zone, north).select("survey_id", "is_wgs84", "source_crs")
    j = join_surveys(df, prof)
    move = (~F.col("is_wgs84")) & (F.col("source_crs") != WGS84)
    j = j.withColumn("reprojected", move)
    out = utm_to_wgs84_df(j, "longitude", "latitude", source_zone, north, keep=~F.col("reprojected"))
    return out.drop("is_wgs84")
