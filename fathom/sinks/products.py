"""Product tables and their metadata records, and the writers.

The reference writes one NetCDF / BAG / GeoTIFF file per input file; here a
product is a partitioned Parquet table (``partitionBy("survey_id")``) plus a
one-row-per-survey metadata table.  Binary codecs (NetCDF, HDF5/BAG, TIFF)
are not built; the content they carry is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.grid import z_column
from fathom.operators.joins import join_null_safe

# CF attributes of the trajectory variables.
CF_ATTRS = {
    "depth": {"long_name": "Depth below sea level", "units": "m",
              "standard_name": "sea_floor_depth_below_sea_level", "positive": "down",
              "coordinates": "latitude longitude"},
    "elevation": {"long_name": "Elevation above sea level", "units": "m", "standard_name": "surface_altitude",
                  "positive": "up", "coordinates": "latitude longitude"},
    "quality": {"long_name": "Signal quality indicator", "units": "1", "valid_min": 0, "valid_max": 100,
                "coordinates": "latitude longitude"},
    "beam_angle": {"long_name": "Beam angle from nadir", "units": "degrees", "valid_min": -90, "valid_max": 90,
                   "coordinates": "latitude longitude"},
    "intensity": {"long_name": "Backscatter intensity", "units": "dB", "coordinates": "latitude longitude"},
    "time": {"long_name": "Time", "standard_name": "time", "axis": "T"},
    "latitude": {"long_name": "Latitude", "standard_name": "latitude", "units": "degrees_north", "axis": "Y",
                 "valid_min": -90.0, "valid_max": 90.0},
    "longitude": {"long_name": "Longitude", "standard_name": "longitude", "units": "degrees_east", "axis": "X",
                  "valid_min": -180.0, "valid_max": 180.0},
}
REQUIRED_GLOBAL_ATTRS = ["Conventions", "title", "source", "seabed2030_compliant",
                         "geospatial_lat_min", "geospatial_lat_max", "geospatial_lon_min", "geospatial_lon_max"]
REQUIRED_TRAJECTORY_VARS = ["latitude", "longitude", "time"]
GRID_FORMAT_VERSION = "1.6"


@dataclass(frozen=True)
class ProductInfo:
    """Who made a product; all free text, set by the deployment."""
    software: str = "fathom"
    version: str = "0.1.0"
    institution: str = ""
    contact: str = ""
    license: str = "Apache-2.0"
    run_ts: str = "1970-01-01T00:00:00Z"


def trajectory_table(df: DataFrame, sensor: str) -> DataFrame:
    """The trajectory product: only canonical variables, CF attributes in the
    column metadata (Catalyst prunes everything else at the scan)."""
    z = z_column(df, sensor)
    cols = [F.col("survey_id"), F.col("timestamp").alias("time", metadata=CF_ATTRS["time"]),
            F.col("latitude").alias("latitude", metadata=CF_ATTRS["latitude"]),
            F.col("longitude").alias("longitude", metadata=CF_ATTRS["longitude"]),
            F.col(z).alias(z, metadata=CF_ATTRS[z])]
    cols += [F.col(c).alias(c, metadata=CF_ATTRS[c]) for c in ("quality", "beam_angle", "intensity")
             if c in df.columns]
    return df.select(*cols)


def trajectory_variables(df: DataFrame, sensor: str) -> DataFrame:
    """(survey_id, variable, attributes): the CF attributes of each variable of
    the trajectory product; depth and elevation have the range observed in the
    survey as valid_min and valid_max (none where all values are NULL)."""
    table = trajectory_table(df, sensor)
    z = z_column(df, sensor)
    ends = df.groupBy("survey_id").agg(F.min(z).cast("string").alias("valid_min"), F.max(z).cast("string").alias("valid_max"))

    def attributes(c: str) -> Column:
        fixed = F.create_map(*[F.lit(str(x)) for kv in CF_ATTRS[c].items() for x in kv])
        if c != z:
            return fixed
        seen = F.map_from_arrays(F.array(F.lit("valid_min"), F.lit("valid_max")), F.array("valid_min", "valid_max"))
        return F.map_concat(fixed, F.map_filter(seen, lambda _, v: v.isNotNull()))

    rows = F.array(*[F.struct(F.lit(c).alias("variable"), attributes(c).alias("attributes")) for c in table.columns if c in CF_ATTRS])
    return ends.withColumn("v", F.explode(rows)).select("survey_id", "v.variable", "v.attributes")


def _s(c: Column) -> Column:
    return c.cast("string")


def trajectory_global_attrs(df: DataFrame, sensor: str, info: ProductInfo = ProductInfo(),
                            anonymized: Column | bool = False, overlay: Column | bool = False) -> DataFrame:
    """Per survey: the global attribute record (CF-1.8 + programme fields +
    geospatial extent + counts), also as one JSON string."""
    z = z_column(df, sensor)
    agg = df.groupBy("survey_id").agg(
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
        F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.count(F.lit(1)).alias("total_points"))
    up = sensor.upper()
    an = anonymized if isinstance(anonymized, Column) else F.lit(str(bool(anonymized)))
    ov = overlay if isinstance(overlay, Column) else F.lit(str(bool(overlay)))
    attrs = F.create_map(
        F.lit("Conventions"), F.lit("CF-1.8"),
        F.lit("title"), F.lit(f"Ocean Mapping Data - {up}"),
        F.lit("summary"), F.lit(f"Processed ocean mapping data from {up} sensor"),
        F.lit("source"), F.lit(f"{info.software} v{info.version}"),
        F.lit("institution"), F.lit(info.institution),
        F.lit("seabed2030_compliant"), F.lit("true"), F.lit("seabed2030_version"), F.lit("1.0"),
        F.lit("seabed2030_data_type"), F.lit(up),
        F.lit("processing_software"), F.lit(info.software), F.lit("processing_version"), F.lit(info.version),
        F.lit("processing_date"), F.lit(info.run_ts), F.lit("processing_level"), F.lit("L2"),
        F.lit("quality_control_applied"), F.lit("true"),
        F.lit("anonymization_applied"), _s(an), F.lit("environmental_overlay"), _s(ov),
        F.lit("geospatial_lat_min"), _s(F.col("lat_min")), F.lit("geospatial_lat_max"), _s(F.col("lat_max")),
        F.lit("geospatial_lon_min"), _s(F.col("lon_min")), F.lit("geospatial_lon_max"), _s(F.col("lon_max")),
        F.lit("geospatial_vertical_min"), _s(F.col("z_min")), F.lit("geospatial_vertical_max"), _s(F.col("z_max")),
        F.lit("crs"), F.lit("EPSG:4326"),
        F.lit("total_points"), _s(F.col("total_points")),
        F.lit("license"), F.lit(info.license), F.lit("contact"), F.lit(info.contact))
    return agg.withColumn("attributes", attrs).withColumn("attributes_json", F.to_json(F.col("attributes")))


def validate_trajectory(product: DataFrame, attrs: DataFrame) -> DataFrame:
    """Per survey: valid iff the required attributes and variables are present."""
    cols = set(product.columns)
    vars_ok = all(v in cols for v in REQUIRED_TRAJECTORY_VARS) and ("depth" in cols or "elevation" in cols)
    missing = F.array_except(F.array(*[F.lit(a) for a in REQUIRED_GLOBAL_ATTRS]), F.map_keys("attributes"))
    return attrs.select("survey_id", missing.alias("missing_attributes"),
                        ((F.size(missing) == 0) & F.lit(vars_ok)).alias("valid"))


def grid_metadata(grid: DataFrame, points: DataFrame, sensor: str, qc: DataFrame | None = None,
                  info: ProductInfo = ProductInfo(), anonymized: bool = False, overlay: bool = False) -> DataFrame:
    """Per survey: the attributed-grid metadata record (format, datums, units,
    statistics, QC and processing flags)."""
    z = z_column(points, sensor)
    stats = points.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("total_points"),
        F.array(F.min("latitude"), F.max("latitude")).alias("latitude_range"),
        F.array(F.min("longitude"), F.max("longitude")).alias("longitude_range"),
        F.array(F.min(z), F.max(z)).alias(f"{z}_range"))
    cells = grid.groupBy("survey_id").agg(F.count(F.lit(1)).alias("populated_cells"))
    out = join_null_safe(stats, cells, ["survey_id"], "left")
    if qc is not None:
        out = join_null_safe(out, qc.select("survey_id", F.col("total_anomalies").alias("anomaly_count"), "quality_score"), ["survey_id"], "left")
    else:
        out = out.withColumns({"anomaly_count": F.lit(0).cast("long"), "quality_score": F.lit(0.0)})
    return out.withColumns({
        "format_version": F.lit(GRID_FORMAT_VERSION), "creation_date": F.lit(info.run_ts),
        "software": F.lit(f"{info.software} v{info.version}"), "sensor_type": F.lit(sensor.upper()),
        "coordinate_system": F.lit("WGS84"), "vertical_datum": F.lit("Mean Sea Level"),
        "horizontal_datum": F.lit("WGS84"),
        "units": F.create_map(F.lit("elevation"), F.lit("meters"), F.lit("uncertainty"), F.lit("meters"),
                              F.lit("density"), F.lit("points_per_cell")),
        "qc_applied": F.lit(qc is not None), "anonymized": F.lit(anonymized), "overlay_applied": F.lit(overlay)})


def raster_tags(points: DataFrame, sensor: str, qc: DataFrame | None = None, res: float = 0.001,
                info: ProductInfo = ProductInfo(), anonymized: bool = False, overlay: bool = False) -> DataFrame:
    """Per survey: the raster tag map (software, datums, flags, totals, quality)."""
    n = points.groupBy("survey_id").agg(F.count(F.lit(1)).alias("total_points"))
    if qc is not None:
        n = join_null_safe(n, qc.select("survey_id", "quality_score", "total_anomalies"), ["survey_id"], "left")
    else:
        n = n.withColumns({"quality_score": F.lit(0.0), "total_anomalies": F.lit(0).cast("long")})
    kv = {
        "TIFFTAG_SOFTWARE": F.lit(f"{info.software} v{info.version}"), "TIFFTAG_DATETIME": F.lit(info.run_ts),
        "TIFFTAG_COPYRIGHT": F.lit(f"{info.license} License"), "GDAL_DATATYPE": F.lit("Float32"),
        "GDAL_NODATA": F.lit("nan"), "SENSOR_TYPE": F.lit(sensor.upper()), "DATA_SOURCE": F.lit("Ocean Mapping"),
        "COORDINATE_SYSTEM": F.lit("WGS84"), "VERTICAL_DATUM": F.lit("Mean Sea Level"),
        "HORIZONTAL_DATUM": F.lit("WGS84"), "PROCESSING_SOFTWARE": F.lit(info.software),
        "PROCESSING_VERSION": F.lit(info.version), "PROCESSING_DATE": F.lit(info.run_ts), "QUALITY_CONTROL": F.lit("Applied" if qc is not None else "Skipped"),
        "ANONYMIZATION": F.lit(str(anonymized)), "ENVIRONMENTAL_OVERLAY": F.lit(str(overlay)),
        "TOTAL_POINTS": _s(F.col("total_points")), "GRID_RESOLUTION": F.lit(str(res)),
        "QUALITY_SCORE": _s(F.col("quality_score")), "ANOMALY_COUNT": _s(F.col("total_anomalies")),
        "BAND_1_DESCRIPTION": F.lit("Elevation/Depth"), "BAND_1_UNITS": F.lit("meters"),
        "BAND_2_DESCRIPTION": F.lit("Uncertainty"), "BAND_2_UNITS": F.lit("meters"),
        "BAND_3_DESCRIPTION": F.lit("Point Density"), "BAND_3_UNITS": F.lit("points_per_cell"),
    }
    return n.select("survey_id", "total_points", "quality_score", "total_anomalies",
                    F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)]).alias("tags"))


def write_product(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("survey_id",),
                  mode: str = "overwrite") -> str:
    """Write a product table as Parquet, partitioned so readers prune by survey."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


SINKS = {
    "netcdf": "trajectory",
    "bag": "attributed_grid",
    "geotiff": "raster_bands",
}


def sink_for(output_format: str) -> str:
    """The product a requested output format maps to (sink dispatch)."""
    if output_format not in SINKS:
        raise ValueError(f"Unsupported output format: {output_format}")
    return SINKS[output_format]
