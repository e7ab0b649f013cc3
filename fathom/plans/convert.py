"""A survey conversion as one lazily planned set of DataFrames.

parse -> QC (rules [+ detector]) -> anonymise -> reproject -> surface ->
overlay -> product.  Every stage is a DataFrame transformation; nothing is
materialised between stages except where an operator cuts lineage itself.
Stage metadata is a per-survey table of structs (what the reference keeps in
a mutable dict).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fathom.operators import grid as gr
from fathom.operators import overlay as ov
from fathom.operators import privacy as ap
from fathom.operators import rules as rl
from fathom.operators import scoring as sc
from fathom.operators import surface as su
from fathom.operators.joins import join_null_safe
from fathom.operators.reproject import crs_profile, reproject_to_wgs84
from fathom.sinks import products as pr

SENSORS = ["mbes", "sbes", "lidar", "singlebeam", "auv"]
FORMATS = ["netcdf", "bag", "geotiff"]
QC_MODES = ["auto", "manual", "skip"]


@dataclass
class ConvertOptions:
    sensor: str
    output_format: str = "netcdf"
    qc_mode: str = "auto"
    anonymize: bool = True
    add_overlay: bool = False
    overlay: str = "environment"
    salt: str = "default_salt"
    resolution: float = gr.RESOLUTION
    surface_method: str = "nearest"
    info: pr.ProductInfo = field(default_factory=pr.ProductInfo)

    def validate(self) -> None:
        if self.sensor not in SENSORS:
            raise ValueError(f"Unsupported sensor type: {self.sensor}")
        if self.output_format not in FORMATS:
            raise ValueError(f"Unsupported output format: {self.output_format}")
        if self.qc_mode not in QC_MODES:
            raise ValueError(f"Unsupported QC mode: {self.qc_mode}")


def build_surface(df: DataFrame, sensor: str | None, res: float = gr.RESOLUTION,
                  method: str = "nearest") -> DataFrame:
    """Surface step: z column, valid points, grid, interpolation, with the
    generation metadata as a struct column.  Missing coordinates or z ->
    the input passes through unchanged (as the reference returns its input)."""
    z = "depth" if "depth" in df.columns else "elevation"
    if "latitude" not in df.columns or "longitude" not in df.columns or z not in df.columns:
        return df
    surf = su.surface_linear(df, res, z) if method == "linear" else su.surface_nearest(df, res, z)
    b = su.surface_bounds(df, res, z)
    meta = F.struct(F.lit(method).alias("method"), F.col("valid_points").alias("total_points"),
                    F.lit(res).alias("surface_resolution"),
                    F.struct("min_lon", "max_lon", "min_lat", "max_lat").alias("surface_bounds"))
    return join_null_safe(surf, b.select("survey_id", meta.alias("surface_generation")), ["survey_id"])


def stage_metadata(df: DataFrame, opts: ConvertOptions, files: DataFrame | None = None,
                   qc: DataFrame | None = None) -> DataFrame:
    """Per survey: anonymisation, reprojection, surface, overlay and
    conversion records (structs), stamped with the run timestamp.

    ``files`` (survey_id, file_size_bytes; several a survey add up) gives the
    input size, ``qc`` (see ``qc_summary``) the quality metrics; without them
    the size is NULL, the score and the count 0 and the status 'unknown'."""
    prof = crs_profile(df).select("survey_id", "is_wgs84", "source_crs")
    ext = (df.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("total_points"),
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        *[(f("depth").cast("double") if "depth" in df.columns else F.lit(0.0)).alias(n) for f, n in ((F.min, "min_depth"), (F.max, "max_depth"))]))
    if files is not None:
        ext = join_null_safe(ext, files.groupBy("survey_id").agg(F.sum("file_size_bytes").cast("long").alias("size")), ["survey_id"], "left")
    else:
        ext = ext.withColumn("size", F.lit(None).cast("long"))
    if qc is not None:
        ext = join_null_safe(ext, qc.select("survey_id", "quality_score", "total_anomalies", "status"), ["survey_id"], "left")
    else:
        ext = ext.withColumns({"quality_score": F.lit(0.0), "total_anomalies": F.lit(0).cast("long"), "status": F.lit(None).cast("string")})
    quality = F.struct(F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), F.coalesce("total_anomalies", F.lit(0).cast("long")).alias("anomaly_count"),
                       F.coalesce("status", F.lit("unknown")).alias("qc_status"))
    ts = F.lit(opts.info.run_ts)
    ovl = ov.overlay_metadata(opts.overlay, opts.info.run_ts) if opts.add_overlay else None
    return join_null_safe(ext, prof, ["survey_id"]).select(
        "survey_id", "total_points",
        F.struct(F.lit(opts.anonymize).alias("applied"), F.lit(bool(opts.salt)).alias("salt_used"),
                 F.lit(opts.anonymize).alias("vessel_ids_hashed"), F.lit(False).alias("gps_jittered"),
                 ts.alias("timestamp")).alias("anonymization"),
        F.struct((~F.col("is_wgs84") & (F.col("source_crs") != "EPSG:4326")).alias("applied"),
                 F.col("source_crs"), F.lit("EPSG:4326").alias("target_crs"),
                 F.lit("krueger_series").alias("method")).alias("reprojection"),
        F.struct(F.lit(opts.add_overlay).alias("applied"),
                 F.lit(ovl["plugin"] if ovl else None).cast("string").alias("plugin"),
                 F.lit(ovl["version"] if ovl else None).cast("string").alias("version")).alias("environmental_overlay"),
        F.struct(ts.alias("conversion_timestamp"), F.lit(opts.info.version).alias("software_version"),
                 F.col("size").alias("input_file_size_bytes"), F.lit("WGS84").alias("coordinate_system"),
                 F.struct("min_lat", "max_lat", "min_lon", "max_lon", "min_depth", "max_depth").alias("data_extent"),
                 quality.alias("quality_metrics")).alias("conversion"))


def convert(soundings: DataFrame, opts: ConvertOptions, out_dir: str | None = None) -> dict[str, DataFrame]:
    """Plan every stage of a conversion; write the product when ``out_dir`` is given.

    QC flags do not remove points: later stages use all soundings, as the
    reference does.  Returns the stage DataFrames and a per-survey result.
    """
    opts.validate()
    qc = sc.qc_summary(soundings, opts.sensor, opts.qc_mode)
    points = ap.anonymize(soundings, opts.salt) if opts.anonymize else soundings
    points = reproject_to_wgs84(points)
    surface = build_surface(points, opts.sensor, opts.resolution, opts.surface_method)
    if opts.add_overlay:
        points = ov.apply_overlay(points, opts.overlay)
    product_kind = pr.sink_for(opts.output_format)
    if product_kind == "trajectory":
        product = pr.trajectory_table(points, opts.sensor)
    else:
        bounds = gr.survey_grid_bounds(points, opts.resolution)
        g = gr.attributed_grid(points, opts.sensor, opts.resolution, bounds=bounds)
        if product_kind == "raster_bands":
            g = gr.raster_bands(gr.densify(g, bounds, opts.resolution))
        product = g
    metrics: dict = {}
    if out_dir:
        # Row counts of the written product are observed during the write
        # itself (no extra pass); the reference logs them per operation.
        obs = Observation(f"convert_{product_kind}")
        pr.write_product(product.observe(obs, F.count(F.lit(1)).alias("output_rows")),
                         f"{out_dir}/{product_kind}")
        metrics = dict(obs.get)
    # The run result is keyed by the original survey (the product carries the
    # hashed identifiers when anonymisation is on).
    counts = soundings.groupBy("survey_id").agg(F.count(F.lit(1)).alias("data_points_processed"))
    result = (join_null_safe(counts, qc.select("survey_id", "status", "quality_score", "total_anomalies"), ["survey_id"], "left")
                    .withColumns({"sensor_type": F.lit(opts.sensor), "output_format": F.lit(opts.output_format),
                                  "anonymized": F.lit(opts.anonymize), "overlay_applied": F.lit(opts.add_overlay)}))
    return {"qc": qc, "anomalies": rl.rule_anomalies(soundings, opts.sensor), "points": points,
            "surface": surface, "product": product, "result": result, "metrics": metrics}


def efficiency(input_rows: int, output_rows: int) -> float:
    """output / input rows of an operation, 0 when there is no input."""
    return output_rows / input_rows if input_rows > 0 else 0.0
