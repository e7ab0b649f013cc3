"""Check queries: the conversion composition, stage metadata and the model hook
(SURVEY §2.3 stage_metadata, §2.6 qc_summary in context, §2.14)."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from fathom.operators.model import model_info, predict_anomalies
from fathom.operators.scoring import qc_summary
from fathom.plans.catalog import r6, register
from fathom.plans.convert import ConvertOptions, convert, stage_metadata
from fathom.plans.oracle import sql_rule_anomalies
from fathom.plans.views import view
from fathom.session import scratch_table_path
from fathom.sinks.products import ProductInfo

RUN_TS = "2024-01-01T00:00:00Z"


@register("stage_metadata", """
SELECT survey_id, count(*) AS total_points, true AS anonymized,
       max(latitude) - min(latitude) > 1000 AND max(longitude) - min(longitude) > 1000 AS reprojected,
       CASE WHEN max(latitude) - min(latitude) <= 180 AND max(longitude) - min(longitude) <= 360 THEN 'EPSG:4326'
            WHEN max(latitude) - min(latitude) > 1000 AND max(longitude) - min(longitude) > 1000 THEN 'EPSG:32633'
            ELSE 'EPSG:4326' END AS source_crs
FROM soundings_utm GROUP BY survey_id""", ("soundings_utm",))
def q_stage_metadata(spark, sf_dir):
    m = stage_metadata(view(spark, sf_dir, "soundings_utm"), ConvertOptions("mbes", info=ProductInfo(run_ts=RUN_TS)))
    return m.select("survey_id", "total_points", F.col("anonymization.applied").alias("anonymized"),
                    F.col("reprojection.applied").alias("reprojected"), F.col("reprojection.source_crs").alias("source_crs"))


def _conversion_sql():
    return f"""
SELECT s.survey_id, total_points, min_depth, max_depth, min_lat, max_lon, coalesce(a.n, 0) AS anomaly_count, 'completed' AS qc_status
FROM (SELECT survey_id, count(*) AS total_points, min(depth) AS min_depth, max(depth) AS max_depth, min(latitude) AS min_lat, max(longitude) AS max_lon
      FROM soundings_mbes GROUP BY survey_id) s
LEFT JOIN (SELECT survey_id, count(*) AS n FROM ({sql_rule_anomalies('soundings_mbes', 'mbes')}) r GROUP BY survey_id) a ON s.survey_id = a.survey_id"""


@register("conversion_record", _conversion_sql(), ("soundings_mbes",))
def q_conversion_record(spark, sf_dir):
    """The conversion record's extent and quality metrics (manual QC: rules only)."""
    s = view(spark, sf_dir, "soundings_mbes")
    m = stage_metadata(s, ConvertOptions("mbes", info=ProductInfo(run_ts=RUN_TS)), qc=qc_summary(s, "mbes", "manual"))
    c = F.col("conversion")
    return m.select("survey_id", "total_points", *[c["data_extent"][k].alias(k) for k in ("min_depth", "max_depth", "min_lat", "max_lon")],
                    *[c["quality_metrics"][k].alias(k) for k in ("anomaly_count", "qc_status")])


@register("convert")
def q_convert(spark, sf_dir):
    """Full conversion of the LiDAR view to an attributed grid, written and reported (rows-only)."""
    opts = ConvertOptions("lidar", output_format="bag", qc_mode="auto", anonymize=True, add_overlay=True,
                          info=ProductInfo(run_ts=RUN_TS))
    out = scratch_table_path(spark, f"convert-{uuid.uuid4().hex}")
    res = convert(view(spark, sf_dir, "points_lidar"), opts, out_dir=out)
    written = int(res["metrics"].get("output_rows", 0))
    return r6(res["result"]).withColumn("product_rows_written", F.lit(written).cast("long"))


def low_quality_model(pdf: pd.DataFrame) -> pd.DataFrame:
    """Flags soundings whose quality indicator is below 5."""
    hit = pdf[pdf["quality"] < 5]
    return pd.DataFrame({"survey_id": hit["survey_id"].astype("int64"), "idx": hit["idx"].astype("int64"),
                         "type": "low_quality", "severity": "low", "value": hit["quality"].astype(float),
                         "confidence": 1.0 - hit["quality"].astype(float) / 5.0,
                         "description": "quality below 5"})


@register("anomaly_model_api", """
SELECT survey_id, idx, 'low_quality' AS type, 'low' AS severity, quality AS value,
       round(1.0 - quality / 5.0, 6) AS confidence FROM soundings_mbes WHERE quality < 5""", ("soundings_mbes",))
def q_model(spark, sf_dir):
    s = view(spark, sf_dir, "soundings_mbes")
    a = predict_anomalies(s, low_quality_model, ["survey_id", "idx", "quality"])
    assert model_info(low_quality_model)["model_type"] == "low_quality_model"
    return r6(a.drop("description"))
