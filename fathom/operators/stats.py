"""Per-survey descriptive statistics and parser metadata.

All are single hash aggregates on ``survey_id`` (partial + final, so a survey
holding most of the rows only grows a few accumulators).  NULLs are skipped,
as the reference skips NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.joins import join_null_safe
from pyspark.sql import types as T

# The columns each sensor's statistics describe.
STAT_COLUMNS = {
    "mbes": ["depth", "beam_angle"],
    "sbes": ["depth"],
    "singlebeam": ["depth"],
    "auv": ["depth"],
    "lidar": ["elevation"],
}

# Columns whose out-of-range count the parsers warn about.
PARSE_WARN_COLUMNS = {
    "mbes": ["latitude", "longitude", "depth", "beam_angle"],
    "sbes": ["latitude", "longitude", "depth", "heading", "pitch", "roll"],
    "lidar": ["latitude", "longitude", "elevation", "intensity", "classification"],
}

# Units recorded by each parser.
UNITS = {
    "mbes": {"latitude": "decimal_degrees", "longitude": "decimal_degrees", "depth": "meters",
             "beam_angle": "degrees"},
    "sbes": {"latitude": "decimal_degrees", "longitude": "decimal_degrees", "depth": "meters",
             "heading": "degrees", "pitch": "degrees", "roll": "degrees", "velocity": "m/s"},
    "lidar": {"latitude": "decimal_degrees", "longitude": "decimal_degrees", "elevation": "meters",
              "intensity": "0-255_scale", "classification": "integer_code"},
}
POSITION_UNITS = {"latitude": "decimal_degrees", "longitude": "decimal_degrees"}
PARSER_VERSION = "1.0.0"

_LONG = [("column", "string"), *[(c, "double") for c in ("min", "max", "mean", "std")]]
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _describe(c: str) -> list:
    return [F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max"),
            F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]


def sensor_statistics(df: DataFrame, sensor: str) -> DataFrame:
    """min / max / mean / sample std of the sensor's main columns."""
    cols = [c for c in STAT_COLUMNS.get(sensor, []) if c in df.columns]
    if sensor not in STAT_COLUMNS:
        return generic_statistics(df)
    if not cols:
        return df.select("survey_id").distinct()
    return df.groupBy("survey_id").agg(*[e for c in cols for e in _describe(c)])


def numeric_columns(df: DataFrame, exclude=("survey_id",)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def generic_statistics(df: DataFrame, exclude=("survey_id",)) -> DataFrame:
    """Statistics of every numeric column, long form (column, min, max, mean, std).

    One aggregate pass computes all columns; ``stack`` turns the wide row
    into long form afterwards (per survey, so it stays small).
    """
    cols = numeric_columns(df, exclude)
    if not cols:
        return df.select("survey_id", *[F.lit(None).cast(t).alias(c) for c, t in _LONG]).limit(0)
    wide = df.groupBy("survey_id").agg(*[e for c in cols for e in _describe(c)])
    args = ", ".join(f"'{c}', `{c}_min`, `{c}_max`, `{c}_mean`, `{c}_std`" for c in cols)
    long = wide.select("survey_id", F.expr(f"stack({len(cols)}, {args}) as (column, min, max, mean, std)"))
    return long.where(F.col("min").isNotNull())


def parse_warnings(df: DataFrame, sensor: str) -> DataFrame:
    """Per survey and column: number of out-of-range values (nothing dropped)."""
    from fathom.operators.rules import range_condition
    cols = [c for c in PARSE_WARN_COLUMNS.get("sbes" if sensor in ("singlebeam", "auv") else sensor, [])
            if c in df.columns]
    if not cols:
        return df.select("survey_id", F.lit(None).cast("string").alias("column"), F.lit(None).cast("long").alias("out_of_range")).limit(0)
    wide = df.groupBy("survey_id").agg(*[F.count_if(range_condition(c)).alias(c) for c in cols])
    args = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.select("survey_id", F.expr(f"stack({len(cols)}, {args}) as (column, out_of_range)"))


def _range(c: str):
    return F.array(F.min(c).cast("double"), F.max(c).cast("double"))


def parser_metadata(df: DataFrame, sensor: str) -> DataFrame:
    """The parser's metadata record per survey as a nested struct."""
    family = "sbes" if sensor in ("sbes", "singlebeam", "auv") else sensor
    ranges = {"mbes": ["latitude", "longitude", "depth", "beam_angle"],
              "sbes": ["latitude", "longitude", "depth"],
              "lidar": ["latitude", "longitude", "elevation"]}.get(family, ["latitude", "longitude"])
    aggs = [F.count(F.lit(1)).alias("total_points")]
    aggs += [_range(c).alias(f"{c}_range") for c in ranges if c in df.columns]
    if family == "sbes":
        aggs += [_range(c).alias(f"{c}_range") for c in ("heading", "pitch", "roll", "velocity")
                 if c in df.columns]
    if family in ("mbes", "sbes") and "quality" in df.columns:
        aggs += [F.avg("quality").alias("mean_quality"), F.min("quality").cast("double").alias("min_quality"),
                 F.max("quality").cast("double").alias("max_quality"),
                 F.stddev_samp("quality").alias("quality_std")]
    if family == "lidar" and "intensity" in df.columns:
        aggs += [_range("intensity").alias("intensity_range"), F.avg("intensity").alias("mean_intensity")]
    out = df.groupBy("survey_id").agg(*aggs)
    if family == "lidar":
        for c, name in (("classification", "classification_counts"), ("return_number", "return_number_distribution")):
            if c in df.columns:
                out = join_null_safe(out, value_count_map(df, c, name), ["survey_id"], "left")
    return out.withColumns({
        "parser_version": F.lit(PARSER_VERSION), "sensor_type": F.lit(family),
        "data_quality": F.lit("unknown"), "coordinate_system": F.lit("WGS84"),
        "units": F.create_map(*[x for k, v in UNITS.get(family, POSITION_UNITS).items() for x in (F.lit(k), F.lit(v))])})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Long-form value counts per survey (classification, return_number)."""
    return df.groupBy("survey_id", column).agg(F.count(F.lit(1)).alias("count"))


def value_count_map(df: DataFrame, column: str, name: str) -> DataFrame:
    """Value counts per survey as one map, values ascending; NULL values do not
    count.  Counts are summed first, so a map holds distinct values only."""
    counts = value_counts(df.where(F.col(column).isNotNull()), column)
    entries = F.array_sort(F.collect_list(F.struct(F.col(column), F.col("count"))))
    return counts.groupBy("survey_id").agg(F.map_from_entries(entries).alias(name))


def extent(df: DataFrame) -> DataFrame:
    """min/max latitude, longitude, depth; a missing column reports 0."""
    def mm(c):
        if c in df.columns:
            return [F.min(c).cast("double"), F.max(c).cast("double")]
        return [F.lit(0.0), F.lit(0.0)]
    (a, b), (c, d), (e, f) = mm("latitude"), mm("longitude"), mm("depth")
    return df.groupBy("survey_id").agg(
        a.alias("min_lat"), b.alias("max_lat"), c.alias("min_lon"), d.alias("max_lon"),
        e.alias("min_depth"), f.alias("max_depth"))
